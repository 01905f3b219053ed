"""I-Match fingerprints with randomised lexicons.

The lexicon holds the words whose document frequency, over the whole corpus, is a share between
`LEAST` and `MOST` of the documents: an inverse-document-frequency band. Document frequencies add up
to the words of an average document times the documents, so at most (average / LEAST) words are in
it, however large the corpus is; it is sent to all tasks. The distinct lexicon words of a text are
sorted; their hash is the first part of the fingerprint. `SETS` random subsets of the lexicon, each
thinned to a half, a quarter and so on `SCALES` times, give a hash each. Texts that share many words
agree in many of the thin subsets; the likeness of two fingerprints is the share of equal hashes
among the thinnest subsets that are mostly not empty.

Defined cases: a null text is an empty one; a text without lexicon words uses all its words; empty
texts share one fingerprint. The next document is the one with the next larger doc_id, among rows
of one doc_id the one whose packed text follows; after the last comes the first, so a single
document follows itself. Null ids come first.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattquill.llm.common import Words, mixed, signed, slices, table, texts_of, with_text

LEAST, MOST = 0.002, 0.05
SETS, SCALES = 32, 10
HEX = 4
ROWS_PER_BUCKET = 4000
NULL_KEY = -(2**63)


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each distinct word of each text, by both."""
    words = Words(texts)
    hashes = words.hashes()
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    width = max(len(order), 1)
    pairs = np.unique(words.row * width + rank[words.code]) if len(words.code) else np.zeros(0, np.int64)
    return pairs // width, hashes[order][pairs % width] if len(order) else np.zeros(0, np.uint64)


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> np.ndarray:
    """Sorted hashes of the words within the band, of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            word = np.concatenate([w for w, _ in held])
            n = np.concatenate([c for _, c in held])
            order = np.argsort(word, kind="stable")
            word, n = word[order], n[order]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            return word[first], np.add.reduceat(n, first)

        def out() -> pa.RecordBatch:
            word, n = merged()
            return pa.RecordBatch.from_arrays([pa.array(signed(word)), pa.array(n)], ["word", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                _, word = text_words(texts_of(part, "text"))
                if len(word):
                    held.append(np.unique(word, return_counts=True))
                if sum(len(w) for w, _ in held) > 2_000_000:
                    yield out()
                    held.clear()
        if held:
            yield out()

    n = docs.count()
    rows = (
        docs.select("text")
        .mapInArrow(count, "word long, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n").between(least * n, most * n))
        .select("word")
        .toPandas()
    )
    return np.sort(rows["word"].to_numpy(np.int64).view(np.uint64))


def fingerprints(texts: pa.Array, band: np.ndarray) -> list[str]:
    row, word = text_words(texts)
    n = len(texts)
    if len(band):
        place = np.minimum(np.searchsorted(band, word), len(band) - 1)
        known = band[place] == word
        bare = np.bincount(row[known], minlength=n) == 0
        keep = known | bare[row]
        row, word = row[keep], word[keep]
    parts = np.zeros((n, 1 + SETS * SCALES), np.uint64)
    parts[:, 0] = sorted_hash(row, word, n)
    for k in range(SETS):
        chance = mixed(word ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64))
        r, w = row, word
        for scale in range(1, SCALES + 1):
            keep = chance >> np.uint64(64 - scale) == 0
            r, w, chance = r[keep], w[keep], chance[keep]
            parts[:, 1 + (scale - 1) * SETS + k] = sorted_hash(r, w, n)
    # 0 says that a subset has no word
    codes = np.where(parts > 0, 1 + parts % np.uint64(16**HEX - 1), 0).astype(">u2")
    return [codes[i].tobytes().hex() for i in range(n)]


def sorted_hash(row: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """A hash of the sorted words of each text, 0 if it has none."""
    out = np.zeros(n, np.uint64)
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        spread = mixed(word + mixed(place.astype(np.uint64)))
        out[row[first]] = mixed(np.add.reduceat(spread, first)) | np.uint64(1)
    return out


def likeness(a: str, b: str) -> float:
    """Share of equal hashes at the thinnest scale where most subsets have a word of either text."""
    if a == b:
        return 1.0
    x = np.frombuffer(bytes.fromhex(a), ">u2")[1:].reshape(SCALES, SETS)
    y = np.frombuffer(bytes.fromhex(b), ">u2")[1:].reshape(SCALES, SETS)
    some = ((x > 0) | (y > 0)).sum(axis=1)
    equal = ((x == y) & (x > 0)).sum(axis=1)
    dense = np.flatnonzero(some >= SETS * 3 // 4)
    scale = int(dense[-1]) if len(dense) else 0
    return float(equal[scale] / some[scale]) if some[scale] else 0.0


def compared(docs: DataFrame, band: np.ndarray, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to it and to the next.

    The documents are dealt out once, packed, in ranges of their ids; the first of each range also
    goes to the range before it.
    """
    keyed = docs.select(F.coalesce("doc_id", F.lit(NULL_KEY)).alias("key"), "text")
    ids = keyed.select("key")
    n = ids.count()
    parts = max(1, -(-n // rows_per_bucket))
    shares = [k / parts for k in range(1, parts)]
    cuts = sorted(set(map(int, ids.approxQuantile("key", shares, 0.1 / parts)))) if shares else []

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(np.searchsorted(cuts, key, "right").astype(np.int32))],
                ["key", "bucket"],
            )

    heads = ids.mapInArrow(bucketed, "key long, bucket int").groupBy("bucket").agg(F.min("key").alias("key"))
    filled = sorted((r["bucket"], r["key"]) for r in heads.collect())
    before = {key: filled[k - 1][0] for k, (_, key) in enumerate(filled)}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch, "text"):
                out = {"bucket": [], "halo": [], "key": [], "body": []}
                for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                    body = pack.compress(text.encode("utf-8", "surrogatepass"))
                    where = [(bisect_right(cuts, key), 0)]
                    if key in before:
                        where.append((before[key], 1))
                    for bucket, halo in where:
                        for name, value in zip(out, (bucket, halo, key, body), strict=True):
                            out[name].append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["bucket"], pa.int32()), pa.array(out["halo"], pa.int32()), pa.array(out["key"], pa.int64()), pa.array(out["body"], pa.binary())],
                    list(out),
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last: tuple[int, int, int, str] | None = None
        for batch in batches:
            for part in slices(batch, "body", 1_500_000):
                rows = [
                    (b, h, k, unpack.decompress(body).decode("utf-8", "surrogatepass"))
                    for b, h, k, body in zip(*(c.to_pylist() for c in part.columns), strict=True)
                ]
                rows = [last, *rows] if last else rows
                # a halo row after the first of its bucket is a repeated id: it follows nothing
                pairs = [
                    (i, i + 1)
                    for i in range(len(rows) - 1)
                    if rows[i][0] == rows[i + 1][0] and not rows[i][1]
                ]
                last = rows[-1]
                if not pairs:
                    continue
                own = fingerprints(pa.array([r[3] for r in rows], pa.string()), band)
                edited = []
                for i, j in pairs:
                    text, half = rows[i][3], len(rows[i][3]) // 2
                    edited.append(text[: len(text) - half] + rows[j][3][:half])
                prints = fingerprints(pa.array(edited, pa.string()), band)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if rows[i][2] == NULL_KEY else rows[i][2] for i, _ in pairs], pa.int64()),
                        pa.array([len(rows[i][3]) for i, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                        pa.array([own[i] for i, _ in pairs], pa.string()),
                        pa.array(prints, pa.string()),
                        pa.array([likeness(own[i], p) for (i, _), p in zip(pairs, prints, strict=True)], pa.float64()),
                        pa.array([likeness(own[i], own[j]) for i, j in pairs], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return (
        keyed.mapInArrow(dealt, "bucket int, halo int, key long, body binary")
        .repartitionById(max(parts, 1), "bucket")
        .sortWithinPartitions("bucket", "halo", "key", "body")
        .mapInArrow(
            compare,
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
        )
    )


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return compared(docs, lexicon(docs))
