"""Alignment of two tokenizers' tokens by the bytes they stand for, with an identity-map fast path.

Both tokenizers cut the same bytes. Offsets where tokens of both end cut them into groups. Most groups
hold one token of each, and then the B token is the one with the same bytes: a map from A ids to
same-bytes B ids is made from the vocabularies, and pairs in it are counted in a vector with a place
for each A id, one vector a task. Only pairs of irregular groups outside the map go through a shuffle.

Texts are taken in blocks of `BLOCK_BYTES`, worked through in parts of `PART_BYTES`, so that what a
worker holds beside its caches does not grow with a block. A block writes one row for each text (digest columns, and
its pairs with their links as places in the block's list) and one row with the list: each irregular
pair of the block once, and in how many of its texts it is. Lists are summed over all blocks; the
sums go back to the lists, a list as a whole to its texts. Nothing per text is shuffled for counting,
a pair that is in every text costs one row a block, and only vectors of the vocabulary's length are
sent to all tasks: counts of the identity pairs, and the highest count for each A id.

Defined cases: null and empty texts, and texts whose joined A or B bytes differ from a space and the
text, have no tokens (zeros and an empty hash). Strings of special tokens are plain text. A pair
counts once for a text, however often it holds it; repeated rows count each. A group of any size is
worked through in chunks of `CHUNK` links of different ids. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattquill.llm.common import once_per_worker, slices, stored, table, texts_of, with_text
from wattquill.llm.packing import gathered

A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"
BLOCK_BYTES = 3_000_000
PART_BYTES = 500_000
LEARNED = 2000
CHUNK = 2_000_000
CACHED = 300_000
STRETCH = re.compile(r" (?=[A-Za-zÀ-ÖØ-öø-ÿ])(?<=\S )")
SEPARATORS = (",", "|", ";")


def byte_level() -> dict[str, int]:
    """The characters of byte-level vocabularies: printable bytes stand for themselves, the others
    for the code points from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Bytes of the tokens: `flat` from `first`, `size` of them for each id."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return gathered(self.flat, self.first, self.size, ids)


class Pair:
    """Both tokenizers, their tokens' bytes, the identity map, the ids as text for the hashes, and the
    ids of stretches seen before."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        of_char = byte_level()
        special = {t["id"] for t in json.loads(self.a.to_str())["added_tokens"]}
        names = {i: t for t, i in self.a.get_vocab().items()}
        a_tokens = [
            b"" if i in special or i not in names else bytes(of_char[c] for c in names[i])
            for i in range(max(names) + 1)
        ]
        b_tokens = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                b_tokens.append(bytes([int(piece[3:5], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i):
                b_tokens.append(b"")
            else:
                b_tokens.append(piece.replace("▁", " ").encode())
        self.a_bytes, self.b_bytes = Vocabulary(a_tokens), Vocabulary(b_tokens)
        place = {t: i for i, t in reversed(list(enumerate(b_tokens))) if t}
        self.same = np.fromiter((place.get(t, -1) for t in a_tokens), np.int64, len(a_tokens))
        most = max(len(a_tokens), len(b_tokens))
        self.texts = Vocabulary([f"{i}{s}".encode() for i in range(most) for s in SEPARATORS])
        pieces = (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        self.local = not any("▁" in p.lstrip("▁") for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.a_kept, self.b_kept = Kept(), Kept()

    def learn(self, new: list[str]) -> None:
        """Ids of stretches that were not seen yet."""
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        for k in range(0, len(new), LEARNED):
            some = new[k : k + LEARNED]
            # the encodings hold much more than the ids
            self.a_kept.append([e.ids for e in self.a.encode_batch_fast([" " + t for t in some], add_special_tokens=False)])
            self.b_kept.append(self.b.encode(some, num_threads=1))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids and their number for each text, B ids and their number.

        No token of either vocabulary reaches over a single space before a letter, so each distinct
        stretch between such spaces is encoded once and looked up from then on.
        """
        parts = [STRETCH.split(t) for t in texts] if self.local else [[t] for t in texts]
        flat = [p for own in parts for p in own]
        if len(self.place) > CACHED:
            self.clear()
        if new := list(dict.fromkeys(p for p in flat if p not in self.place)):
            self.learn(new)
        which = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        cuts = np.cumsum([0, *map(len, parts)])
        return *self.a_kept.of(which, cuts), *self.b_kept.of(which, cuts)


class Kept:
    """Ids of the stretches seen so far, 4 bytes each."""

    def __init__(self):
        self.flat, self.size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]

    def append(self, ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat.append(np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum())))
        self.size.append(sizes)

    def of(self, which: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts whose stretches lie between the cuts, and their number for each text."""
        if len(self.flat) > 1:
            self.flat, self.size = [np.concatenate(self.flat)], [np.concatenate(self.size)]
        (flat,), (size,) = self.flat, self.size
        ids = gathered(flat, np.cumsum(size) - size, size, which)
        return ids.astype(np.int64), np.diff(np.cumsum(np.r_[0, size[which]])[cuts])


class Groups:
    """The groups of a run of texts, all with tokens of the same bytes.

    `a_group` and `b_group` have the group of each token, `a_n` and `b_n` their number in each group,
    `row` the text of each group.
    """

    def __init__(self, pair: Pair, a: np.ndarray, a_row: np.ndarray, b: np.ndarray):
        a_ends, b_ends = np.cumsum(pair.a_bytes.size[a]), np.cumsum(pair.b_bytes.size[b])
        total = int(a_ends[-1]) if len(a_ends) else 0
        ends = np.zeros(total + 1, bool)
        ends[b_ends] = True
        a_common = ends[a_ends]
        ends[:] = False
        ends[a_ends] = True
        b_common = ends[b_ends]
        self.a_group = np.cumsum(a_common) - a_common
        self.b_group = np.cumsum(b_common) - b_common
        groups = int(a_common.sum())
        self.a_n = np.bincount(self.a_group, minlength=groups)
        self.b_n = np.bincount(self.b_group, minlength=groups)
        self.row = a_row[a_common]


def links(pair: Pair, a: np.ndarray, b: np.ndarray, groups: Groups, rows: int):
    """Text, pair (A id * 2^32 + B id) and number of links, once for each pair of a text.

    Pairs of the map are told by the caller from the pair itself.
    """
    single = (groups.a_n == 1) & (groups.b_n == 1)
    a_single, b_single = single[groups.a_group], single[groups.b_group]
    row, left, right = groups.row[single], a[a_single], b[b_single]
    found = [counted(row, (left << 32) | right, np.ones(len(row), np.int64))]
    # each id once in a group, with how often it is there
    a_row, a_id, a_times = counted(groups.a_group[~a_single], a[~a_single], None)
    b_row, b_id, b_times = counted(groups.b_group[~b_single], b[~b_single], None)
    first = np.searchsorted(b_row, a_row)
    size = np.searchsorted(b_row, a_row, "right") - first
    edges = np.cumsum(size)
    at = 0
    while at < len(a_row):
        done = int(edges[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(edges, done + CHUNK, "right")))
        which = np.repeat(np.arange(at, stop), size[at:stop])
        other = gathered(np.arange(len(b_row)), first, size, np.arange(at, stop))
        found.append(
            counted(groups.row[a_row[which]], (a_id[which] << 32) | b_id[other], a_times[which] * b_times[other])
        )
        at = stop
    return counted(*(np.concatenate(parts) for parts in zip(*found, strict=True)))


def counted(row: np.ndarray, value: np.ndarray, times: np.ndarray | None):
    """Rows and values, each once and in order, with the sum of `times` (or their number)."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(fresh)
    if times is None:
        return row[at], value[at], np.diff(np.r_[at, len(row)])
    return row[at], value[at], np.add.reduceat(times[order], at) if len(at) else times[:0]


def hashes(pair: Pair, a, a_sizes, b, b_sizes, groups: Groups) -> list[str]:
    """SHA-256 of the groups of each text, written as `a1,a2|b1;a3|b2`."""
    last_a = np.r_[groups.a_group[1:] != groups.a_group[:-1], True]
    last_b = np.r_[groups.b_group[1:] != groups.b_group[:-1], True]
    code = np.empty(len(a) + len(b), np.int64)
    b_before = np.cumsum(groups.b_n) - groups.b_n
    a_through = np.cumsum(groups.a_n)
    code[np.arange(len(a)) + b_before[groups.a_group]] = a * 3 + last_a
    code[np.arange(len(b)) + a_through[groups.b_group]] = b * 3 + 2 * last_b
    size = np.cumsum(np.r_[0, pair.texts.size[code]])
    raw = pair.texts.joined(code).tobytes()
    ends = size[np.cumsum(a_sizes + b_sizes)].tolist()
    # without the `;` of the last group
    return [hashlib.sha256(raw[s : e - 1]).hexdigest() for s, e in zip([0, *ends], ends)]


def same_bytes(pair: Pair, texts: list[str], a, a_sizes, b, b_sizes) -> np.ndarray:
    """Whether the bytes of both tokens are a space and the text."""
    wanted = [b" " + t.encode() for t in texts]
    size = np.fromiter(map(len, wanted), np.int64, len(wanted))
    good = size > 1
    for vocabulary, ids, sizes in ((pair.a_bytes, a, a_sizes), (pair.b_bytes, b, b_sizes)):
        ends = np.cumsum(np.r_[0, vocabulary.size[ids]])[np.r_[0, np.cumsum(sizes)]]
        raw = vocabulary.joined(ids).tobytes()
        good &= np.diff(ends) == size
        good &= np.fromiter(
            (raw[s:e] == w for s, e, w in zip(ends[:-1].tolist(), ends[1:].tolist(), wanted, strict=True)), bool, len(wanted)
        )
        # a token without bytes has no place among the offsets
        good &= np.bincount(np.repeat(np.arange(len(sizes)), sizes), vocabulary.size[ids] == 0, len(sizes)) == 0
    return good


SCHEMA = pa.schema(
    [
        ("kind", pa.string()),
        ("block", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("n_links", pa.int64()),
        ("groups_sha256", pa.string()),
        ("regular", pa.binary()),  # A ids of the map and their links, 4 bytes each
        ("irregular", pa.binary()),  # places in the block's list and A ids and links, 4 bytes each
        ("ids", pa.list_(pa.int64())),
        ("texts", pa.list_(pa.int64())),
    ]
)
DDL = (
    "kind string, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, regular binary, irregular binary, ids array<long>, texts array<long>"
)


def batch_of(n: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in SCHEMA]
    return pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)


def packed(columns: tuple[np.ndarray, ...], cuts: np.ndarray) -> list[bytes]:
    """For each text between the cuts the columns one after the other, 4 bytes a value."""
    parts = [c.astype("<u4") for c in columns]
    cuts = cuts.tolist()
    return [b"".join(p[s:e].tobytes() for p in parts) for s, e in zip(cuts, cuts[1:])]


class Listed:
    """The irregular pairs of a block in the order of their places, and in how many texts each is."""

    def __init__(self):
        # ascending, with their places
        self.pairs, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.texts = np.zeros(0, np.int64)

    def places(self, pairs: np.ndarray) -> np.ndarray:
        """Where they stand; pairs come once for each text."""
        distinct, which, texts = np.unique(pairs, return_inverse=True, return_counts=True)
        new = distinct[~np.isin(distinct, self.pairs, assume_unique=True)]
        at = np.searchsorted(self.pairs, new)
        self.pairs = np.insert(self.pairs, at, new)
        self.place = np.insert(self.place, at, np.arange(len(new)) + len(self.texts))
        place = self.place[np.searchsorted(self.pairs, distinct)]
        self.texts = np.r_[self.texts, np.zeros(len(new), np.int64)]
        self.texts[place] += texts
        return place[which]

    def ids(self) -> np.ndarray:
        out = np.empty_like(self.pairs)
        out[self.place] = self.pairs
        return out


def aligned(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows `text` (one a text), `list` (the irregular pairs of a block) and `vector` (one a task)."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = once_per_worker(f"pair {a_path} {b_path}", lambda: Pair(a_path, b_path))
        vector = np.zeros(len(pair.same), np.int64)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for whole in slices(batch, "text", block_bytes):
                block += 1
                listed = Listed()
                for part in slices(whole, "text", PART_BYTES):
                    texts = texts_of(part, "text").to_pylist()
                    a, a_sizes, b, b_sizes = pair.encode(texts)
                    good = same_bytes(pair, texts, a, a_sizes, b, b_sizes)
                    a, b = a[np.repeat(good, a_sizes)], b[np.repeat(good, b_sizes)]
                    a_sizes, b_sizes = a_sizes * good, b_sizes * good
                    rows = len(texts)
                    groups = Groups(pair, a, np.repeat(np.arange(rows), a_sizes), b)
                    row, both, n = links(pair, a, b, groups, rows)
                    left = both >> 32
                    regular = pair.same[left] == (both & 0xFFFFFFFF)
                    vector += np.bincount(left[regular], minlength=len(vector))
                    place = listed.places(both[~regular])
                    cuts = np.arange(rows + 1)
                    sha = iter(hashes(pair, a, a_sizes[good], b, b_sizes[good], groups) if good.any() else ())
                    yield batch_of(
                        rows,
                        kind=["text"] * rows,
                        block=[block] * rows,
                        doc_id=part.column("doc_id"),
                        n_a=a_sizes,
                        n_b=b_sizes,
                        n_groups=np.bincount(groups.row, minlength=rows),
                        n_links=np.bincount(row, n, rows).astype(np.int64),
                        groups_sha256=[next(sha) if g else "" for g in good.tolist()],
                        regular=packed((left[regular], n[regular]), np.searchsorted(row[regular], cuts)),
                        irregular=packed((place, left[~regular], n[~regular]), np.searchsorted(row[~regular], cuts)),
                    )
                yield batch_of(1, kind=["list"], block=[block], ids=[listed.ids()], texts=[listed.texts])
        seen = np.flatnonzero(vector)
        yield batch_of(1, kind=["vector"], ids=[seen], texts=[vector[seen]])

    return docs.mapInArrow(align, DDL)


def cross_tokens(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text."""
    spark = docs.sparkSession
    docs = with_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = stored(aligned(docs, a_path, b_path, block_bytes), "aligned")
    each = F.explode(F.arrays_zip("ids", "texts")).alias("e")
    # at most one row for each A id: the vocabulary bounds it
    vector = (
        rows.filter("kind = 'vector'").select(each).groupBy(F.col("e.ids").alias("a")).agg(F.sum("e.texts").alias("n"))
    )
    listed = rows.filter("kind = 'list'").select("block", F.posexplode(F.arrays_zip("ids", "texts")).alias("place", "e"))
    listed = listed.select("block", "place", F.col("e.ids").alias("pair"), F.col("e.texts").alias("texts"))
    counts = stored(listed.groupBy("pair").agg(F.sum("texts").alias("n")), "counts")
    highest = counts.groupBy(F.shiftrightunsigned("pair", 32).alias("a")).agg(F.max("n").alias("n"))
    known = {r["a"]: r["n"] for r in vector.collect()}
    best = {r["a"]: r["n"] for r in highest.collect()}
    size = max([*known, *best, -1]) + 1
    same_n, best_n = np.zeros(size, np.int64), np.zeros(size, np.int64)
    same_n[list(known)] = list(known.values())
    best_n[list(best)] = list(best.values())
    best_n = np.maximum(best_n, same_n)
    # the counts of each block's list go back to its texts
    back = listed.join(counts, "pair").select(F.col("block").alias("of"), "place", "n")
    digests = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    texts = rows.filter("kind = 'text'").select("block", *digests, "regular", "irregular")
    sent = spark.sparkContext.broadcast((same_n, best_n))

    def score(texts: pa.Table, back: pa.Table) -> pa.Table:
        same_n, best_n = sent.value
        values = np.zeros(back.num_rows, np.int64)
        values[back.column("place").to_numpy()] = back.column("n").to_numpy()
        n_best, count_sum = [], []
        for regular, irregular in zip(*(texts.column(c).to_pylist() for c in ("regular", "irregular")), strict=True):
            left, n = np.frombuffer(regular, "<u4").reshape(2, -1).astype(np.int64)
            count = same_n[left]
            total, top = int(count @ n), int(n[count == best_n[left]].sum())
            if irregular:
                place, left, n = np.frombuffer(irregular, "<u4").reshape(3, -1).astype(np.int64)
                count = values[place]
                total, top = total + int(count @ n), top + int(n[count == best_n[left]].sum())
            n_best.append(top)
            count_sum.append(total)
        return pa.Table.from_arrays(
            [*(texts.column(c) for c in digests), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())],
            [*digests, "n_best", "count_sum"],
        )

    # a block is a bounded slice of the texts, so each pair of groups is as well
    return (
        texts.groupBy("block")
        .cogroup(back.groupBy("of"))
        .applyInArrow(
            score,
            "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long",
        )
    )


def op11_crosstokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cross_tokens(docs, public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE))
