"""Toxicity of documents by their nearest labelled examples.

Documents and examples are TF-IDF vectors over a lexicon of at most `LEXICON` terms: the words and
word beginnings (four and five letters) that go with the label most clearly. Its document counts
come from the whole corpus. The examples stand in an inverted index whose lists are cut into blocks
of 64 examples; the greatest weight of a term in a block bounds every cosine there, so that a query
visits blocks from the highest bound down and stops at the first that can't reach its k-th
neighbour. The cosines are exact. The neighbours vote, nearer ones more, and the share of toxic
votes is calibrated on examples that were not in the index.

Fixed bounds: at most `EXAMPLES` labelled rows of each class are examples, those with the smallest
hash of their id; votes are weighted with what each stands for. The model has a fixed size and is
sent to all tasks; every document is scored, whole.

Defined cases: a null or empty text, or one without a lexicon term, gets the share of toxic rows
among such examples. Null labels and ids are not learned from; a document with several labels
counts as toxic if one says so, one with several texts is learned from by the first in order.
Repeated rows are scored each. Without any labels the score is 0.5;
with labels of one class only, that class's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattquill.llm.common import Words, set_aside, slices, stored, table, texts_of, with_text

EXAMPLES = 6000
LEXICON = 512
NEIGHBOURS = 15
BLOCK = 64
FIRST_BLOCKS = 4
KEPT_VOTES = 20_000
THRESHOLD = 0.3
PREFIXES = (4, 5)


def text_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Text, term and count of each distinct pair, and the names of the terms.

    A word is a term `word`, its beginnings are terms `beginning*`.
    """
    words = Words(texts)
    names, codes, rows = [words.names], [words.code], [words.row]
    base = len(words.names)
    for size in PREFIXES:
        heads = pc.utf8_slice_codeunits(words.names, 0, size)
        long_enough = pc.greater_equal(pc.utf8_length(words.names), size)
        heads = pc.binary_join_element_wise(heads, "*", "").dictionary_encode()
        keep = long_enough.to_numpy(zero_copy_only=False)[words.code]
        code = heads.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.code[keep]]
        names.append(heads.dictionary)
        codes.append(code + base)
        rows.append(words.row[keep])
        base += len(heads.dictionary)
    row, code = np.concatenate(rows), np.concatenate(codes)
    pairs, counts = np.unique(row * max(base, 1) + code, return_counts=True)
    flat = pa.chunked_array([x.cast(pa.string()) for x in names]).combine_chunks()
    return pairs // max(base, 1), pairs % max(base, 1), counts, flat


def in_lexicon(texts: pa.Array, lexicon: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `text_terms`, terms as places in the lexicon, others left out."""
    row, code, count, names = text_terms(texts)
    if not len(row) or not len(lexicon):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    place = pc.fill_null(pc.index_in(names, value_set=lexicon), -1).to_numpy(zero_copy_only=False)
    term = place.astype(np.int64)[code]
    keep = term >= 0
    return row[keep], term[keep], count[keep]


class BlockMaxIndex:
    """Weights of distinct unit vectors by term, in blocks, with the greatest weight of each block."""

    def __init__(self, vectors: np.ndarray):
        pad = (-len(vectors)) % BLOCK
        full = np.vstack([vectors, np.zeros((pad, vectors.shape[1]))]).astype(np.float32)
        self.lists = np.ascontiguousarray(full.T).reshape(vectors.shape[1], -1, BLOCK)
        self.bounds = self.lists.max(axis=2).astype(np.float64)

    def nearest(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest with a cosine over 0; ties to the smaller place.

        The blocks with the highest bounds set the cosine to beat; then every block whose bound
        reaches it is read, and no other.
        """
        terms = np.flatnonzero(query)
        weight = query[terms]
        bound = weight @ self.bounds[terms]
        first = np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]
        place, best = self.top(terms, weight, first[bound[first] > 0], k)
        least = best[-1] if len(best) == k else 0.0
        rest = (bound > 0) & (bound >= least - 1e-6)
        rest[first] = False
        more, cosine = self.top(terms, weight, np.flatnonzero(rest), k)
        place, best = np.r_[place, more], np.r_[best, cosine]
        order = np.lexsort((place, -best))[:k]
        return place[order], best[order]

    def top(self, terms, weight, blocks, k: int) -> tuple[np.ndarray, np.ndarray]:
        part = self.lists[terms[:, None], blocks[None, :]].astype(np.float64)
        score = np.round(np.tensordot(weight, part, axes=1).ravel(), 9)
        hit = np.flatnonzero(score > 0)
        if len(hit) > k:
            hit = hit[score[hit] >= np.partition(score[hit], -k)[-k]]
        place = blocks[hit // BLOCK] * BLOCK + hit % BLOCK
        order = np.lexsort((place, -score[hit]))[:k]
        return place[order], score[hit][order]


@dataclass
class Examples:
    """Examples with equal vectors are one entry, with its weights of both classes."""

    index: BlockMaxIndex | None
    weight: np.ndarray
    toxic: np.ndarray
    doc_id: np.ndarray
    empty: float

    @classmethod
    def of(cls, vectors: np.ndarray, toxic: np.ndarray, weight: np.ndarray, ids: np.ndarray):
        some = vectors.any(axis=1)
        prior = (toxic @ weight + 0.5) / (weight.sum() + 1.0) if len(weight) else 0.5
        bare = weight[~some]
        empty = (toxic[~some] @ bare + prior) / (bare.sum() + 1.0)
        if not some.any():
            return cls(None, weight[:0], toxic[:0], ids[:0], float(empty))
        unique, where = np.unique(np.round(vectors[some], 12), axis=0, return_inverse=True)
        where = where.ravel()
        n = len(unique)
        first = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(first, where, ids[some])
        total = np.bincount(where, weight[some], n)
        bad = np.bincount(where, weight[some] * toxic[some], n)
        # neighbours in the index share their heaviest term: blocks with tight bounds
        order = np.lexsort((first, unique.argmax(axis=1)))
        return cls(BlockMaxIndex(unique[order]), total[order], bad[order], first[order], float(empty))

    def vote(self, query: np.ndarray) -> tuple[float, list[int]]:
        """Share of toxic votes and the examples that voted, nearest first."""
        if self.index is None or not query.any():
            return self.empty, []
        place, cosine = self.index.nearest(query, NEIGHBOURS)
        if not len(place):
            return self.empty, []
        near = 1.0 / (1.05 - cosine)
        # a vector that many examples share counts more, but not in proportion
        mass = near * np.log1p(self.weight[place])
        share = (self.toxic[place] / self.weight[place]) @ mass
        return float((share + self.empty) / (mass.sum() + 1.0)), self.doc_id[place].tolist()


@dataclass
class Model:
    lexicon: list[str]
    idf: np.ndarray
    examples: Examples
    slope: float
    shift: float

    def calibrated(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * logit(vote) + self.shift, -30, 30))))


def logit(share: float | np.ndarray) -> float | np.ndarray:
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def unit_vectors(n: int, row, term, count, idf: np.ndarray) -> np.ndarray:
    out = np.zeros((n, len(idf)))
    out[row, term] = (1 + np.log(count)) * idf[term]
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def learnable(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and examples from the labels, document counts from all of `docs`."""
    usable = learnable(labels)
    total = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    chosen = usable.filter("toxic = 1").orderBy(order, "doc_id").limit(EXAMPLES).unionByName(
        usable.filter("toxic = 0").orderBy(order, "doc_id").limit(EXAMPLES)
    )
    # at most 2 * EXAMPLES rows of two numbers; one text for each, read from a small table from here on
    texts = with_text(docs.select("doc_id", "text")).join(F.broadcast(chosen), "doc_id")
    texts = stored(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                toxic = part.column("toxic").to_numpy(zero_copy_only=False)
                row, code, _, names = text_terms(texts_of(part, "text"))
                bad = np.bincount(code[toxic[row] == 1], minlength=len(names))
                good = np.bincount(code[toxic[row] == 0], minlength=len(names))
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(bad), pa.array(good)], ["term", "bad", "good"]
                )

    terms = (
        texts.mapInArrow(counted, "term string, bad long, good long")
        .groupBy("term")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )
    sizes = texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()
    seen = {r["toxic"]: r["n"] for r in sizes}
    n_bad, n_good = seen.get(1, 0), seen.get(0, 0)
    lexicon: list[str] = []
    if n_bad and n_good:
        rated = association(terms.filter(F.col("bad") + F.col("good") >= 2), n_bad, n_good)
        best = rated.orderBy(F.desc("gain"), "term").limit(LEXICON).collect()
        tested = terms.count()
        # about one term gets this far by chance
        lexicon = [r["term"] for r in best if r["gain"] >= 2 * np.log(max(tested, 2))]
    names = pa.array(lexicon, pa.string())

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(names) + 1, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                _, term, _ = in_lexicon(texts_of(part, "text"), names)
                df[:-1] += np.bincount(term, minlength=len(names))
                n += part.num_rows
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df))), pa.array(df)], ["term", "df"])

    counts = np.zeros(len(lexicon) + 1)
    for r in (
        with_text(docs.select("text"))
        .mapInArrow(document_counts, "term long, df long")
        .groupBy("term")
        .agg(F.sum("df").alias("df"))
        .collect()
    ):
        counts[r["term"]] = r["df"]
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, term, count = in_lexicon(texts_of(part, "text"), names)
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("toxic"),
                        pa.ListArray.from_arrays(cuts, pa.array(term.astype(np.int32))),
                        pa.ListArray.from_arrays(cuts, pa.array(count.astype(np.int32))),
                    ],
                    ["doc_id", "toxic", "terms", "counts"],
                )

    rows = texts.mapInArrow(
        vectors, "doc_id long, toxic int, terms array<int>, counts array<int>"
    ).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["terms"], r["counts"]))
    at = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows])
    term = np.array([t for r in rows for t in r["terms"]], np.int64)
    count = np.array([c for r in rows for c in r["counts"]], np.float64)
    x = unit_vectors(len(rows), at.astype(np.int64), term, count, idf)
    y = np.array([float(r["toxic"]) for r in rows])
    ids = np.array([r["doc_id"] for r in rows], np.int64)
    weight = np.where(y == 1, total.get(1, 0) / max(n_bad, 1), total.get(0, 0) / max(n_good, 1))
    slope, shift = calibration(x, y, weight, ids)
    return Model(lexicon, idf, Examples.of(x, y, weight, ids), slope, shift)


def association(terms: DataFrame, n_bad: int, n_good: int) -> DataFrame:
    """G-squared of term and label, of documents with the term."""
    bad, good = F.col("bad").cast("double"), F.col("good").cast("double")
    n = float(n_bad + n_good)

    def part(seen, of):
        return F.when(seen > 0, seen * F.log(seen / of)).otherwise(0.0)

    with_it = bad + good
    gain = (
        part(bad, with_it * (n_bad / n))
        + part(good, with_it * (n_good / n))
        + part(n_bad - bad, (n - with_it) * (n_bad / n))
        + part(n_good - good, (n - with_it) * (n_good / n))
    )
    return terms.withColumn("gain", 2 * gain)


def calibration(x, y, weight, ids) -> tuple[float, float]:
    """Slope and shift for the log-odds of a vote, from examples voted on by the other half.

    The slope stays over 0: the order of the votes is kept. Too few examples: as they are.
    """
    if len(y) < 40 or y.min(initial=0) == y.max(initial=0):
        return 1.0, 0.0
    half = (ids % 2).astype(bool)
    votes = np.zeros(len(y))
    for side in (True, False):
        if not (half != side).any():
            return 1.0, 0.0
        others = half != side
        known = Examples.of(x[others], y[others], weight[others], ids[others])
        for r in np.flatnonzero(half == side):
            votes[r] = known.vote(x[r])[0]
    z, scale = logit(votes), weight / weight.sum() * len(y)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps, held near 1 and 0 by a small penalty
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(scale * (p - y)) @ z + (a - 1), (scale * (p - y)).sum() + b])
        v = scale * p * (1 - p)
        h = np.array([[v @ z**2 + 1, v @ z], [v @ z, v.sum() + 1]])
        step = np.linalg.solve(h, g)
        a, b = float(np.clip(a - step[0], 0.05, 10)), float(np.clip(b - step[1], -10, 10))
    return a, b


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `toxic_score` (0 to 1) and `toxic_evidence` (ids of the examples that voted)."""
    names = pa.array(model.lexicon, pa.string())
    docs = docs.drop("toxic_score", "toxic_evidence")
    schema = docs.schema
    out = docs.limit(0).withColumns(
        {"toxic_score": F.lit(0.0), "toxic_evidence": F.lit(None).cast("array<bigint>")}
    ).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[bytes, bytes], tuple[float, list[int]]] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                row, term, count = in_lexicon(texts_of(part, "text"), names)
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                scores, evidence = [], []
                if len(known) > KEPT_VOTES:
                    known.clear()
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    key = (term[a:b].tobytes(), count[a:b].tobytes())
                    if key not in known:
                        one = np.zeros(b - a, np.int64)
                        query = unit_vectors(1, one, term[a:b], count[a:b], model.idf)[0]
                        vote, ids = model.examples.vote(query)
                        # without neighbours the vote is an observed share already
                        known[key] = (model.calibrated(vote) if ids else vote), ids
                    scores.append(known[key][0])
                    evidence.append(known[key][1])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))],
                    [*schema.names, "toxic_score", "toxic_evidence"],
                )

    return docs.mapInArrow(score, out)


def rejected(score) -> F.Column:
    return score >= THRESHOLD


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        F.col("toxic_score").alias("score"),
        rejected(F.col("toxic_score")).cast("int").alias("predicted"),
        F.col("toxic_evidence").alias("evidence"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not rejected."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    rows, back = set_aside(docs, ["doc_id", "text"])
    return back(scored(rows, model).filter(~rejected(F.col("toxic_score"))))
