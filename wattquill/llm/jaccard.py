"""Similarity join of documents on the Jaccard similarity of their five-word shingles.

Documents with equal shingle sets are one node. Each node has a MinHash signature of `TREES` bands of
equal length; two nodes are candidates if any band is equal. This is banding, not a forest of prefix
tries: the threshold is fixed, so the length follows from it before data is read, the longest up to
`DEPTH` that finds a pair at the threshold with at least `RECALL`: 4 values, 0.9998. Candidates
are linked to the smallest node with their prefix, not to each other; the connected parts of that
graph hold every candidate pair. Inside each part all pairs are compared exactly, from the shingle
sets. A large part is cut into blocks, and each pair of blocks is a group of its own, so that a
task's memory is bounded; a group returns one row for each of its nodes.

Result: doc_id, class_id (the smallest doc_id of the documents it is linked with, directly or over
others) and n_links (documents with a similarity of the threshold or more, copies counted one by one).

Defined cases: a null text is an empty one, and texts without a word are copies of each other; a
text of fewer than five words is one shingle. Rows with a null id take part; a class of such rows
only has a null class_id. Repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattquill.llm.common import Words, mixed, set_aside, slices, stored, table, texts_of, windows, with_text
from wattquill.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8
RECALL = 0.9995
BLOCK = 512
COLUMNS = 4096
NO_ID = -(2**63)


def prefix_length(threshold: float, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix with which `trees` tries find a pair at the threshold often enough."""
    for depth in range(DEPTH, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of the distinct shingles of each text, by both."""
    row, _, run = windows(Words(texts), SHINGLE)
    order = np.lexsort((run, row))
    row, run = row[order], run[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (run[1:] != run[:-1])][: len(row)]
    return row[new], run[new]


def nodes_of(row: np.ndarray, run: np.ndarray, n: int) -> tuple[list[bytes], np.ndarray]:
    """128 bits for the shingle set of each text, and the first place of each."""
    parts = np.zeros((n, 2), np.uint64)
    first = np.searchsorted(row, np.arange(n + 1))
    full = np.flatnonzero(np.diff(first))
    if len(full):
        parts[full, 0] = np.add.reduceat(mixed(run), first[full])
        parts[full, 1] = np.add.reduceat(mixed(run ^ np.uint64(0xD6E8FEB86659FD93)), first[full])
    return [parts[k].tobytes() for k in range(n)], first


def sketches(docs: DataFrame, prefix: int) -> DataFrame:
    """key, node and signature of each document; no signature without shingles."""
    rng = np.random.default_rng(5)
    factors = rng.integers(1, 2**63, TREES * prefix, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, TREES * prefix, dtype=np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                row, run = shingles(texts_of(part, "text"))
                nodes, first = nodes_of(row, run, n)
                full = np.flatnonzero(np.diff(first))
                signature = np.zeros((n, TREES * prefix), np.uint32)
                for k in range(TREES * prefix if len(full) else 0):
                    least = np.minimum.reduceat(run * factors[k] + shifts[k], first[full])
                    signature[full, k] = (least >> np.uint64(32)).astype(np.uint32)
                some = np.zeros(n, bool)
                some[full] = True
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        pa.array(nodes, pa.binary()),
                        pa.array([signature[k].tobytes() if some[k] else None for k in range(n)], pa.binary()),
                    ],
                    ["key", "node", "signature"],
                )

    return docs.select("key", "text").mapInArrow(sketch, "key long, node binary, signature binary")


def candidates(nodes: DataFrame, prefix: int) -> DataFrame:
    """(a, b): nodes and the smallest node with the same prefix in some trie."""
    paths = nodes.filter("signature is not null").select(
        "node",
        F.explode(
            F.array(
                *[
                    F.xxhash64(F.lit(t), F.substring("signature", 1 + 4 * prefix * t, 4 * prefix))
                    for t in range(TREES)
                ]
            )
        ).alias("path"),
    )
    shared = paths.groupBy("path").agg(F.min("node").alias("b"), F.max("node").alias("c")).filter("b != c")
    # read from a table of its own, a path that very many nodes share can be split in the join
    shared = stored(shared.select("path", "b"), "paths")
    return (
        paths.join(shared, "path")
        .filter("node != b")
        .select(F.col("node").alias("a"), "b")
        .distinct()
    )


def compared(sizes: np.ndarray, member: np.ndarray, shingle: np.ndarray, threshold: float) -> np.ndarray:
    """Which members are similar (boolean matrix). Shingles that one member has alone don't count."""
    n = len(sizes)
    _, column, count = np.unique(shingle, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    member, column = member[keep], column[keep]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    common = np.zeros((n, n), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        has = np.zeros((n, min(COLUMNS, width - start)), np.float32)
        has[member[a:b], column[a:b] - start] = 1
        common += has @ has.T
    union = sizes[:, None] + sizes[None, :] - common
    alike = common >= threshold * union - 1e-6
    np.fill_diagonal(alike, False)
    return alike


def similar(members: DataFrame, threshold: float) -> DataFrame:
    """For each group and node: links (copies counted) and the smallest node reached in the group.

    `members`: part, i, j (pair of blocks), node, block, copies, shingles (sorted, 8 bytes each).
    """

    def finish(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        nodes, blocks, copies, sets, seen = [], [], [], [], set()
        i = j = 0
        for t in held:
            for node, block, n, body, i, j in zip(*(t.column(c).to_pylist() for c in ("node", "block", "copies", "shingles", "i", "j")), strict=True):
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    blocks.append(block)
                    copies.append(n)
                    sets.append(np.frombuffer(body, np.uint64))
        if len(nodes) < 2:
            return None
        sizes = np.array([len(s) for s in sets], np.float32)
        member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        alike = compared(sizes, member, np.concatenate(sets), threshold)
        side = np.array(blocks)
        if i != j:
            alike &= side[:, None] != side[None, :]
        links = alike.astype(np.int64) @ np.array(copies, np.int64)
        root = np.arange(len(nodes))
        while True:  # smallest place near by, then the places those point to
            near = np.where(alike, root[None, :], len(nodes)).min(axis=1)
            new = np.minimum(root, near)
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.binary()), pa.array([nodes[r] for r in root], pa.binary()), pa.array(links)],
            ["node", "near", "links"],
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("part", "i", "j")), strict=True))
            start = 0
            for k in range(len(keys) + 1):
                if k == len(keys) or k and keys[k] != keys[k - 1] or k == 0 and keys[0] != group:
                    if k > start:
                        held.append(batch.slice(start, k - start))
                        start = k
                    if k < len(keys):
                        if held and (out := finish(held)) is not None:
                            yield out
                        held, group = [], keys[k]
        if held and (out := finish(held)) is not None:
            yield out

    return members.mapInArrow(compare, "node binary, near binary, links long")


def linked(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """key, text_key, node, class_node, class_id and n_links of each row of `docs` (doc_id, text)."""
    prefix = prefix_length(threshold)
    keyed = with_text(docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "text"))
    rows = stored(sketches(keyed, prefix), "sketches")
    nodes = stored(
        rows.groupBy("node").agg(
            # a null id only if no copy has another
            F.coalesce(F.min(F.when(F.col("key") != NO_ID, F.col("key"))), F.lit(NO_ID)).alias("key"),
            F.count("*").alias("copies"),
            F.any_value("signature").alias("signature")
        ),
        "nodes",
    )
    parts = components(candidates(nodes, prefix)).withColumnRenamed("root", "part")
    sizes = parts.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = (
        nodes.select("node", "key", "copies")
        .join(parts, "node")
        .join(sizes, "part")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text"):
                n = cut.num_rows
                row, run = shingles(texts_of(cut, "text"))
                own, first = nodes_of(row, run, n)
                # rows of one id may have other texts: only the one whose set it is
                keep = [k for k, node in enumerate(cut.column("node").to_pylist()) if node == own[k]]
                if keep:
                    some = cut.take(pa.array(keep))
                    bodies = [run[first[k] : first[k + 1]].tobytes() for k in keep]
                    names = ["part", "node", "block", "blocks", "copies"]
                    yield pa.RecordBatch.from_arrays(
                        [*(some.column(c) for c in names), pa.array(bodies, pa.binary())], [*names, "shingles"]
                    )

    with_sets = members.join(keyed, "key").mapInArrow(
        sets, "part binary, node binary, block int, blocks int, copies long, shingles binary"
    )
    grouped = (
        with_sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .drop("blocks", "other")
        .repartition("part", "i", "j")
        .sortWithinPartitions("part", "i", "j", "node")
    )
    found = stored(similar(grouped, threshold), "similar")
    classes = components(found.filter("node != near").select(F.col("node").alias("a"), F.col("near").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = (
        nodes.select("node", F.when(F.col("key") != NO_ID, F.col("key")).alias("key"), "copies")
        .join(counts, "node", "left")
        .join(classes, "node", "left")
        .select(
            "node",
            "key",
            F.coalesce("root", "node").alias("class_node"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    known = stored(known, "known")
    names = known.groupBy("class_node").agg(F.min("key").alias("class_id"))
    known = known.drop("key").join(names, "class_node")
    return rows.select("key", "node").join(known, "node")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents")).select(
        F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "class_id", "n_links"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest id, or any without one."""
    found = linked(docs)
    docs, back = set_aside(docs, ["doc_id", "text"])
    keep = found.groupBy("class_node").agg(F.min(F.struct(F.when(F.col("key") == NO_ID, F.lit(1)).otherwise(0).alias("bare"), "key", "node")).alias("best")).select("best.key", "best.node")
    keep = stored(keep, "kept")
    schema = docs.schema

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in slices(batch, "text"):
                row, run = shingles(texts_of(cut, "text"))
                own, _ = nodes_of(row, run, cut.num_rows)
                yield pa.RecordBatch.from_arrays([*cut.columns, pa.array(own, pa.binary())], [*schema.names, "_node"])

    marked = docs.mapInArrow(mark, docs.limit(0).withColumn("_node", F.lit(b"")).schema)
    marked = marked.withColumn("_key", F.coalesce("doc_id", F.lit(NO_ID)))
    chosen = keep.select(F.col("key").alias("_key"), F.col("node").alias("_node"))
    return back(marked.join(chosen, ["_key", "_node"]).dropDuplicates(["_key", "_node"]))
