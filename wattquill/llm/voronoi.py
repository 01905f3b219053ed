"""Exact top-k search by inner product: a Voronoi kNN join.

Pivots cut the data into cells: each vector belongs to its nearest pivot, and each cell is summed up
by its radius around the pivot. A query is first answered within its own cell; the k-th score found
there is a floor. For every other cell pivot, radius and the query's length bound each score from
above (q.x <= q.p + |q| radius), so the query goes only to the cells whose bound reaches its floor.
Large cells are cut into slices of bounded size, whatever they hold; a vector is shuffled once per
step, and queries are what is copied. A task holds one slice, past which its queries stream. Scores
are inner products of integers, computed exactly.

Pivots are vectors of the data, those with the smallest hashes: a quarter of the square root of their
number, at least `PIVOTS` and at most `MOST_PIVOTS`, so that cells grow more slowly than the data.

Defined cases: vectors that are null or empty or have null or non-finite components (doubles also
those whose 256-fold is not finite) and rows with a null id take no part; all others do, whatever
their size. A score that 64 bits can't hold counts as the nearest number that they can. Vectors of other
lengths are compared as if filled with zeros. Rows that repeat an id stay candidates of others, each
by itself, but not of their own id; as queries they are one, the one with the smallest vector. Ties go
to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattquill.llm.common import stored, table

SCALE = 256
NEAREST = 5
EVERY = 50
PIVOTS = 48
MOST_PIVOTS = 4096
SLICE_ROWS = 4000
EXACT = 2.0**53
LEAST_LONG, MOST_LONG = -(2**63), 2**63 - 1
QUERY_ROWS = 256


def scaled(table_: DataFrame) -> DataFrame:
    """vec_id and v: floor(256 x) of each component, of the vectors that take part."""
    x = F.col("embedding")

    def whole(c: F.Column) -> F.Column:
        # from 2^53 on doubles are whole numbers, and `floor` gives a long
        y = c.cast("double") * SCALE
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    v = F.transform(x, whole)
    fine = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double") * SCALE) < float("inf")))
    return table_.filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(fine, F.lit(False))).select(
        "vec_id", v.alias("v")
    )


def matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def with_cell(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot (`cell`), distance to it, and length of each vector; of equally near pivots
    the first."""
    width = pivots.shape[1]
    half = (pivots**2).sum(axis=1) / 2

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("v")
            longest = max(width, max(len(r) for r in column))
            x = matrix(column.to_pylist(), longest)
            p = np.zeros((len(pivots), longest))
            p[:, :width] = pivots
            cell = (x @ p.T - half).argmax(axis=1)
            far = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], ["vec_id", "v", "cell", "far"]
            )

    return vectors.mapInArrow(nearest, "vec_id long, v array<double>, cell int, far double")


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products within 64 bits: in doubles where no sum can leave their exact range, in
    integers where none can leave 64 bits, else in integers of any size."""
    width = max(q.shape[1], 1)
    most_q, most_x = np.abs(q).max(axis=1, initial=0), np.abs(x).max(axis=1, initial=0)
    if most_q.max(initial=0) * most_x.max(initial=0) * width < EXACT:
        return (q @ x.T).astype(np.int64)
    out = np.zeros((len(q), len(x)), np.int64)
    small = np.sqrt(EXACT / width) * (1 - 1e-9)
    for rows in (np.flatnonzero(most_q < small), np.flatnonzero(most_q >= small)):
        for columns in (np.flatnonzero(most_x < small), np.flatnonzero(most_x >= small)):
            if not len(rows) or not len(columns):
                continue
            a, b = q[rows], x[columns]
            most = most_q[rows].max() * most_x[columns].max() * width
            if most < EXACT:
                score = (a @ b.T).astype(np.int64)
            elif most < 2.0**62 and max(most_q[rows].max(), most_x[columns].max()) < 2.0**62:
                score = a.astype(np.int64) @ b.astype(np.int64).T
            else:
                whole = np.frompyfunc(int, 1, 1)
                score = np.clip(whole(a) @ whole(b).T, LEAST_LONG, MOST_LONG).astype(np.int64)
            out[np.ix_(rows, columns)] = score
    return out


def best_of(k: int):
    """The k best candidates of each slice for each query that came to it. Rows come by cell and slice,
    candidates (by id) before queries."""
    names = ["query_id", "vec_id", "score"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_, ids, vectors, copies = None, [], [], {}
        data: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            where = np.stack([batch.column(n).to_numpy() for n in ("cell", "slice", "asks")])
            cuts = np.r_[0, np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1, batch.num_rows]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                cell, number, asks = where[:, a].tolist()
                if (cell, number) != slice_:
                    slice_, ids, vectors, copies, data = (cell, number), [], [], {}, None
                if not asks:
                    for i, v in zip(part.column("id").to_pylist(), part.column("v").to_pylist(), strict=True):
                        if ids and ids[-1] != i:
                            copies = {}
                        # of rows that are all the same no more than k can be among the best
                        at = np.array(v).tobytes()
                        copies[at] = copies.get(at, 0) + 1
                        if copies[at] <= k:
                            ids.append(i)
                            vectors.append(v)
                    continue
                if not ids:
                    continue
                if data is None:
                    data = np.array(ids, np.int64), matrix(vectors, max(map(len, vectors)))
                for start in range(0, part.num_rows, QUERY_ROWS):
                    some = part.slice(start, QUERY_ROWS)
                    yield answers(some.column("id").to_numpy(), some.column("v").to_pylist(), *data)

    def answers(queries: np.ndarray, rows: list, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        width = max(x.shape[1], max(map(len, rows)))
        wide = np.pad(x, ((0, 0), (0, width - x.shape[1])))
        out: list[list[np.ndarray]] = [[], [], []]
        for row, query in zip(exact_products(matrix(rows, width), wide), queries, strict=True):
            at = np.flatnonzero(ids != query)
            if len(at) > k:
                least = np.partition(row[at], len(at) - k)[len(at) - k]
                at = at[row[at] >= least]
            # ids ascend, and the complement of a long turns the order without leaving 64 bits
            at = at[np.argsort(~row[at], kind="stable")][:k]
            for column, values in zip(out, (np.full(len(at), query), ids[at], row[at]), strict=True):
                column.append(values)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names)

    return search


def top_k(vectors: DataFrame, is_query, k: int = NEAREST, pivots: int | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query in `scaled` vectors."""
    spark = vectors.sparkSession
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(PIVOTS, math.isqrt(vectors.count()) // 4))
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).collect()
    schema = "query_id long, rank int, vec_id long, score long"
    if not chosen:
        return spark.createDataFrame([], schema)
    width = max(len(r["v"]) for r in chosen)
    points = np.unique(matrix([r["v"] for r in chosen], width), axis=0)
    data = stored(with_cell(vectors, points), "cells")
    summary = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()
    slices = {r["cell"]: max(1, -(-r["n"] // slice_rows)) for r in summary}
    radius = {r["cell"]: r["radius"] for r in summary}
    # a row for each of at most `MOST_PIVOTS` cells
    counts = spark.createDataFrame(sorted(slices.items()), "cell int, slices long")
    data = data.join(F.broadcast(counts), "cell").withColumn(
        "slice", F.pmod(F.xxhash64("vec_id", "v"), F.col("slices")).cast("int")
    )
    queries = (
        data.filter(is_query)
        .groupBy("vec_id")
        .agg(F.min(F.struct("v", "cell")).alias("q"))
        .select(F.col("vec_id").alias("query_id"), "q.v", "q.cell")
    )
    filled = np.array(sorted(slices), np.int64)
    spread = np.array([slices[c] for c in filled.tolist()], np.int64)
    radii = np.array([radius[c] for c in filled.tolist()])
    centre = points[filled]
    length = np.sqrt((centre**2).sum(axis=1))

    def send(own: bool):
        """Slices that a query goes to: all of its own cell, or all other cells that may matter."""

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = batch.column("v").to_pylist()
                cells = batch.column("cell").to_numpy()
                query, cell, part = [], [], []
                floor = None if own else batch.column("floor").to_pylist()
                for r, v in enumerate(rows):
                    if own:
                        go = filled == cells[r]
                    else:
                        q = np.zeros(max(width, len(v)))
                        q[: len(v)] = v
                        own_length = np.sqrt(q @ q)
                        # rounding is far below a billionth of the largest terms
                        bound = centre @ q[:width] + own_length * (radii + 1e-9 * (length + radii)) + 1e-3
                        least = -np.inf if floor[r] is None else floor[r] - 1e-9 * abs(floor[r])
                        # beyond 64 bits scores are tied
                        go = (np.minimum(bound, MOST_LONG) >= least) & (filled != cells[r])
                    for c, n in zip(filled[go].tolist(), spread[go].tolist(), strict=True):
                        query += [r] * n
                        cell += [c] * n
                        part += range(n)
                at = pa.array(query, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(at), batch.column("v").take(at), pa.array(cell, pa.int32()), pa.array(part, pa.int32())],
                    ["query_id", "v", "cell", "slice"],
                )

        return route

    def answered(sent: DataFrame) -> DataFrame:
        keys = ["cell", "slice"]
        rows = data.select(*keys, F.lit(0).alias("asks"), F.col("vec_id").alias("id"), "v").unionByName(
            sent.select(*keys, F.lit(1).alias("asks"), F.col("query_id").alias("id"), "v")
        )
        return (
            rows.repartition(*keys)
            .sortWithinPartitions(*keys, "asks", "id")
            .mapInArrow(best_of(k), "query_id long, vec_id long, score long")
        )

    sent_schema = "query_id long, v array<double>, cell int, slice int"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = stored(answered(queries.mapInArrow(send(True), sent_schema)), "near")
    floors = (
        near.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") == k)
        .select("query_id", F.col("score").alias("floor"))
    )
    further = answered(queries.join(floors, "query_id", "left").mapInArrow(send(False), sent_schema))
    return (
        near.unionByName(further)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op9_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(scaled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % EVERY == 0)


OP9_SQL = """
WITH rows AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL),
parts AS (SELECT r, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM rows),
fine AS (SELECT r, min(vec_id) AS vec_id FROM parts GROUP BY r
         HAVING count(*) = count(x) AND bool_and(isfinite(x::DOUBLE))),
v AS (SELECT p.r, p.vec_id, p.d, floor(p.x::DOUBLE * 256)::BIGINT AS x FROM parts p JOIN fine USING (r)),
scores AS (SELECT q.vec_id AS query_id, c.r, min(c.vec_id) AS vec_id, sum(q.x * c.x)::BIGINT AS score
           FROM v q JOIN v c ON q.d = c.d WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY q.vec_id, c.r)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
WHERE rank <= 5
"""
