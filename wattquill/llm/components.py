"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattquill.llm.common import stored

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b): root is the smallest node of its component.

    Each round points nodes at the smallest node near them; a star is all that is left. The rounds
    grow with the logarithm of the nodes. Nodes of any orderable type; links to oneself don't count.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    links = stored(
        edges.filter("a != b").select(high.alias("u"), low.alias("v")).distinct(), "links"
    )
    seen = None
    for _ in range(MOST_ROUNDS):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(nearest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(smallest, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u != v")
            .distinct()
        )
        links = stored(small, "links")
        state = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")
        ).first()
        if (state["n"], state["s"]) == seen:
            break
        seen = state["n"], state["s"]
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
