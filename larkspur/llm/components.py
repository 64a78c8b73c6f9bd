"""Connected components of an edge table by alternating large-star and small-star steps, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.storage import remove, write


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges ``(u, v)`` with ``u > v``: hooks neighbours to the smallest node around each node."""
    if large:  # all neighbours of a node, the larger ones are hooked
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"))
    hooked = around.join(least, F.col("u") == F.col("c"))
    if large:
        out = hooked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on none: then that is the smallest of its component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    by = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return by.where("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; a component is named by its smallest node.

    Edges with a null end link nothing; loops give a component of one node; repeated edges count once. Each
    round writes its edges to the shared folder and drops those of the round before, so a lost executor
    repeats one round at most. A node with very many edges is pre-aggregated before the shuffle, and the join
    on it is one that Spark splits.
    """
    spark = edges.sparkSession
    kind = edges.schema[u].dataType
    given = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(F.col(u).alias("u"), F.col(v).alias("v"))
    given = spark.read.schema(given.schema).parquet(first := write(given, "links", narrow=True))
    schema = f"u {kind.simpleString()}, v {kind.simpleString()}"
    at = write(given.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", narrow=True)
    for _ in range(max_rounds):
        now = spark.read.schema(schema).parquet(at)
        if _settled(now):
            break
        after = _star(_star(now, True), False)
        new = write(after, "edges", narrow=True)
        remove(spark, at)
        at = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    hooks = spark.read.schema(schema).parquet(at)  # now every node but the smallest hangs on the smallest
    nodes = spark.read.schema(given.schema).parquet(first)
    nodes = nodes.select(F.col("u").alias("node")).unionByName(nodes.select(F.col("v").alias("node"))).distinct()
    return nodes.join(hooks, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))
