"""Connected components of an edge table, by alternating stars; nothing of it reaches the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frameloom.llm.common import written


#: A node with more than this share of all edges' ends, and more than HUB_EDGES, is a hub; there are at most as many hubs as the
#: share's inverse. Up to HUB_EDGES (some MB) a task may well have all edges of a node.
HUB, HUB_EDGES = 1 / 500, 1_000_000
#: Edges a file on average, unless there are fewer files than cores: a small table in very many files costs more than its rows.
FILE_EDGES = 100_000


def _least(edges: DataFrame, ends: int, hub_edges: int) -> DataFrame:
    """The different edges (u, v) with m, the least v of each u. Hubs are met by broadcast, so that no task gets all edges of one."""
    by = Window.partitionBy("u").orderBy("v", F.desc("changed"))

    def met(rows: DataFrame) -> DataFrame:  # a sorted run a node, of which no more than a row is held at a time
        least = F.first("v").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return rows.withColumns({"m": least, "before": F.lag("v").over(by)}).where("before is null or before <> v").drop("before")

    if ends <= hub_edges:
        return met(edges)
    hubs = F.broadcast(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).where(F.col("n") > max(ends * HUB, hub_edges)).select("u", "m"))
    once = edges.join(hubs, "u").groupBy("u", "v", "m").agg(F.max("changed").alias("changed"))
    return once.unionByName(met(edges.join(hubs.select("u"), "u", "left_anti")))


def components(edges: DataFrame, hub_edges: int = HUB_EDGES) -> DataFrame:
    """(node, component) of every node of edges (a, b: long); component is its smallest reachable node.

    Large star and small star in turn until nothing changes: of the order of log squared rounds, of two shuffles each. Each round is
    written to the shared folder, so that a lost executor costs a read.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().withColumn("changed", F.lit(True)), "edges")
    n, changed = e.agg(F.count("*"), F.max("changed")).first()
    while changed:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("changed", F.lit(False))
        large = _least(both, 2 * n, hub_edges).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"), (F.col("m") < F.col("u")).alias("changed"))
        if n > hub_edges:  # which is read several times
            large = written(large, "large")
        # a row gives one: the first of u stays, the others' v hang on the least
        small = _least(large, n, hub_edges).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("changed") | (F.col("v") > F.col("m"))).alias("changed"))
        e = written(small.coalesce(max(cores, -(-n // FILE_EDGES))), "edges")
        n, changed = e.agg(F.count("*"), F.max("changed")).first()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
