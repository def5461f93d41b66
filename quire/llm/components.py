"""Union-find grouping as repeated contraction on DataFrames.

Every round each node takes the best-ranked node among itself and its neighbours as parent, and edges move to
the parents.  Ranks are hashes that change every round, so the number of rounds is logarithmic in the size of a
component, whatever its shape.  Nothing but a row count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pair_join import hot_join
from .store import written


def connected(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` long -> ``(node, component)``: one row per node of an edge, component = smallest node reachable.

    Self loops, repeated and reversed edges are allowed; null ends are ignored; no edges give no rows.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    live = written(edges.where("a <> b").distinct())
    maps, level = [], 0
    while not live.isEmpty():
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(level)).alias("r"), F.col(c).alias("v"))  # noqa: E731, B023
        parent = both.groupBy("a").agg(F.least(rank("a"), F.min(rank("b")))["v"].alias("p"))
        parent = written(parent.withColumnRenamed("a", "node"))
        maps.append(parent)
        left = live.join(parent.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a")
        live = left.join(parent.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct()
        live, level = written(live), level + 1
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    roots = maps[0].select("node", F.col("p").alias("root"))
    for parent in maps[1:]:
        step = parent.select(F.col("node").alias("root"), "p")
        roots = roots.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    roots = written(roots)
    least = roots.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("rows"))
    return hot_join(roots, least, ["root"], "rows").select("node", "component")
