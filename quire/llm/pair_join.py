"""Joins whose keys may be hot: a few keys with a large part of all rows are split off before any shuffle by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of one left row in a task, about.
SALT_ROWS = 256
#: A key with more than one row in so many is hot, so there are fewer hot keys than this, whatever the size of the tables.
HOT_SHARE = 1024


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` by ``keys`` (``how``: inner or left), without the column ``rows``.

    ``right`` has each key once, and in ``rows`` the number of rows that ``left`` has of it.  The hot keys, fewer than
    ``HOT_SHARE`` rows, are broadcast, so their rows stay where they are; the others are shuffled.  Both sides are read
    twice and should be written tables.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    is_hot = F.col(rows) * HOT_SHARE > F.lit(total)
    hot = right.where(is_hot).drop(rows)
    here = left.join(F.broadcast(hot), keys)
    there = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(~is_hot).drop(rows), keys, how)
    return here.unionByName(there)


def with_values(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """``pairs(a, b)`` and ``values(id, value)`` -> (a, b, va, vb).

    A left row with many pairs is copied once for every ``SALT_ROWS`` of them, and its pairs are dealt over the copies.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("rows")).withColumn("salts", F.ceil(F.col("rows") / F.lit(SALT_ROWS)).cast("int"))
    left = values.select(F.col("id").alias("a"), F.col("value").alias("va")).join(counts.drop("rows"), "a")
    left = left.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "va")
    right = hot_join(pairs.select("a", "b"), counts, ["a"], "rows").withColumn("salt", F.pmod(F.xxhash64("b"), "salts").cast("int")).drop("salts")
    right = right.join(values.select(F.col("id").alias("b"), F.col("value").alias("vb")), "b")
    return right.join(left, ["a", "salt"]).select("a", "b", "va", "vb")
