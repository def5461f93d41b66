"""Running values over ordered rows of documents of any size.

A window over a whole document puts the document into one task.  Here the rows are range-partitioned by (document, order) and
written once; every part holds a stretch of the order, so a document with most of the rows is spread over many parts.
Windows run inside a part only.  What a part hands on (a sum, a last value, its edge rows) is one row per part and document; a
second scan over those few rows gives each part what came before it, which is joined back.

Ties of the order are taken in the order in which the rows are read.  Null documents are a document of their own; null order
values come first.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stage import staged

Values = Mapping[str, Column]


def scan(
    rows: DataFrame, document: str, *order: str, wide: tuple[str, ...] = (), before: Values | None = None, last: Values | None = None, first: Values | None = None, lag: Values | None = None, lead: Values | None = None
) -> DataFrame:
    """``rows`` with one column for each name, in the order of ``order`` within each ``document``:

    ``before``: sum over the rows before this one (0 at the start); ``last``: last value that is not null up to and with this
    row; ``first``: first value of the whole document that is not null; ``lag``, ``lead``: value of the row before or after.

    ``wide`` names columns that are not needed for the order (texts): they are written beside the scan and joined back by row,
    so they take part in no sort.
    """
    kinds = {"before": before or {}, "last": last or {}, "first": first or {}, "lag": lag or {}, "lead": lead or {}}
    exprs = {f"__{kind}_{name}": e for kind, named in kinds.items() for name, e in named.items()}
    own = [c for c in rows.columns if c not in wide]
    # written before the ranges, whose bounds are sampled by a pass of its own: what made the rows is not worked out again
    keyed = staged(rows.withColumns(exprs).withColumn("__row", F.monotonically_increasing_id()))
    behind = keyed.select("__row", *wide)
    keyed = keyed.drop(*wide)
    placed = staged(keyed.repartitionByRange(document, *order, "__row").withColumn("__chunk", F.spark_partition_id()))
    placed = placed.withColumn("__part", F.struct(F.col(document).alias("d"), F.col("__chunk").alias("c")))

    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate((*order, "__row"))])
    w = W.partitionBy("__part").orderBy(*order, "__row")
    parts = W.partitionBy("d").orderBy("c")
    inside, handed, carried = {}, [], {}
    for kind, named in kinds.items():
        for name in named:
            c = f"__{kind}_{name}"
            value, pair = F.col(c), F.struct(at.alias("at"), F.col(c).alias("v"))
            if kind == "before":
                inside[c] = F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1))
                handed.append(F.sum(value).alias(c))
                carried[c] = F.sum(c).over(parts.rowsBetween(W.unboundedPreceding, -1))
            elif kind == "last":
                inside[c] = F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
                handed.append(F.max(F.when(value.isNotNull(), pair))["v"].alias(c))
                carried[c] = F.last(c, ignorenulls=True).over(parts.rowsBetween(W.unboundedPreceding, -1))
            elif kind == "first":
                handed.append(F.min(F.when(value.isNotNull(), pair))["v"].alias(c))
                carried[c] = F.first(c, ignorenulls=True).over(parts.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
            else:
                inside[c] = (F.lag if kind == "lag" else F.lead)(value).over(w)
                handed.append((F.max if kind == "lag" else F.min)(pair)["v"].alias(c))
                carried[c] = (F.lag if kind == "lag" else F.lead)(c).over(parts)
    if lag:
        inside["__head"] = F.lag(F.lit(1)).over(w).isNull()
    if lead:
        inside["__tail"] = F.lead(F.lit(1)).over(w).isNull()
    carry = placed.groupBy("__part").agg(*handed).select("__part", "__part.d", "__part.c", *[c for c in exprs])
    carry = carry.select("__part", *[x.alias(f"{c}_in") for c, x in carried.items()])
    out = placed.withColumns(inside).join(carry, "__part")  # structs with equal fields are equal, null ones too

    def merged(kind: str, c: str) -> Column:
        here, there = F.col(c), F.col(f"{c}_in")
        if kind == "before":
            return F.coalesce(here, F.lit(0)) + F.coalesce(there, F.lit(0))
        if kind == "last":
            return F.coalesce(here, there)
        if kind == "first":
            return there
        return F.when(F.col("__head" if kind == "lag" else "__tail"), there).otherwise(here)

    out = out.select("__row", *own, *[merged(kind, f"__{kind}_{name}").alias(name) for kind, named in kinds.items() for name in named])
    if wide:
        # the narrow side is what is hashed; texts stream past it and are not sorted
        out = behind.join(out.hint("shuffle_hash"), "__row").select(*rows.columns, *[n for named in kinds.values() for n in named])
    return out.drop("__row")
