"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Every source is a sequence of blocks of about ``block_chars`` characters, its documents ordered by the md5 of
doc_id and the md5 of the text.
Source s has c of the D slots of a period, c / D its target share.  Block i of a source is released at slot
floor(i * D / c) and due by slot ceil((i + 1) * D / c); in every slot the released block with the earliest deadline is
taken (ties: the source that sorts first).  Since the shares add up to one this meets all deadlines, so at every slot each source
is less than one block from its share.  Releases and deadlines repeat from period to period, so the schedule
of one period gives the slot of every block: slot(i) = (i div c) * D + slot(i mod c).

Targets.  Given weights are met exactly where a period of at most ``MAX_SLOTS`` slots holds whole numbers of all sources: all
decimals of ``DECIMALS`` places that add up to one, and all shares with a common denominator of up to a tenth of ``MAX_SLOTS``.  Other weights, and
the default ones (size to the power ``temperature``), are first rounded to whole slots: c = max(1, round(share * n)), where n is
``resolution``, or as much more (``MAX_SLOTS`` at most) as gives the smallest share a slot; the rounded shares are then the target.

One pass: every document of a source with a weight gets exactly one slot.  When a source ends its later slots stay empty, and
the sources that are left keep their shares of the others.  Reading by (slot, place) gives the mixed order.

The running sums that cut blocks work on chunks of a source, cut by hash ranges, then on the chunks' totals, so a source with a large part of
all rows is spread over many tasks, also if many of its rows have the same doc_id or none.  Per source there is one row of
statistics; it is broadcast while there are at most ``BROADCAST_SOURCES`` sources and joined with salts beyond.

Cases: null source: a source of its own.  Null or empty text: size 0, the document shares a block.  A text longer than a block
starts one block and the next document starts after it.  Null doc_id: ordered as an empty id.  Repeated rows: each is
mixed.  Weights given: sources with weight 0 or without one are left out, weights of unknown sources do not count; negative, infinite
or undefined weights are an error.  Columns of the input keep their names; one named like an added column is replaced.  Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written

BLOCK_CHARS = 20_000
RESOLUTION = 1000
MAX_SLOTS = 20_000
DECIMALS = 4
#: Exponent of the sources' sizes when no weights are given: below 1, small sources count for more.
TEMPERATURE = 0.7
CHUNK_ROWS = 512
BROADCAST_SOURCES = 10_000
_ADDED = ("source_key", "block", "release", "deadline", "slot", "place")


def _schedule() -> Column:
    """The taken source (number) of each slot of a period, from the columns ``counts`` (array) and ``period``."""

    def due(i: Column, c: Column) -> Column:
        return F.ceil((i + 1) * F.col("period") / c).cast("long")

    def step(state: Column, t: Column) -> Column:
        ready = F.array_min(F.transform(F.arrays_zip(state["next"].alias("i"), F.col("counts").alias("c")), lambda x, s: F.when((x["i"] < x["c"]) & (F.floor(x["i"] * F.col("period") / x["c"]) <= t), F.struct(due(x["i"], x["c"]).alias("due"), s.alias("s")))))["s"]
        # an array of one, so that the choice is worked out once and not for every source
        after = lambda r: F.struct(F.transform(state["next"], lambda i, s: F.when(s == r, i + 1).otherwise(i)).alias("next"), F.concat(state["taken"], F.array(r)).alias("taken"))
        return F.transform(F.array(ready), after)[0]

    start = F.struct(F.transform("counts", lambda c: F.lit(0)).alias("next"), F.array().cast("array<int>").alias("taken"))
    return F.aggregate(F.sequence(F.lit(0), F.col("period").cast("int") - 1), start, step, lambda s: s["taken"])


def _counts(resolution: int) -> Column:
    """Slots of each source in a period, from the column ``shares``."""
    n = F.greatest(F.lit(float(resolution)), F.least(F.lit(float(MAX_SLOTS)), F.ceil(1 / F.array_min("shares")).cast("double")))
    return F.transform("shares", lambda w: F.greatest(F.lit(1), F.round(w * n)).cast("long"))


def _exact_counts(resolution: int) -> Column:
    """The same, exactly where some period of the candidates gives every source a whole number of slots; ``total``: sum of the weights."""
    sums = [F.round(F.least(F.col("total"), F.lit(1e5)) * 10**k).cast("int") for k in range(DECIMALS + 1)]
    periods = F.concat(F.sequence(F.lit(1), F.lit(MAX_SLOTS // 10)), F.array(*sums, F.lit(10**DECIMALS)))
    whole = lambda d: F.forall("shares", lambda w: (F.round(w * d) >= 1) & (F.abs(w * d - F.round(w * d)) < 1e-6))
    found = F.filter(periods, lambda d: (d >= 1) & (d <= MAX_SLOTS) & whole(d))
    exact = F.transform(F.slice(found, 1, 1), lambda d: F.transform("shares", lambda w: F.round(w * d).cast("long")))
    return F.coalesce(F.get(exact, F.lit(0)), _counts(resolution))


def plan(stats: DataFrame, weights: dict[str, float] | None = None, resolution: int = RESOLUTION, temperature: float = TEMPERATURE) -> DataFrame:
    """``stats(source_key, size)`` -> (source_key, c, period, slots): the slots of each source in one period, in order."""
    raw = F.pow(F.greatest(F.col("size"), F.lit(1)).cast("double"), F.lit(temperature))
    if weights is not None:
        if any(not 0 <= float(v) < float("inf") for v in weights.values()):
            raise ValueError("weights must be finite and not negative")
        listed = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]) if weights else F.create_map().cast("map<string,double>")
        raw = F.coalesce(listed[F.col("source_key")], F.lit(0.0))
    every = stats.withColumn("w", raw).where("w > 0").agg(F.sort_array(F.collect_list(F.struct("source_key", "w"))).alias("all")).where(F.size("all") > 0)
    every = written(every)  # one row; else its columns would be worked out anew in every step
    total = F.aggregate("all", F.lit(0.0), lambda a, x: a + x["w"])
    both = F.transform(F.array(total), lambda t: F.struct(t.alias("total"), F.transform("all", lambda x: x["w"] / t).alias("shares")))[0]
    every = written(every.select("all", both.alias("both")).select("all", "both.*"))
    every = written(every.withColumn("counts", (_counts if weights is None else _exact_counts)(resolution)))
    every = written(every.withColumn("period", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)))
    every = every.withColumn("taken", _schedule())
    one = every.select("all", "counts", "period", F.posexplode("taken").alias("slot", "s"))
    one = one.groupBy("s", "period").agg(F.sort_array(F.collect_list("slot")).alias("slots"), F.first(F.col("all")[F.col("s")]["source_key"]).alias("source_key"))
    return written(one.select("source_key", F.size("slots").alias("c"), "period", "slots"))


def _attach(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """``rows(source_key, at, ...)`` with the columns of the row of their source."""
    if per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(per_source), "source_key")
    salts = 64
    spread = per_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(salts)).cast("int")).join(spread, ["source_key", "salt"]).drop("salt")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS, resolution: int = RESOLUTION, temperature: float = TEMPERATURE) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` with source_key, block, release, deadline, slot and place (characters of the source before).

    Instead of ``text``, ``docs`` can have ``size`` (its characters) and ``text_md5``.
    """
    docs = docs.drop(*_ADDED)
    names = docs.columns
    size = F.col("size").cast("long") if "text" not in names else F.length("text").cast("long")
    own = F.md5("text") if "text" in names else F.col("text_md5")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    at = F.struct(F.md5(F.concat(text(F.col("doc_id")), F.lit(":"), text(own))).alias("md5"), F.col("doc_id").alias("doc_id"))
    # the columns of the input travel as one struct, so no name of theirs can clash with a name in here
    keyed = docs.select(F.struct(*names).alias("row"), F.coalesce(F.col("source").cast("string"), F.lit("\\N")).alias("source_key"), F.coalesce(size, F.lit(0)).alias("size"), at.alias("at"))
    stats = keyed.groupBy("source_key").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    chunks = F.ceil(F.col("rows") / F.greatest(F.lit(float(CHUNK_ROWS)), F.sqrt(F.col("rows").cast("double")))).cast("long")
    stats = written(stats.withColumn("chunks", chunks))
    slots = plan(stats.select("source_key", "size"), weights, resolution, temperature)
    if weights is not None:  # sources without a share are left out
        keyed = _attach(keyed, slots.select("source_key"))
        stats = stats.join(slots.select("source_key"), "source_key", "left_semi")
    first = F.conv(F.substring("at.md5", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    chunk = F.floor(first * F.col("chunks")).cast("long")
    placed = _attach(keyed, stats.select("source_key", "chunks")).withColumn("chunk", chunk).drop("chunks")
    order = W.partitionBy("source_key", "chunk").orderBy("at.md5", F.col("at.doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("place", F.coalesce(F.sum("size").over(order), F.lit(0)))
    totals = _attach(keyed.select("source_key", "at", "size"), stats.select("source_key", "chunks")).groupBy("source_key", chunk.alias("chunk")).agg(F.sum("size").alias("in_chunk"))
    before = W.partitionBy("source_key").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("source_key", "chunk", F.coalesce(F.sum("in_chunk").over(before), F.lit(0)).alias("before"))
    placed = placed.join(totals, ["source_key", "chunk"]).withColumn("place", F.col("place") + F.col("before")).drop("before", "chunk")
    placed = placed.withColumn("block", F.floor(F.col("place") / block_chars).cast("long"))
    placed = _attach(placed, slots)
    turn, i = F.floor(F.col("block") / F.col("c")).cast("long"), F.pmod("block", F.col("c").cast("long"))
    placed = placed.withColumns({
        "slot": turn * F.col("period") + F.element_at("slots", (i + 1).cast("int")),
        "release": turn * F.col("period") + F.floor(i * F.col("period") / F.col("c")).cast("long"),
        "deadline": turn * F.col("period") + F.ceil((i + 1) * F.col("period") / F.col("c")).cast("long"),
    })
    return placed.select(*[F.col("row")[c].alias(c) for c in names], *_ADDED)


def oracle_sql(table: str = "documents", block_chars: int = BLOCK_CHARS, resolution: int = RESOLUTION, temperature: float = TEMPERATURE) -> str:
    """DuckDB SQL for doc_id and the added columns of ``mix`` with its default weights."""
    return f"""
with recursive d as (
  select doc_id, coalesce(source, '\\N') as source_key, coalesce(length(text), 0)::bigint as size, md5(coalesce(doc_id::varchar, '') || ':' || coalesce(md5(text), '')) as h from {table}
), p as (
  select *, coalesce(sum(size) over (partition by source_key order by h, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::bigint as place from d
), b as (
  select *, (place // {block_chars})::bigint as block from p
), w as (
  select source_key, pow(greatest(sum(size), 1)::double, {temperature}) as w from d group by 1
), c as (
  select source_key, greatest(1, round(w / (select sum(w) from w) * (select greatest({resolution}, least({MAX_SLOTS}, ceil(sum(w) / min(w)))) from w)))::bigint as c, row_number() over (order by source_key) as s from w
), a as (
  select list(c order by s) as counts, sum(c)::bigint as period from c
), edf(t, nexts, s) as (
  select -1::bigint, [0::bigint for x in counts], 0::bigint from a
  union all
  select t + 1, [case when k = got then nexts[k] + 1 else nexts[k] end for k in range(1, len(nexts) + 1)], got
  from (
    select t, nexts, list_min([
        case when nexts[k] < counts[k] and (nexts[k] * period) // counts[k] <= t + 1
             then (((nexts[k] + 1) * period + counts[k] - 1) // counts[k]) * 1000000 + k end
        for k in range(1, len(nexts) + 1)]) % 1000000 as got
    from edf, a where t + 1 < period
  )
), taken as (
  select s, t as slot, row_number() over (partition by s order by t) - 1 as i from edf where t >= 0
)
select b.doc_id, b.source_key, b.block,
  ((b.block // c.c) * a.period + ((b.block % c.c) * a.period) // c.c)::bigint as "release",
  ((b.block // c.c) * a.period + ((b.block % c.c + 1) * a.period + c.c - 1) // c.c)::bigint as deadline,
  ((b.block // c.c) * a.period + taken.slot)::bigint as slot, b.place
from b join c using (source_key) cross join a join taken on taken.s = c.s and taken.i = b.block % c.c
"""
