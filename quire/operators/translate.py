"""Transformation runs: jobs, a content-addressed cache, budgets, calls, results, estimates and benchmarks.

Calls cost money, so each distinct key is called once, the ledger of calls is written before anything reads it,
and nothing after the ledger can call again.  Turn speculation off for runs with a live runner.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..errors import ValidationError
from ..functions import text as X
from . import models
from .scan import scan
from .stage import staged

MIN_CONCURRENCY, DEFAULT_CONCURRENCY, MAX_CONCURRENCY = 1, 4, 16
CHARS_PER_TOKEN = 4
UNIT_OVERHEAD = 200
#: Bytes of a row group of the ledger.
LEDGER_GROUP = 16 << 20
LIMIT_REASON = "Skipped because the cost limit was reached"
UNSELECTED_REASON = "Not selected"

#: ``runner(entry, system, user, markdown) -> {text, no_cache, cache_read, output, finish_reason}``
Runner = Callable[[dict, str, str, str], dict]


def echo_runner(entry: dict, system: str, user: str, markdown: str) -> dict:
    """A runner without a network: the text itself, tokens by length."""
    return {"text": markdown, "no_cache": -(-(len(system) + len(user)) // CHARS_PER_TOKEN), "cache_read": 0, "output": -(-len(markdown) // CHARS_PER_TOKEN), "finish_reason": "stop"}


def language_tag(tag: str) -> str:
    """A language tag in lower case; raises for what is no tag."""
    tag = tag.strip()
    if not tag:
        raise ValidationError("--to must be a language tag such as fr or fr-CA")
    if not re.fullmatch(r"[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*", tag):
        raise ValidationError(f"Invalid language tag: {tag}")
    return tag.lower()


def output_name(document: str, language: str) -> str:
    return f"{document}-{language.lower()}"


def check_concurrency(n: int) -> int:
    if not isinstance(n, int) or not MIN_CONCURRENCY <= n <= MAX_CONCURRENCY:
        raise ValidationError(f"--concurrency must be an integer between {MIN_CONCURRENCY} and {MAX_CONCURRENCY}")
    return n


def check_selection(only: list[int] | None, total: int) -> list[int] | None:
    """Distinct unit ordinals, in range; checked in dry runs too."""
    if only is None:
        return None
    for n in only:
        if not isinstance(n, int) or not 1 <= n <= total:
            raise ValidationError(f"Unit number is out of range: {n}")
    return sorted(set(only))


def is_retryable(status: Column, network: Column | None = None) -> Column:
    own = status.isin(408, 409, 425, 429) | (status >= 500)
    return F.coalesce(own if network is None else network | own, F.lit(False))


def with_retry(action: Callable[[], dict], attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> dict:
    """Try again after 200 and 400 ms on network errors and on statuses that may pass."""
    for attempt in range(1, attempts + 1):
        try:
            return action()
        except Exception as error:
            status = getattr(error, "status_code", None)
            passing = isinstance(error, (ConnectionError, TimeoutError)) or status in (408, 409, 425, 429) or (status or 0) >= 500
            if not passing or attempt == attempts:
                raise
            wait(2**attempt * 0.1)
    raise AssertionError("not reached")


def keyed(jobs: DataFrame, model: str, to: str, version: str = models.PROMPT_VERSION) -> DataFrame:
    """``jobs`` with ``key``: SHA-256 of model, language, prompt version and text."""
    return jobs.withColumn("key", X.cache_key(F.lit(model), F.lit(to), F.lit(version), F.col("markdown")))


def cache_hits(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    return jobs.join(cache.select("key").distinct(), "key", "left_semi")


def cache_misses(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    return jobs.join(cache.select("key").distinct(), "key", "left_anti")


def merged_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both caches, one row per key, the new one where both have it."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in old.columns if c not in ("key", "unit_id")]
    best = rows.groupBy("key").agg(F.min(F.struct((-F.col("__new")).alias("n"), "unit_id", *rest)).alias("x"))
    return best.select(*[F.col("key") if c == "key" else F.col(f"x.{c}").alias(c) for c in old.columns])


def budget(jobs: DataFrame, limit: float | None, document: str, order: str, cost: str) -> DataFrame:
    """``spent`` before each job and ``over``: the money spent by then is the limit or more. Hits should cost 0.

    Costs have six places; they are added as decimals, so the sums do not depend on how rows are parted.
    """
    exact = F.col(cost).cast("decimal(20,6)") if jobs.schema[cost].dataType.typeName() in ("double", "float") else F.col(cost)
    out = scan(jobs, document, order, before={"spent": exact}).withColumn("spent", F.col("spent").cast("double"))
    return out.withColumn("over", F.lit(False) if limit is None else F.col("spent") >= limit)


def tokens_in(markdown: Column, title: Column) -> Column:
    return F.ceil((X.utf16_length(markdown) + X.utf16_length(title) + UNIT_OVERHEAD) / CHARS_PER_TOKEN).cast("long")


def tokens_out(markdown: Column) -> Column:
    return F.ceil(X.utf16_length(markdown) / CHARS_PER_TOKEN).cast("long")


def dry_run(jobs: DataFrame, model: str, to: str, source: str) -> DataFrame:
    """(units, input_tokens, output_tokens, cost_usd): the sum of characters is rounded up once, outputs by unit."""
    m = models.find(model)
    system = len(models.system_prompt(language_tag(to), source))
    body = F.coalesce(F.sum(X.utf16_length(F.col("markdown")) + X.utf16_length(F.col("title")) + UNIT_OVERHEAD), F.lit(0))
    out = jobs.agg(F.count("*").alias("units"), F.ceil((body + system) / CHARS_PER_TOKEN).cast("long").alias("input_tokens"), F.coalesce(F.sum(tokens_out(F.col("markdown"))), F.lit(0)).alias("output_tokens"))
    return out.withColumn("cost_usd", X.estimate_cost(F.col("input_tokens"), F.lit(0), F.col("output_tokens"), F.lit(m["price_in"]), F.lit(m["price_cached"]), F.lit(m["price_out"])))


def benchmark_plan(jobs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Tokens and cost of every model over the sample: jobs are summed once, then met by the models.

    The sums do not depend on the model, so models times units rows are never made.
    """
    total = jobs.agg(F.count("*").alias("units"), F.coalesce(F.sum(tokens_in(F.col("markdown"), F.col("title"))), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum(tokens_out(F.col("markdown"))), F.lit(0)).alias("output_tokens"))
    out = chosen.join(F.broadcast(total))  # one row
    return out.select("model", "units", "input_tokens", "output_tokens", X.estimate_cost(F.col("input_tokens"), F.lit(0), F.col("output_tokens"), F.col("price_in"), F.col("price_cached"), F.col("price_out")).alias("cost_usd"))


def benchmark_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of models that are not in the new run, then the new rows."""
    return old.join(new.select("model").distinct(), "model", "left_anti").unionByName(new)


def benchmark_summary(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Per model: units, duration, cost, failures, and its place (unknown models last)."""
    out = rows.groupBy("model").agg(F.count("*").alias("units"), F.sum("duration_ms").alias("duration_ms"), (F.floor(F.sum("cost_usd") * 1e6 + 0.5) / 1e6).alias("cost_usd"), F.count_if(~F.col("ok")).alias("failed"))
    return out.join(known.select("model", "model_order"), "model", "left").withColumn("model_order", F.coalesce("model_order", F.lit(2147483647)))


def benchmark_order(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with the place of their model (unknown models first)."""
    return rows.join(known.select("model", "model_order"), "model", "left").withColumn("model_order", F.coalesce("model_order", F.lit(0)))


def run_summary(results: DataFrame, *by: str) -> DataFrame:
    """Counts by status and sums to six places; ``billed_tokens`` leaves cached results out."""
    six = lambda c: F.floor(F.coalesce(F.sum(c), F.lit(0.0)) * 1e6 + 0.5) / 1e6
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    used = F.col("usage.no_cache") + F.col("usage.cache_read")
    return results.groupBy(*by).agg(*[of(s) for s in ("translated", "cached", "failed", "skipped")], F.coalesce(F.sum(used), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("usage.output"), F.lit(0)).alias("output_tokens"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"), six("cost_usd").alias("cost_usd"), F.coalesce(F.sum(F.when(F.col("status") != "cached", used + F.col("usage.output"))), F.lit(0)).alias("billed_tokens"))


def fill_unselected(units: DataFrame, results: DataFrame, keys: list[str], model: str) -> DataFrame:
    """Every unit with its result; units without one are skipped with their own text, in the units' order."""
    r = results.select(*keys, F.struct(*[c for c in results.columns if c not in keys]).alias("r"))
    out = units.join(r, keys, "left")
    own = {"status": F.lit("skipped"), "model": F.lit(model), "markdown": F.col("markdown"), "error": F.lit(UNSELECTED_REASON)}
    picked = [F.coalesce(F.col(f"r.{n}"), v).alias(n) if n in ("status", "model") else F.when(F.col("r").isNull(), v).otherwise(F.col(f"r.{n}")).alias(n) for n, v in own.items()]
    return out.select(*[c for c in units.columns if c not in own], *picked)


def document_title(results: DataFrame, title: Column) -> Column:
    """The first unit's new title if that unit was translated or cached."""
    return F.when(F.col("status").isin("translated", "cached"), F.coalesce("translated_title", title)).otherwise(title)


def translated_manifest(units: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Units with their new titles where they have one."""
    return units.join(results.select(*keys, "translated_title"), keys, "left").withColumn("title", F.coalesce("translated_title", "title")).drop("translated_title")


@dataclass
class Run:
    """What a run returns: all results (``pos`` has their order), the cache after it, the ledger of calls, and what is new in the cache."""

    results: DataFrame
    cache: DataFrame
    ledger: DataFrame
    new: DataFrame


def call(misses: DataFrame, model: str, to: str, source: str, runner: Runner, concurrency: int, document: str | None = None) -> DataFrame:
    """One call per row of ``misses(key, title, markdown)``: (key, text, no_cache, cache_read, output, finish_reason, duration_ms, call_error, markdown).

    With ``document``, that column of ``misses`` comes first.  The text that was sent stands beside its answer, so that the two need not meet again.
    """
    entry, system = models.find(model), models.system_prompt(to, source)
    keys = [document, "key"] if document else ["key"]

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for *key, title, markdown in zip(*[frame[c] for c in (*keys, "title", "markdown")]):
                begun = time.time()
                try:
                    got = with_retry(lambda: runner(entry, system, models.user_prompt(title, markdown, to, source), markdown))  # noqa: B023
                    rows.append((*key, got["text"], got["no_cache"], got["cache_read"], got["output"], got["finish_reason"], int((time.time() - begun) * 1000), None, markdown))
                except Exception as error:
                    rows.append((*key, None, 0, 0, 0, None, 0, f"Model call failed: {error}", markdown))
            yield pd.DataFrame(rows, columns=[*keys, "text", "no_cache", "cache_read", "output", "finish_reason", "duration_ms", "call_error", "markdown"])

    once = misses.select(*keys, "title", "markdown").repartition(check_concurrency(concurrency))
    kinds = ", ".join(f"`{c}` {once.schema[c].dataType.simpleString()}" for c in keys)
    return once.mapInPandas(run, f"{kinds}, text string, no_cache long, cache_read long, output long, finish_reason string, duration_ms long, call_error string, markdown string")


def translate(units: DataFrame, cache: DataFrame, ledger_path: str, model: str = models.DEFAULT_MODEL, to: str = "fr", source: str = "en", runner: Runner = echo_runner, only: list[int] | None = None, max_cost: float | None = None, concurrency: int = DEFAULT_CONCURRENCY, best_effort: bool = False, document: str | None = None) -> Run:
    """Run one document's units(unit_id, pos, title, path, markdown) through cache, budget, calls and validation.

    The budget is kept on estimated costs in unit order, so it does not depend on timing.  With ``document``, that column of
    ``units`` tells several documents apart: each has its own run and budget from the same cache, as if it ran alone.
    """
    from . import compare
    from .markdown import first_heading, skeleton

    m, to = models.find(model), language_tag(to)
    of = ["__document"] if document else []
    # a document is met as a struct: null ones are a document too, and the column may have any name
    placed = lambda df: df.withColumn("__document", F.struct(F.col(document).alias("id"))) if document else df
    units = placed(units.select(*[document for _ in of], "unit_id", "pos", "title", "path", "markdown"))
    jobs = keyed(units if only is None else units.where(F.col("pos").isin(only)), model, to)
    cache = cache.select(*[f.name for f in schemas.schema(schemas.CACHE).fields])
    est = X.estimate_cost(tokens_in(F.col("markdown"), F.col("title")), F.lit(0), tokens_out(F.col("markdown")), F.lit(m["price_in"]), F.lit(m["price_cached"]), F.lit(m["price_out"]))
    # cache, order and budget see numbers only: one pass over the texts makes them
    narrow = jobs.select(*of, "unit_id", "pos", "key", est.alias("est"), F.lit(1).alias("__one"))
    narrow = staged(narrow.join(cache.where("markdown is not null").select("key", F.lit(True).alias("hit")).distinct(), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False))))
    # the first unit of a key is found by an aggregate and joined by unit, since a key may have very many
    firsts = narrow.groupBy(*of, "key").agg(F.min(F.struct("pos", "unit_id")).alias("x")).select(*of, "x.unit_id", F.lit(True).alias("first"))
    narrow = narrow.join(firsts, [*of, "unit_id"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    narrow = budget(narrow.withColumn("est", F.when(F.col("hit") | ~F.col("first"), 0.0).otherwise(F.col("est"))), max_cost, of[0] if of else "__one", "pos", "est")
    planned = staged(narrow.select(*of, "unit_id", "key", "hit", "first", "over"))
    # the spending never falls, so a key whose first unit is within the budget is asked with that unit's title; written by
    # themselves, the few that a budget lets through are known to be few, and the texts stay where they are
    asked = staged(planned.where(~F.col("hit") & ~F.col("over") & F.col("first")).select(*of, "unit_id", "key"))
    # few tasks may call, many may read what they wrote: hence small row groups
    call(units.join(asked, [*of, "unit_id"]), model, to, source, runner, concurrency, document).write.mode("errorifexists").option("parquet.block.size", LEDGER_GROUP).parquet(ledger_path)
    ledger = units.sparkSession.read.parquet(ledger_path)
    answered = placed(ledger).withColumns({"called": F.col("text").isNotNull(), "answer": X.strip_outer_fence(F.col("text"))})
    # equal keys have equal texts, so an answer is checked once, beside the text that was sent, and not once a unit
    pairs = answered.where("called").select(*of, "key", F.col("markdown").alias("source"), F.col("answer").alias("translated"))
    same = F.col("source") == F.col("translated")  # the same text is parsed once
    both = pairs.withColumns({"source_skeleton": skeleton(F.col("source")), "__other": skeleton(F.when(~same, F.col("translated")))})
    both = both.withColumn("translated_skeleton", F.when(same, F.col("source_skeleton")).otherwise(F.col("__other"))).drop("__other")
    checked = compare.validate(both, units.select(*of, F.col("unit_id").alias("unit")), [*of, "key"])
    answered = answered.select(*of, "key", "called", "answer", first_heading(F.col("answer")).alias("heading"), "no_cache", "cache_read", "output", "finish_reason", "duration_ms", "call_error")
    stored = cache.select("key", F.col("markdown").alias("c_md"), F.col("translated_title").alias("c_title"), F.col("usage").alias("c_usage"))
    rows = planned.join(answered.join(checked, [*of, "key"], "left"), [*of, "key"], "left").join(stored, "key", "left")
    rows = units.join(rows, [*of, "unit_id"], "left")
    cost = X.estimate_cost(F.col("no_cache"), F.col("cache_read"), F.col("output"), F.lit(m["price_in"]), F.lit(m["price_cached"]), F.lit(m["price_out"]))
    cut = F.col("finish_reason") == "length"
    missing = F.col("key").isNull()
    problem = (
        F.when(missing, UNSELECTED_REASON)
        .when(F.col("hit"), F.lit(None))
        .when(F.col("over"), LIMIT_REASON)
        .when(F.col("call_error").isNotNull(), F.col("call_error"))
        .when(cut, f"Model output was truncated at maxOutputTokens={m['max_output_tokens']}")
        .when(~F.col("ok"), F.concat(F.lit("Structure check failed: "), F.array_join(F.transform("issues", lambda x: x["message"]), " ")))
    )
    status = F.when(F.col("hit"), "cached").when(missing | F.col("over"), "skipped").when(problem.isNotNull(), "failed").otherwise("translated")
    billed = F.coalesce(F.col("call_error").isNull() & F.col("called") & ~F.col("hit"), F.lit(False))
    usage = F.struct(*[F.coalesce(F.when(billed, F.col(c)), F.lit(0)).cast("long").alias(c) for c in ("no_cache", "cache_read", "output")])
    best = (status == "failed") & F.lit(best_effort)
    results = rows.select(
        *[document for _ in of], "unit_id", "pos", F.col("title").alias("unit_title"), F.col("path").alias("unit_path"), status.alias("status"), F.lit(model).alias("model"),
        F.when(billed, F.col("duration_ms")).otherwise(0).cast("long").alias("duration_ms"), F.coalesce(F.when(F.col("hit"), F.col("c_usage")), usage).alias("usage"),
        F.when(billed & F.col("first"), cost).otherwise(0.0).alias("cost_usd"), F.when(missing | best, F.col("markdown")).when(F.col("hit"), F.col("c_md")).when(status == "translated", F.col("answer")).alias("markdown"),
        F.when(best, F.col("title")).when(F.col("hit"), F.coalesce("c_title", "title")).when(status == "translated", F.coalesce("heading", "title")).alias("translated_title"),
        problem.alias("error"), F.when(billed & ~cut & F.col("warning").isNotNull(), F.array("warning")).otherwise(F.array().cast("array<string>")).alias("warnings"), "key",
    )
    kept = ("unit_id", "markdown", "translated_title", "usage", "cost_usd", "duration_ms", "model")
    new = results.where("status = 'translated'").groupBy("key").agg(F.min(F.struct(*[document for _ in of], "pos", *kept)).alias("x")).select("key", *[f"x.{c}" for c in kept])
    return Run(results.drop("key"), merged_cache(cache, new), ledger, new)
