"""Runs over several documents against runs of each document alone."""

import random
import time

from quire.functions import text as X
from quire.operators import models, translate
from quire.operators.stage import shared_path, staged


def test_documents_run_as_if_alone(spark):
    rows = [(d, f"unit-{i:03d}", i, f"T{i}", f"chapters/{i}.md", t) for d, texts in {
        "a": ["# One\n\nsame words", "[x](/read/unit-003)", "# One\n\nsame words", "long " * 400, "last"],
        "b": ["# One\n\nsame words", "[x](/read/unit-003)", "last"],
        "c": ["known", "[x](/read/unit-004)"],
    }.items() for i, t in enumerate(texts, 1)]
    units = spark.createDataFrame(rows, "source string, unit_id string, pos int, title string, path string, markdown string")
    key = spark.range(1).select(X.cache_key(*[X.F.lit(v) for v in (models.DEFAULT_MODEL, "fr", models.PROMPT_VERSION, "known")])).first()[0]
    cache = spark.createDataFrame([(key, "u", "connu", "C", (1, 2, 3), 0.5, 7, models.DEFAULT_MODEL)], translate.schemas.CACHE)
    pick = lambda df: sorted(tuple(str(r[c]) for c in ("unit_id", "pos", "status", "usage", "cost_usd", "markdown", "translated_title", "error", "warnings")) for r in df.collect())
    limit = 0.0002
    run = translate.translate(units, cache, shared_path(spark, "ledger"), max_cost=limit, document="source")
    for d in "abc":
        alone = translate.translate(units.where(units.source == d).drop("source"), cache, shared_path(spark, "ledger"), max_cost=limit)
        assert pick(run.results.where(f"source = '{d}'")) == pick(alone.results)
    found = {(r.source, r.pos): r.status for r in run.results.collect()}
    assert len(found) == len(rows) and found["a", 5] == "skipped" and found["b", 3] == "translated" and found["c", 1] == "cached"
    # unit-003 exists in b and unit-004 not in c, though a has both
    assert found["b", 2] == "translated" and found["c", 2] == "failed"
    asked = [(r.source, r.key) for r in run.ledger.collect()]
    assert len(asked) == len(set(asked)) and len({k for _, k in asked}) < len(asked)


def test_null_document_is_a_document(spark):
    rows = [(d, f"unit-{i:03d}", i, f"T{i}", f"chapters/{i}.md", f"text {i} of {d}") for d in ("a", None) for i in (1, 2)]
    units = spark.createDataFrame(rows, "source string, unit_id string, pos int, title string, path string, markdown string")
    run = translate.translate(units, spark.createDataFrame([], translate.schemas.CACHE), shared_path(spark, "ledger"), document="source")
    assert sorted((str(r.source), r.pos, r.status, r.markdown) for r in run.results.collect()) == sorted((str(d), i, "translated", t) for d, _, i, _, _, t in rows)


def _moved(spark):
    """Bytes that tasks have shuffled so far."""
    time.sleep(1)
    spark.range(1).count()  # totals are kept as tasks end
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_texts_are_not_shuffled_again_and_again(spark):
    texts = [random.Random(i).randbytes(30_000).hex() for i in range(60)]
    rows = [(f"unit-{i:03d}", i, f"T{i}", f"chapters/{i}.md", t) for i, t in enumerate(texts, 1)]
    units = staged(spark.createDataFrame(rows, "unit_id string, pos int, title string, path string, markdown string"))
    before = _moved(spark)
    run = translate.translate(units, spark.createDataFrame([], translate.schemas.CACHE), shared_path(spark, "ledger"))
    (r,) = translate.run_summary(run.results, "model").collect()
    moved = (_moved(spark) - before) / sum(map(len, texts))
    assert r.translated == 60 and moved < 1.5, moved  # once, to the tasks that may call
