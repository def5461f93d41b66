"""The jobs as registered queries: each runs twice into one new folder below ``spark.checkpoint.dir`` and returns what stands there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import publish_units, translation_queue
from quire.operators import models
from quire.operators.stage import shared_path
from quire.plans import catalogue as C


def job1_translation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after two runs; the second finds no new file."""
    # a glob, since the table may be one file and a stream's plain path is a folder
    folder, documents = shared_path(spark, "job1", keep=True), f"{sf_dir.rstrip('/')}/documents.parque[t]"
    for _ in range(2):
        translation_queue.run(spark, documents, f"{folder}/queue", f"{folder}/checkpoint")
    return translation_queue.read_queue(spark, f"{folder}/queue")


def job2_publish_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All units with what the manifests say of their project, after two runs; the second replaces every partition by the same rows."""
    folder, documents = shared_path(spark, "job2", keep=True), f"{sf_dir.rstrip('/')}/documents.parquet"
    for _ in range(2):
        publish_units.run(spark, documents, folder)
    told = publish_units.read_manifests(spark, folder).select("source", F.col("title").alias("project_title"), "language", "direction", "n_units", "n_distinct", F.col("n_chars").alias("project_chars"))
    return publish_units.read_units(spark, folder).join(told, "source")


_MODEL = models.find(models.DEFAULT_MODEL)
_COST = C._sql_cost("input_tokens", "output_tokens", f"{_MODEL['price_in']}::double", f"{_MODEL['price_out']}::double")
_QUEUE_SQL = rf"""with d as (
  select doc_id, coalesce(nullif(lang, ''), 'und') as lang, text as markdown, {C._sql_title("text")} as title from documents where regexp_matches(text, '[^\x20\x09-\x0D]')
), k as (
  select *, {C._KEY.replace("text", "markdown")} as key, ceil({C._SQL_IN} / 4.0)::bigint as input_tokens, ceil({C._sql_utf16("markdown")} / 4.0)::bigint as output_tokens from d
), g as (
  select key, arg_min(doc_id, (doc_id is null, coalesce(doc_id, 0), lang)) as doc_id, arg_min(lang, (doc_id is null, coalesce(doc_id, 0), lang)) as lang, any_value(title) as title, count(*) as n_docs,
    any_value(input_tokens) as input_tokens, any_value(output_tokens) as output_tokens from k group by key
)
select *, {_COST} as cost_usd, 0::int as batch from g"""

_UNITS_SQL = f"""with d as (
  select doc_id, coalesce(nullif(lang, ''), 'und') as lang, coalesce(nullif(source, ''), 'unsorted') as source, {C._sql_title("text")} as title, length(coalesce(text, ''))::bigint as n_chars, md5(coalesce(text, '')) as text_md5 from documents
), u as (
  select *, row_number() over (partition by source order by doc_id nulls first)::int as pos, count(*) over (partition by source) as n_units from d
), l as (
  select source, arg_min(lang, (-n, lang)) as language from (select source, lang, count(*) as n from d group by all) group by 1
), m as (
  select source, arg_min(title, pos) as project_title, count(distinct text_md5) as n_distinct, sum(n_chars)::bigint as project_chars from u group by 1
)
select u.doc_id, u.lang, u.pos, {C._sql_unit("u.pos")} as unit_id, u.title, printf('chapters/%03d-%s.md', u.pos, {C._sql_slug("u.title")}) as path, case when u.pos > 1 then {C._sql_unit("u.pos - 1")} end as prev_id,
  case when u.pos < u.n_units then {C._sql_unit("u.pos + 1")} end as next_id, u.n_chars, u.text_md5, u.source, m.project_title, l.language,
  case when regexp_matches(l.language, '(?i)^(ar|dv|fa|he|ps|ur|yi)(?:-|$)') then 'rtl' else 'ltr' end as direction, u.n_units, m.n_distinct, m.project_chars
from u join l using (source) join m using (source)"""


def queries() -> dict:
    return {f.__name__: f for f in (job1_translation_queue, job2_publish_units)}


def oracle_sql() -> dict[str, str]:
    return {"job1_translation_queue": _QUEUE_SQL, "job2_publish_units": _UNITS_SQL}
