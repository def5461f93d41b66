"""Registered queries of the document engine and their DuckDB counterparts.

The driver's tables stand in for document projects: documents are units of the project ``source`` in the order of doc_id,
pages are chapters of the archive named by their host, conversations are small unit lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import compare, links, models, translate
from ..operators import render as R
from ..operators import units as U
from ..operators.stage import shared_path, staged
from . import made

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: White space of JavaScript, for DuckDB's patterns.
_W = r"[\s\x0B\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _query(sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return _QUERIES | made.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | made.oracle_sql()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


def _units(spark: SparkSession, sf_dir: str, text: bool = True, neighbours: bool = False) -> DataFrame:
    """Documents as numbered units: (source, doc_id, markdown, title, pos, unit_id), without ``markdown`` if no text is wanted."""
    rows = _documents(spark, sf_dir, "source", "doc_id", F.col("text").alias("markdown")).withColumn("title", X.derive_title(F.col("markdown")))
    return U.numbered(rows, "source", "doc_id", wide=("markdown",), neighbours=neighbours) if text else U.numbered(rows.drop("markdown"), "source", "doc_id", neighbours=neighbours)


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents with their titles; sums over them need no numbers."""
    return _documents(spark, sf_dir, F.col("text").alias("markdown")).withColumn("title", X.derive_title(F.col("markdown")))


# -- SQL parts --------------------------------------------------------------------------------------------------

def _sql_norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_W}+', ' ', 'g'))"


def _sql_readable(x: str) -> str:
    for pattern, by in ((r"(?s)```.*?```", " "), ("`[^`]*`", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?m)^[ \t]*>[ \t]?", ""), (r"(?m)^[ \t]*[-*+][ \t]+", ""), (r"(?m)^[ \t]*\d+[.)][ \t]+", ""), ("[*_~#>|]", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return _sql_norm(x)


def _sql_plain(x: str) -> str:
    for pattern, by in ((r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), ("`([^`]*)`", r"\1"), ("[*_~]", "")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return _sql_norm(x)


def _sql_first_words(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, ' '), lambda w: w <> '')[1:10], ' ')"


def _sql_title(x: str) -> str:
    heading = _sql_plain(rf"regexp_extract({x}, '(?m)^#{{1,2}}[ \t]+(.+?)[ \t]*#*[ \t]*$', 1)")
    return f"coalesce(nullif({heading}, ''), nullif({_sql_first_words(_sql_readable(x))}, ''), 'Untitled')"


def _sql_slug(x: str) -> str:
    base = rf"regexp_replace(regexp_extract(regexp_replace({x}, '/+$', ''), '([^/]*)$', 1), '(?s)^(.+)\.[^.]*$', '\1')"
    out = f"regexp_replace(regexp_replace(lower(strip_accents({base})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"coalesce(nullif({out}, ''), 'document')"


def _sql_unit(n: str) -> str:
    return f"printf('unit-%03d', {n})"


def _sql_utf16(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10ffff}}]', '', 'g')))"


_SQL_HEADING = rf"""(length(line) between 1 and 100 and (
  regexp_matches(line, '(?i)^({"|".join(X.HEADING_WORDS)})\b') or regexp_matches(line, '^\d+(?:\.\d+)*[.)]?{_W}+[A-Z]')
  or (regexp_matches(line, '[A-Z]') and line = upper(line))))"""
_SQL_LINES = rf"""
  select * from (select doc_id, source, no::int as line_no, {_sql_norm("raw")} as line from (
    select doc_id, source, unnest(string_split_regex(text, '\r?\n')) as raw, generate_subscripts(string_split_regex(text, '\r?\n'), 1) - 1 as no from documents))
  where line <> '' and not regexp_matches(line, '(?i)^--{_W}*\d+{_W}+of{_W}+\d+{_W}*--$')"""
_SQL_UNITS = f"select source, doc_id, text as markdown, {_sql_title('text')} as title, row_number() over (partition by source order by doc_id)::int as pos from documents"
_SQL_HREFS = """select page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1)::int as link_no from pages"""
_SQL_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
_EXTERNAL = "'(?i)^(?:[a-z][a-z0-9+.-]*:|//)'"


def _sql_cost(i: str, o: str, p_in: str, p_out: str) -> str:
    return f"floor((({i}) * {p_in} + ({o}) * {p_out}) / 1000000 * 1e6 + 0.5) / 1e6"


_MODELS_SQL = "(values " + ", ".join(f"('{m[0]}', {m[3]}::double, {m[4]}::double, {i})" for i, m in enumerate(models.MODELS)) + ") as m(model, price_in, price_out, model_order)"


# -- units ------------------------------------------------------------------------------------------------------


@_query(f"""with u as ({_SQL_UNITS})
select source, pos, {_sql_unit("pos")} as unit_id, title, printf('chapters/%03d-%s.md', pos, {_sql_slug("title")}) as path,
  case when pos > 1 then {_sql_unit("pos - 1")} end as prev_id,
  case when lead(pos) over (partition by source order by pos) is not null then {_sql_unit("pos + 1")} end as next_id from u""")
def units_navigation(spark, sf_dir):
    rows = _units(spark, sf_dir, text=False, neighbours=True)
    return rows.select("source", "pos", "unit_id", "title", X.unit_path(F.col("pos"), F.col("title")).alias("path"), "prev_id", "next_id")


@_query(f"select doc_id, {_sql_title('text')} as title, {_sql_first_words(_sql_norm('text'))} as words from documents")
def first_words_title(spark, sf_dir):
    return _documents(spark, sf_dir, "doc_id", X.derive_title(F.col("text")).alias("title"), X.first_words(X.normalize_text(F.col("text"))).alias("words"))


@_query(f"select page_id, {_sql_slug('url')} as slug from pages")
def slug_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.slug(F.col("url")).alias("slug"))


@_query(f"with l as ({_SQL_LINES}) select doc_id, line_no, line from l where {_SQL_HEADING}")
def heading_lines(spark, sf_dir):
    return U.page_lines(_documents(spark, sf_dir, "doc_id", "text")).where("is_heading").select("doc_id", "line_no", "line")


@_query(rf"""with l as ({_SQL_LINES}), h as (select *, {_SQL_HEADING} as hd from l),
s as (select *, sum(hd::int) over (partition by doc_id order by line_no) as section, regexp_replace(line, '([\\`*_\[\]<>])', '\\\1', 'g') as esc from h),
u as (select doc_id, section, max(case when hd then line end) as heading, min(line_no) + 1 as page, count(*) as n_lines,
  string_agg(case when hd then '# ' || esc else esc end, chr(10) || chr(10) order by line_no) as markdown from s group by all)
select doc_id, row_number() over (partition by doc_id order by section)::int as pos, coalesce(heading, 'Document') as title, page::int as page,
  case when bool_or(heading is not null) over (partition by doc_id) then 0.8::double else 0.5::double end as confidence, n_lines, md5(markdown) as markdown_md5 from u""")
def section_split(spark, sf_dir):
    pages = _documents(spark, sf_dir, "doc_id", "text", F.lit(1).alias("page"))
    return U.sections(pages, "doc_id", "page").select("doc_id", "pos", "title", (F.col("line_no") + 1).alias("page"), "confidence", "n_lines", F.md5("markdown").alias("markdown_md5"))


@_query("""with r as (select *, role <> 'system' as body from conversations),
g as (select *, coalesce(sum(body::int) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as run from r)
select conv_id, (run + 1)::bigint as n, max(case when body then turn end) as turn, string_agg(text, chr(10) || chr(10) order by turn) as markdown, string_agg(turn::varchar, ',' order by turn) as paths
from g group by conv_id, run having bool_or(body)""")
def title_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("markdown"), F.col("turn").alias("path"))
    merged = U.merge_title_pages(rows, "conv_id", "turn", F.col("role") != "system")
    return U.numbered(merged, "conv_id", "turn").select("conv_id", F.col("pos").cast("long").alias("n"), "turn", "markdown", F.array_join(F.transform("paths", lambda x: x.cast("string")), ",").alias("paths"))


@_query(f"""with u as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) as old from conversations)
select conv_id, turn, {_sql_unit("old")} as old_id, row_number() over (partition by conv_id order by old)::int as pos,
  {_sql_unit("row_number() over (partition by conv_id order by old)")} as unit_id from u where role <> 'system'""")
def delete_renumber(spark, sf_dir):
    units = U.numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")
    return U.delete_parts(units, F.col("role") == "system", "conv_id").select("conv_id", "turn", "old_id", "pos", "unit_id")


@_query("""with u as (select user_id, ts, event_id from events where event_type = 'signup'), e as (select * from events where event_type <> 'signup'),
f as (select user_id, arg_min(event_id, (ts, event_id)) as first_unit from u group by 1),
a as (select e.event_id, e.user_id, max((u.ts, u.event_id)) filter (where u.event_id is not null) as hit from e left join u on e.user_id = u.user_id and u.ts <= e.ts group by 1, 2)
select a.event_id, a.user_id, coalesce(a.hit[2], f.first_unit) as attached, a.hit is null and f.first_unit is not null as low_confidence from a left join f using (user_id)""")
def asof_image_attach(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    units = events.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("unit"))
    asked = events.where("event_type <> 'signup'").select("event_id", "user_id", "ts")
    return U.attach_backward(asked, units, "user_id", "ts", "ts", "unit").select("event_id", "user_id", "attached", "low_confidence")


# -- comparison -------------------------------------------------------------------------------------------------


@_query("""with n as (select conv_id, turn, role, lag(conv_id) over (partition by turn order by conv_id) as other from conversations),
p as (select distinct conv_id, conv_id - 1 as prev from conversations),
a as (select p.conv_id, c.turn, c.role from p join conversations c on c.conv_id = p.prev), b as (select p.conv_id, c.turn, c.role from p join conversations c on c.conv_id = p.conv_id where p.prev in (select conv_id from conversations)),
d as (select coalesce(a.conv_id, b.conv_id) as conv_id, coalesce(a.turn, b.turn) + 1 as pos, a.role as expected, b.role as actual from a full join b on a.conv_id = b.conv_id and a.turn = b.turn where a.role is distinct from b.role),
r as (select *, row_number() over (partition by conv_id order by pos) as n from d)
select conv_id, n::int as n, pos::int as pos, expected, actual from r where n <= 5""")
def positional_diff(spark, sf_dir):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    convs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(roles.alias("roles"))
    left = convs.select((F.col("conv_id") + 1).alias("conv_id"), "roles").join(convs.select("conv_id"), "conv_id", "left_semi")
    right = convs.join(left.select("conv_id"), "conv_id", "left_semi")
    from pyspark.sql import Window as W

    diff = compare.positional_diff(left, right, ["conv_id"], "roles")
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("pos"))
    return diff.withColumn("n", n).where(F.col("n") <= compare.LISTED).select("conv_id", "n", "pos", "expected", "actual")


@_query(f"""with p as (select u.conv_id, u.turn, u.text as s, a.text as t from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'),
r as (select conv_id, turn, {_sql_utf16("t")}::double / greatest({_sql_utf16("s")}, 1) as ratio from p)
select conv_id, turn, round(ratio, 6) as ratio from r where ratio < 0.4 or ratio > 2.5""")
def length_ratio_warning(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("s"))
    said = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t"))
    both = asked.join(said, ["conv_id", "turn"])
    warned = both.where(compare.length_warning(F.col("s"), F.col("t")).isNotNull())
    return warned.select("conv_id", "turn", F.round(compare.length_ratio(F.col("s"), F.col("t")), 6).alias("ratio"))


# -- links and assets -------------------------------------------------------------------------------------------


@_query(f"select page_id, link_no, href from ({_SQL_HREFS})")
def link_targets(spark, sf_dir):
    return links.html_targets(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "link_no", "href")


@_query(f"""with l as ({_SQL_HREFS}), k as (select distinct regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path from pages)
select page_id, link_no, href from l where not regexp_matches(href, {_EXTERNAL}) and not starts_with(href, '#') and href <> '' and split_part(href, '#', 1) not in (select path from k)""")
def unresolved_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    known = pages.select(F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path")).distinct()
    found = links.html_targets(pages.select("page_id", "html"))
    own = found.where(~X.is_external_href(F.col("href")) & ~F.col("href").startswith("#") & (F.col("href") != ""))
    return own.withColumn("path", F.element_at(F.split("href", "#"), 1)).join(known, "path", "left_anti").select("page_id", "link_no", "href")


@_query(f"""select {_SQL_HOST} as host, count(*) as n_links, count_if(regexp_matches(href, {_EXTERNAL}))::bigint as n_external, round(count_if(regexp_matches(href, {_EXTERNAL}))::double / count(*), 6) as share from ({_SQL_HREFS}) group by 1""")
def external_link_share(spark, sf_dir):
    found = links.html_targets(table(spark, sf_dir, "pages").select(_host(F.col("url")).alias("host"), "html"))
    out = F.count_if(X.is_external_href(F.col("href")))
    return found.groupBy("host").agg(F.count("*").alias("n_links"), out.alias("n_external"), F.round(out / F.count("*"), 6).alias("share"))


@_query(f"""with l as (select page_id, href from ({_SQL_HREFS}) union all select page_id, url from pages)
select page_id, href, href = '' or starts_with(href, '#') or regexp_matches(href, '(?i)^(?:https?:|mailto:)') or starts_with(href, '/read/')
  or (not regexp_matches(href, {_EXTERNAL}) and not list_contains(string_split_regex(href, '[\\\\/]'), '..')) as safe,
  regexp_matches(href, '^(?:\\.\\./)?assets/images/[^/]') and not regexp_matches(href, {_EXTERNAL}) and not list_contains(string_split_regex(href, '[\\\\/]'), '..') as safe_image from l""".replace("\\\\.", "\\."))
def safe_href_audit(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = links.html_targets(pages.select("page_id", "html")).select("page_id", "href").unionByName(pages.select("page_id", F.col("url").alias("href")))
    return found.select("page_id", "href", X.is_safe_href(F.col("href")).alias("safe"), X.is_safe_image_source(F.col("href")).alias("safe_image"))


@_query(f"""select slug, count(*) as n, string_agg(url, ', ' order by url) as members from (select distinct url, {_sql_slug('url')} as slug from pages) group by 1 having count(*) > 1""")
def collision_groups(spark, sf_dir):
    """Pages whose addresses give the same name."""
    rows = table(spark, sf_dir, "pages").select("url").distinct().withColumn("slug", X.slug(F.col("url")))
    return links.collisions(rows, "slug", member="url")


def _assets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages as assets named by their path, and the paths that links of any page refer to."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    assets = pages.select("page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))
    referenced = links.html_targets(pages.select("html")).select(F.concat(F.lit("/en"), F.col("href")).alias("path")).unionByName(assets.where("page_id % 3 = 0").select("path")).distinct()
    return assets, referenced


_SQL_ASSETS = f"""a as (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path from pages),
r as (select '/en' || href as path from ({_SQL_HREFS}) union select path from a where page_id % 3 = 0)"""


@_query(f"with {_SQL_ASSETS} select page_id, path from a where path in (select path from r)")
def asset_semi(spark, sf_dir):
    return links.used_assets(*_assets(spark, sf_dir), keys=("path",)).select("page_id", "path")


@_query(f"with {_SQL_ASSETS} select page_id, path from a where path not in (select path from r)")
def asset_anti(spark, sf_dir):
    return links.unused_assets(*_assets(spark, sf_dir), keys=("path",)).select("page_id", "path")


@_query(f"""select {_SQL_HOST} as document, count(*) as n_units, count(distinct url) as n_urls, count(distinct {_sql_slug("url")}) as n_paths, count(*) = count(distinct url) and count(*) = count(distinct {_sql_slug("url")}) as is_unique from pages group by 1""")
def manifest_uniqueness(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(_host(F.col("url")).alias("document"), "url", X.slug(F.col("url")).alias("path"))
    out = rows.groupBy("document").agg(F.count("*").alias("n_units"), F.count_distinct("url").alias("n_urls"), F.count_distinct("path").alias("n_paths"))
    return out.withColumn("is_unique", (F.col("n_units") == F.col("n_urls")) & (F.col("n_units") == F.col("n_paths")))


@_query(f"""with f as (select {_SQL_HOST} as document, href, min((page_id, link_no)) as first_at from ({_SQL_HREFS}) group by 1, 2)
select document, href, printf('asset-%03d', row_number() over (partition by document order by first_at, href)) as asset_id from f""")
def first_seen_assets(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(_host(F.col("url")).alias("document"), "page_id", "html")
    found = links.html_targets(pages).withColumn("at", F.struct("page_id", "link_no"))
    return links.first_seen_ids(found, "document", "href", "at").select("document", "href", "asset_id")


@_query(f"""with s as (select page_id, {_SQL_HOST} as document, {_sql_slug("split_part(title, ' ', 1)")} as stem from (select *, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as title from pages)),
n as (select *, row_number() over (partition by document, stem order by page_id) as n from s)
select page_id, document, stem || case when n > 1 then '-' || n else '' end || '.png' as file_name from n""")
def asset_file_names(spark, sf_dir):
    title = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", _host(F.col("url")).alias("document"), X.slug(F.element_at(F.split(title, " "), 1)).alias("stem"), F.lit(".png").alias("extension"))
    return links.suffixed_names(rows, "document", "stem", "extension", "page_id").select("page_id", "document", "file_name")


# -- runs -------------------------------------------------------------------------------------------------------

_KEY = f"sha256('gpt-6-luna' || chr(10) || 'fr' || chr(10) || '{models.PROMPT_VERSION}' || chr(10) || text)"


@_query(f"select doc_id, {_KEY} as key from documents")
def cache_key(spark, sf_dir):
    jobs = _documents(spark, sf_dir, "doc_id", F.col("text").alias("markdown"))
    return translate.keyed(jobs, models.DEFAULT_MODEL, "fr").select("doc_id", "key")


def _jobs_and_cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of documents as jobs; the benchmark texts' lines as what an earlier run has stored."""
    lines = lambda df, k: df.select(k, F.explode(F.split("text", "\n")).alias("markdown"))
    jobs = translate.keyed(lines(_documents(spark, sf_dir, "doc_id", "text"), "doc_id"), models.DEFAULT_MODEL, "fr")
    cache = translate.keyed(lines(table(spark, sf_dir, "benchmark"), "item_id"), models.DEFAULT_MODEL, "fr")
    return jobs, cache


_SQL_JOBS = f"""j as (select doc_id, key from (select doc_id, {_KEY.replace("text", "line")} as key from (select doc_id, unnest(string_split(text, chr(10))) as line from documents))),
c as (select {_KEY.replace("text", "line")} as key from (select unnest(string_split(text, chr(10))) as line from benchmark))"""


@_query(f"with {_SQL_JOBS} select doc_id, key from j where key in (select key from c)")
def cache_hits(spark, sf_dir):
    return translate.cache_hits(*_jobs_and_cache(spark, sf_dir)).select("doc_id", "key")


@_query(f"with {_SQL_JOBS} select doc_id, key from j where key not in (select key from c)")
def cache_misses(spark, sf_dir):
    return translate.cache_misses(*_jobs_and_cache(spark, sf_dir)).select("doc_id", "key")


@_query(f"""with j as (select doc_id, {_KEY.replace("text", "line")} as key from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)),
c as (select key, max(segment) as segment, arg_max(item, (segment, item)) as item from (select key, item_id % 3 as segment, item_id as item from (select item_id, {_KEY.replace("text", "line")} as key from (select item_id, unnest(string_split(text, chr(10))) as line from benchmark))
  union all select key, 3, item_id from (select item_id, {_KEY.replace("text", "line")} as key from (select item_id, unnest(string_split(text, chr(10))) as line from benchmark where item_id % 2 = 0))) group by 1)
select doc_id, key, segment::bigint as segment, 'item ' || item || case when segment = 3 then ' again' else '' end as title from j join c using (key)""")
def cache_segments(spark, sf_dir):
    """Lines of documents that a cache of four segments knows: three runs stored a third of the benchmark's lines each, a fourth run some of them again."""
    from ..sources import cache

    lines = lambda df, k: df.select(k, F.explode(F.split("text", "\n")).alias("markdown"))
    jobs = translate.keyed(lines(_documents(spark, sf_dir, "doc_id", "text"), "doc_id"), models.DEFAULT_MODEL, "fr").select("doc_id", "key")
    known = translate.keyed(lines(table(spark, sf_dir, "benchmark"), "item_id"), models.DEFAULT_MODEL, "fr")
    last = known.groupBy("key", (F.col("item_id") % 3).alias("n")).agg(F.max("item_id").alias("item_id"))
    again = known.where("item_id % 2 = 0").groupBy("key").agg(F.max("item_id").alias("item_id"))
    usage = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("no_cache", "cache_read", "output")])
    row = lambda df, suffix: df.select("key", F.lit("unit-001").alias("unit_id"), F.lit("text").alias("markdown"), F.concat(F.lit("item "), F.col("item_id"), F.lit(suffix)).alias("translated_title"), usage.alias("usage"), F.lit(0.0).alias("cost_usd"), F.lit(0).cast("long").alias("duration_ms"), F.lit(models.DEFAULT_MODEL).alias("model"))
    path = shared_path(spark, "cache")
    for n in range(3):
        cache.append(row(last.where(F.col("n") == n), ""), path)
    cache.append(row(again, " again"), path)
    found = cache.newest(cache.read(spark, path), jobs)
    return jobs.join(found.select("key", "segment", F.col("translated_title").alias("title")), "key").select("doc_id", "key", "segment", "title")


_SQL_IN = f"({_sql_utf16('markdown')} + {_sql_utf16('title')} + 200)"
_SYSTEM = len(models.system_prompt("fr", "en"))


@_query(f"""with u as ({_SQL_UNITS}), s as (select count(*) as units, ceil((sum({_SQL_IN}) + {_SYSTEM}) / 4.0)::bigint as input_tokens, sum(ceil({_sql_utf16("markdown")} / 4.0))::bigint as output_tokens from u)
select *, {_sql_cost("input_tokens", "output_tokens", "0.1::double", "0.5::double")} as cost_usd from s""")
def dry_run_estimate(spark, sf_dir):
    return translate.dry_run(_titled(spark, sf_dir), models.DEFAULT_MODEL, "fr", "en")


@_query(f"""with u as ({_SQL_UNITS}), s as (select count(*) as units, sum(ceil({_SQL_IN} / 4.0))::bigint as input_tokens, sum(ceil({_sql_utf16("markdown")} / 4.0))::bigint as output_tokens from u)
select model, units, input_tokens, output_tokens, {_sql_cost("input_tokens", "output_tokens", "price_in", "price_out")} as cost_usd from s cross join {_MODELS_SQL}""")
def benchmark_plan(spark, sf_dir):
    return translate.benchmark_plan(_titled(spark, sf_dir), models.table(spark))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One benchmark row per labelled document: model by doc_id, time by length, cost by estimate, ok by quality."""
    rows = _documents(spark, sf_dir, "doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.withColumn("model_order", F.pmod("doc_id", F.lit(11)).cast("int")).join(models.table(spark), "model_order", "left")
    cost = X.estimate_cost(F.col("n_chars"), F.lit(0), F.col("n_chars"), F.col("price_in"), F.col("price_cached"), F.col("price_out"))
    return rows.select("doc_id", F.coalesce("model", F.lit("other")).alias("model"), (F.col("n_chars") * 3).alias("duration_ms"), F.coalesce(cost, F.lit(0.0)).alias("cost_usd"), (F.col("quality") == 1).alias("ok"))


_SQL_RUNS = f"""r as (select d.doc_id, coalesce(model, 'other') as model, n_chars * 3 as duration_ms, coalesce({_sql_cost("n_chars", "n_chars", "price_in", "price_out")}, 0) as cost_usd, quality = 1 as ok
from documents d join labels using (doc_id) left join {_MODELS_SQL} on m.model_order = d.doc_id % 11)"""


@_query(f"""with {_SQL_RUNS}, n as (select doc_id, model, duration_ms * 2 as duration_ms, cost_usd, ok from r where model in ('gpt-6-luna', 'glm-5.3')), a as (select * from r where model not in (select model from n) union all select * from n)
select a.model, count(*) as units, sum(duration_ms)::bigint as duration_ms, floor(sum(cost_usd) * 1e6 + 0.5) / 1e6 as cost_usd, count_if(not ok)::bigint as failed, coalesce(min(m.model_order), 2147483647)::int as model_order
from a left join {_MODELS_SQL} on m.model = a.model group by 1""")
def benchmark_merge(spark, sf_dir):
    rows = _runs(spark, sf_dir)
    again = rows.where(F.col("model").isin("gpt-6-luna", "glm-5.3"))  # the models that ran again, in twice the time
    new = again.withColumn("duration_ms", F.col("duration_ms") * 2)
    return translate.benchmark_summary(translate.benchmark_merge(rows, new), models.table(spark))


@_query(f"""with {_SQL_RUNS}, a as (select r.*, d.source, case when model in ('gpt-6-luna', 'glm-5.3') then d.lang || ' again' else d.text end as answer from r join documents d using (doc_id))
select model, {_sql_unit("doc_id")} as unit_id, source as unit_title, 'out/' || model || '/' || doc_id || '.md' as path, length(answer)::bigint as chars, md5(answer) as answer_md5, ok, case when model in ('gpt-6-luna', 'glm-5.3') then 2 else 1 end * duration_ms as duration_ms
from a where model not in ('gpt-6-luna', 'glm-5.3') or ok""")
def benchmark_answers(spark, sf_dir):
    """The stored answers after a run of all models and a second one of two models, which replaces theirs; the second has no failed units."""
    from ..operators import answers

    rows = _runs(spark, sf_dir).join(_documents(spark, sf_dir, "doc_id", "source", "lang", "text"), "doc_id")
    units = rows.select(X.unit_id(F.col("doc_id")).alias("unit_id"), F.col("source").alias("unit_title"), F.concat(F.lit("chapters/"), F.col("doc_id"), F.lit(".md")).alias("unit_path"), "model", F.when(F.col("ok"), "translated").otherwise("failed").alias("status"), "duration_ms", "cost_usd", F.lit(None).cast("string").alias("error"), F.col("text").alias("markdown"), "lang")
    path = shared_path(spark, "answers")
    answers.store(answers.of_results(units, "out"), path)
    again = units.where(F.col("model").isin("gpt-6-luna", "glm-5.3") & (F.col("status") == "translated"))
    answers.store(answers.of_results(again.withColumns({"markdown": F.concat("lang", F.lit(" again")), "duration_ms": F.col("duration_ms") * 2}), "out"), path)
    return answers.load(spark, path).select("model", "unit_id", "unit_title", "path", "chars", F.md5("markdown").alias("answer_md5"), "ok", "duration_ms")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result row per document: status by its labels, usage by its length."""
    rows = _documents(spark, sf_dir, "doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "skipped").when(F.col("toxic") == 1, "cached").when(F.col("quality") == 0, "failed").otherwise("translated")
    used = F.when(status == "skipped", 0).otherwise(F.col("n_chars")).cast("long")
    usage = F.struct(used.alias("no_cache"), F.lit(0).cast("long").alias("cache_read"), (used * 2).alias("output"))
    cost = F.when(status.isin("cached", "skipped"), 0.0).otherwise(X.estimate_cost(used, F.lit(0), used * 2, F.lit(0.1), F.lit(0.01), F.lit(0.5)))
    return rows.select("doc_id", "source", status.alias("status"), usage.alias("usage"), (used * 3).alias("duration_ms"), cost.alias("cost_usd"))


_SQL_RESULTS = f"""s as (select d.doc_id, source, n_chars, case when quality is null then 'skipped' when toxic = 1 then 'cached' when quality = 0 then 'failed' else 'translated' end as status from documents d left join labels using (doc_id)),
r as (select *, case when status = 'skipped' then 0 else n_chars end as used from s), q as (select *, case when status in ('cached', 'skipped') then 0 else {_sql_cost("used", "used * 2", "0.1::double", "0.5::double")} end as cost_usd from r)"""


@_query(f"""with {_SQL_RESULTS} select source, count_if(status = 'translated')::bigint as translated, count_if(status = 'cached')::bigint as cached, count_if(status = 'failed')::bigint as failed, count_if(status = 'skipped')::bigint as skipped,
  sum(used)::bigint as input_tokens, sum(used * 2)::bigint as output_tokens, sum(used * 3)::bigint as duration_ms, floor(sum(cost_usd) * 1e6 + 0.5) / 1e6 as cost_usd, coalesce(sum(case when status <> 'cached' then used * 3 end), 0)::bigint as billed_tokens from q group by 1""")
def run_summary(spark, sf_dir):
    return translate.run_summary(_results(spark, sf_dir), "source")


@_query("""with s as (select doc_id, source, n_chars, coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as spent from documents)
select doc_id, source, spent, spent >= 50000 as over from s""")
def budget_gate(spark, sf_dir):
    rows = translate.budget(_documents(spark, sf_dir, "doc_id", "source", "n_chars"), 50_000, "source", "doc_id", "n_chars")
    return rows.select("doc_id", "source", F.col("spent").cast("long").alias("spent"), "over")


@_query(f"""with u as ({_SQL_UNITS}), r as (select doc_id, case when toxic = 1 then 'failed' else 'translated' end as status from labels)
select u.doc_id, u.source, u.pos, coalesce(r.status, 'skipped') as status, case when r.status is null then '{translate.UNSELECTED_REASON}' end as error, case when r.status is null then length(u.markdown) else -1 end::bigint as n_chars from u left join r using (doc_id)""")
def not_selected_fill(spark, sf_dir):
    units = _units(spark, sf_dir).drop("title", "unit_id")
    done = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "failed").otherwise("translated").alias("status"), F.lit("gpt-6-luna").alias("model"), F.lit(None).cast("string").alias("markdown"), F.lit(None).cast("string").alias("error"))
    filled = translate.fill_unselected(units, done, ["doc_id"], "gpt-6-luna")
    return filled.select("doc_id", "source", "pos", "status", "error", F.coalesce(F.length("markdown"), F.lit(-1)).cast("long").alias("n_chars"))


# -- scalars ----------------------------------------------------------------------------------------------------


@_query("select doc_id, lang, case when regexp_matches(lang, '(?i)^(ar|dv|fa|he|ps|ur|yi)(?:-|$)') then 'rtl' else 'ltr' end as direction, case when regexp_matches(lang || '-x', '(?i)^(ar|dv|fa|he|ps|ur|yi|es)(?:-|$)') then 'yes' else 'no' end as listed from documents")
def rtl_direction(spark, sf_dir):
    listed = F.when(F.concat("lang", F.lit("-x")).rlike("(?i)^(" + "|".join((*X.RTL_LANGUAGES, "es")) + ")(?:-|$)"), "yes").otherwise("no")
    return _documents(spark, sf_dir, "doc_id", "lang", X.direction(F.col("lang")).alias("direction"), listed.alias("listed"))


@_query("select doc_id, case split_part(lower(lang), '-', 1) when 'de' then 'German' when 'en' then 'English' when 'es' then 'Spanish' when 'fr' then 'French' else lang end as name from documents")
def language_name(spark, sf_dir):
    return _documents(spark, sf_dir, "doc_id", X.language_name(F.col("lang")).alias("name"))


@_query("""select doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) as escaped_md5 from documents""")
def escape_html(spark, sf_dir):
    return _documents(spark, sf_dir, "doc_id", F.md5(X.escape_html(F.col("text"))).alias("escaped_md5"))


@_query(r"""select doc_id, md5(regexp_replace(text, '([\\`*_\[\]<>])', '\\\1', 'g')) as escaped_md5 from documents""")
def escape_markdown(spark, sf_dir):
    return _documents(spark, sf_dir, "doc_id", F.md5(X.escape_markdown(F.col("text"))).alias("escaped_md5"))


@_query(f"select doc_id, md5({_sql_readable('text')}) as readable_md5, {_sql_utf16('text')}::bigint as utf16 from documents")
def readable_text(spark, sf_dir):
    return _documents(spark, sf_dir, "doc_id", F.md5(X.readable_text(F.col("text"))).alias("readable_md5"), X.utf16_length(F.col("text")).cast("long").alias("utf16"))


# -- output -----------------------------------------------------------------------------------------------------


@_query("select conv_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by turn) as markdown, count(*) as n_units from conversations group by 1")
def document_concat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("markdown"))
    return U.concatenated(rows, "conv_id")


@_query(f"""with u as ({_SQL_UNITS}), i as (select *, '<li><a href="/read/' || {_sql_unit("pos")} || '">' || replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') || '</a></li>' as li from u)
select source, count(*) as n_units, md5('<nav aria-labelledby="document-title"><h1 id="document-title">' || source || '</h1><p>' || count(*) || ' unit' || case when count(*) = 1 then '' else 's' end || '</p><ol>' || string_agg(li, '' order by pos) || '</ol></nav>') as content_md5 from i group by source""")
def index_page(spark, sf_dir):
    pages = R.index_content(_units(spark, sf_dir, text=False), "source", F.col("source"))
    return pages.select("source", "n_units", F.md5("content").alias("content_md5"))


@_query("""with d as (select source, count(*) as n_units, sum(n_chars)::bigint as size from documents group by 1),
w as (select source, count(*) as n, string_agg('- **ambiguous-structure** at page ' || doc_id || ': ' || 'No words.', chr(10) order by doc_id) as lines from documents where n_chars < 60 group by 1)
select source, '# Extraction report' || chr(10) || chr(10) || '- Source: `' || source || '`' || chr(10) || '- Format: `pdf`' || chr(10) || '- Size: ' || size || ' bytes' || chr(10) || '- Markdown units: ' || n_units || chr(10) || '- Images: 0' || chr(10)
  || '- Warnings: ' || coalesce(n, 0) || chr(10) || chr(10) || case when n is null then 'No extraction warnings were recorded.' else '## Warnings' || chr(10) || chr(10) || lines end || chr(10) as report from d left join w using (source)""")
def extraction_report(spark, sf_dir):
    rows = _documents(spark, sf_dir, "source", "doc_id", "n_chars")
    docs = rows.groupBy("source").agg(F.count("*").alias("n_units"), F.sum("n_chars").alias("size")).select("source", F.col("source").alias("path"), F.lit("pdf").alias("format"), "size", "n_units", F.lit(0).alias("n_images"))
    place = F.struct(F.col("source").alias("source_path"), F.col("doc_id").cast("int").alias("page"), F.lit(None).cast("int").alias("spine_index"), F.lit(None).cast("string").alias("selector"))
    warned = rows.where("n_chars < 60").select("source", F.col("doc_id").alias("seq"), F.lit("ambiguous-structure").alias("code"), F.lit("No words.").alias("message"), place.alias("location"))
    return R.extraction_report(docs, warned, "source")


@_query()
def html_to_markdown(spark, sf_dir):
    from ..operators.markdown import html_to_markdown as convert

    return table(spark, sf_dir, "pages").select("page_id", convert("html").alias("markdown"))


@_query()
def sanitize_html(spark, sf_dir):
    from ..operators.markdown import sanitize_html as clean

    return table(spark, sf_dir, "pages").select("page_id", clean("html").alias("html"))


@_query()
def markdown_skeleton(spark, sf_dir):
    from ..operators.markdown import html_to_markdown as convert
    from ..operators.markdown import skeleton

    rows = table(spark, sf_dir, "pages").select("page_id", skeleton(convert("html")).alias("s"))
    return rows.select("page_id", F.posexplode("s.blocks").alias("pos", "b")).select("page_id", "pos", "b.*")


@_query()
def structure_validation(spark, sf_dir):
    """Pages against themselves without bold marks and with every third page's first paragraph gone."""
    from ..operators.markdown import html_to_markdown as convert
    from ..operators.markdown import skeleton

    pages = table(spark, sf_dir, "pages").select("page_id", convert("html").alias("source"))
    pages = pages.withColumn("translated", F.when(F.col("page_id") % 3 == 0, F.regexp_replace("source", r"\n\n[^\n]*$", "")).otherwise(F.replace("source", F.lit("**"), F.lit(""))))
    pairs = pages.withColumns({"source_skeleton": skeleton("source"), "translated_skeleton": skeleton("translated")})
    ids = spark.range(1, 101).select(X.unit_id(F.col("id")).alias("unit"))
    return compare.validate(pairs, ids, ["page_id"])


@_query()
def render_unit_page(spark, sf_dir):
    return R.unit_pages(_units(spark, sf_dir, neighbours=True), "source", F.col("source"), F.lit("en"))


@_query()
def translate_echo(spark, sf_dir):
    """Every project's units through a run of its own, with a budget of its own, by the offline runner: results by status."""
    units = _units(spark, sf_dir).withColumn("path", X.unit_path(F.col("pos"), F.col("title")))
    empty = spark.createDataFrame([], translate.schemas.CACHE)
    run = translate.translate(staged(units.select("source", "unit_id", "pos", "title", "path", "markdown")), empty, shared_path(spark, "ledger"), max_cost=1.0, document="source")
    return translate.run_summary(run.results, "source", "model")
