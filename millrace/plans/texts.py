"""Queries of structured records, answer rules and small value rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import records as C
from millrace.plans.registry import query
from millrace.sources.tables import table

_ENDS = r"'^[ \t\r\n]+|[ \t\r\n]+\z'"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, {_ENDS}, '', 'g')"


def _sections(text: str, first: str) -> str:
    cut = rf"string_split(regexp_replace({text}, '(^|\n)({first})', '\1' || chr(30) || '\2', 'g'), chr(30))"
    return f"list_filter(list_transform({cut}, lambda s: {_trim('s')}), lambda s: s <> '')"


@query(r"SELECT page_id, md5(p) AS plain_md5, length(p) AS n_chars FROM (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*\z', ''), '<[^>]*>|>', chr(10), 'g') AS p FROM pages)")
def html_plain_text(spark, d):
    pages = table(spark, d, "pages").withColumn("p", C.html_plain(F.col("html")))
    return pages.select("page_id", F.md5("p").alias("plain_md5"), F.length("p").cast("long").alias("n_chars"))


_YAML = _sections("text", r"[^ \t#\r\n]")
_YAML_PATH = rf"regexp_extract({_trim(r'''regexp_replace(regexp_extract(content, '^[^\n]*'), '^-+', '')''')}, '^[^:]*')"


@query(f"SELECT doc_id, {_trim(_YAML_PATH)} AS path, md5(content) AS content_md5, count(*) AS n FROM (SELECT doc_id, unnest({_YAML}) AS content FROM documents) GROUP BY ALL")
def yaml_record_counts(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(C.yaml_records(F.col("text"))).alias("r"))
    return found.groupBy("doc_id", F.col("r.path").alias("path"), F.md5("r.content").alias("content_md5")).agg(F.count("*").alias("n"))


#: Settings of a customer as TOML.
_TOML = "concat('id = ', c_custkey, chr(10), '[names]', chr(10), 'name = ', c_name, chr(10), '[[segments]]', chr(10), c_mktsegment, chr(10))"


@query(
    "SELECT c_custkey, CASE WHEN starts_with(content, '[') THEN regexp_replace(regexp_extract(content, '^[^\\r\\n]*'), '^[\\[\\]]+|[\\[\\]]+\\z', '', 'g') ELSE 'root' END AS path, content "
    f"FROM (SELECT c_custkey, unnest({_sections(_TOML, chr(92) + '[')}) AS content FROM customer)"
)
def toml_record_rows(spark, d):
    text = table(spark, d, "customer").selectExpr("c_custkey", f"{_TOML.replace('chr(', 'char(')} AS text")
    return text.select("c_custkey", F.inline(C.toml_records(F.col("text"))))


@query("SELECT event_id, '/' || replace(replace(k, '~', '~0'), '/', '~1') AS pointer, props ->> k AS content FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_record_rows(spark, d):
    kept = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "content"))
    return kept.select("event_id", F.concat(F.lit("/"), F.replace(F.replace("k", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))).alias("pointer"), "content")


_LINE = "SELECT doc_id, i, l, sum(length(l) + 1) OVER w AS c, sum(strlen(l) + 1) OVER w AS b FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WINDOW w AS (PARTITION BY doc_id ORDER BY i)"


@query(f"SELECT doc_id, i::BIGINT AS line, (b - strlen(l) - 1)::BIGINT AS byte_start, (b - 1)::BIGINT AS byte_end, (c - length(l) - 1)::BIGINT AS char_start, (c - 1)::BIGINT AS char_end FROM ({_LINE})")
def line_source_ranges(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    w = Window.partitionBy("doc_id").orderBy("i")
    sized = found.select("doc_id", "i", F.length("l").alias("nc"), F.octet_length("l").alias("nb"))
    sized = sized.withColumn("c", F.sum(F.col("nc") + 1).over(w)).withColumn("b", F.sum(F.col("nb") + 1).over(w))
    return sized.selectExpr("doc_id", "cast(i + 1 AS bigint) AS line", "b - nb - 1 AS byte_start", "b - 1 AS byte_end", "c - nc - 1 AS char_start", "c - 1 AS char_end")


#: Paths of parts: each extension and test mark in turn.
_PATH = "concat(CASE p_partkey % 4 WHEN 0 THEN 'src/tests/' WHEN 1 THEN 'test_' WHEN 2 THEN 'src/' ELSE 'a.b/' END, p_partkey, CASE p_partkey % 7 WHEN 0 THEN '.rs' WHEN 1 THEN '.PY' WHEN 2 THEN '.spec.ts' WHEN 3 THEN '' WHEN 4 THEN '.hh' WHEN 5 THEN '.doc' ELSE '_test.go' END)"
_EXT = r"lower(regexp_extract(path, '\.([^./]*)\z', 1))"


@query(
    "SELECT p_partkey, CASE " + " ".join(f"WHEN {_EXT} IN ({', '.join(repr(e) for e in known.split())}) THEN '{name}'" for name, known in C.LANGUAGES.items()) + " ELSE 'unknown' END AS language, "
    "starts_with(lower(path), 'test_') OR " + " OR ".join(f"contains(lower(path), '{p}')" for p in C.TEST_PARTS) + f" AS is_test FROM (SELECT p_partkey, {_PATH} AS path FROM part)"
)
def code_languages(spark, d):
    paths = table(spark, d, "part").selectExpr("p_partkey", f"{_PATH} AS path")
    return paths.select("p_partkey", C.language(F.col("path")).alias("language"), C.is_test(F.col("path")).alias("is_test"))


#: Addresses of endpoints, of each kind.
_VALUE = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN concat('WSS://h/', page_id) WHEN 2 THEN '/api/gql' WHEN 3 THEN concat(url, '/GraphQL') ELSE '/v1/items' END"


@query(f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(v), '^wss?://') THEN 'websocket' WHEN contains(lower(v), 'graphql') OR contains(lower(v), '/gql') THEN 'graphql' WHEN regexp_matches(lower(v), '^https?://') THEN 'absolute_url' ELSE 'relative_path' END AS kind FROM (SELECT {_VALUE} AS v FROM pages)) GROUP BY kind")
def endpoint_kinds(spark, d):
    values = table(spark, d, "pages").selectExpr(f"{_VALUE} AS v")
    return values.groupBy(C.endpoint_kind(F.col("v")).alias("kind")).agg(F.count("*").alias("n"))


_KEPT = "array_to_string(list_filter(string_split(regexp_extract(bare, '\\?([\\s\\S]*)\\z', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(regexp_extract(p, '^[^=]*')), 'utm_') AND lower(regexp_extract(p, '^[^=]*')) NOT IN ('gclid', 'fbclid', 'mc_cid', 'mc_eid', 'igshid', 'ref')), '&')"
_LINKS = "(SELECT page_id, regexp_replace(url, '#[\\s\\S]*\\z', '') AS bare FROM pages)"


@query(f"SELECT identity, min(page_id) AS first_page, count(*) AS n FROM (SELECT page_id, regexp_replace(bare, '\\?[\\s\\S]*\\z', '') || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS identity FROM (SELECT page_id, bare, {_KEPT} AS kept FROM {_LINKS})) GROUP BY identity")
def feed_links_first_wins(spark, d):
    pages = table(spark, d, "pages").select("page_id", C.link_identity(F.col("url")).alias("identity"))
    return pages.groupBy("identity").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


#: Answers with a list of sources, with prose before JSON, or within a fence.
_ANSWER = "CASE turn % 4 WHEN 0 THEN concat(text, chr(10), '## SOURCES', chr(10), '- [S1] a') WHEN 1 THEN concat('Here: {\"t\": ', turn, '} ') WHEN 2 THEN concat('```json', chr(10), '[', turn, ']', chr(10), '```') ELSE concat('RAG: about ', turn, '.5 of 10') END"
_BODY = _trim("answer")
_FENCED = rf"regexp_replace(regexp_replace({_BODY}, '^```([^\n]*\n)?', ''), '^([\s\S]*)```[\s\S]*\z', '\1')"


@query(
    rf"SELECT conv_id, turn, md5(regexp_replace(regexp_replace(answer, '(?i)(^|\n)## sources[\s\S]*\z', ''), '[ \t\r\n]+\z', '')) AS answer_md5, "
    rf"TRY_CAST(regexp_extract(CASE WHEN contains(answer, 'RAG:') THEN substr(answer, strpos(answer, 'RAG:') + 4) END, '^[^0-9.]*([0-9.]+)', 1) AS DOUBLE) AS score, "
    rf"md5(CASE WHEN starts_with({_BODY}, '```') THEN {_trim(_FENCED)} WHEN regexp_matches({_BODY}, '[{{\[]') THEN regexp_extract({_BODY}, '[{{\[][\s\S]*\z') ELSE {_BODY} END) AS json_md5, "
    rf"regexp_matches(answer, '^[ \t\r\n]*#[ \t]') AS llms_txt FROM (SELECT conv_id, turn, {_ANSWER} AS answer FROM conversations)"
)
def answer_rules(spark, d):
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{_ANSWER.replace('chr(', 'char(')} AS answer")
    a = F.col("answer")
    return rows.select(
        "conv_id",
        "turn",
        F.md5(C.without_sources_section(a)).alias("answer_md5"),
        C.first_score(a, "RAG:").alias("score"),
        F.md5(C.bare_json(a)).alias("json_md5"),
        C.is_llms_txt(a).alias("llms_txt"),
    )
