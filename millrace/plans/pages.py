"""Queries of structured data, anchors and feeds, with their SQL. Pages get blocks of data by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import markdown as K
from millrace.operators import pages as G
from millrace.plans.registry import query
from millrace.sources.tables import table

_NL = "chr(10)"


def _spark(sql: str) -> str:
    return sql.replace("chr(", "char(")


#: Two thirds have JSON-LD (an object, results, an array, broken JSON), half OpenGraph with a repeat, a fifth tables, some embedded state.
_HTML = (
    "html || CASE page_id % 6 WHEN 0 THEN '<script type=\"application/ld+json\">{\"@type\":[\"Article\",\"X\"],\"@id\":\"' || page_id || '\",\"n\":1}</script>' WHEN 1 THEN '<SCRIPT async type=\"application/ld+json\"> {\"results\":[{\"b\":2},{\"b\":2},{\"a\":\"' || page_id || '\"}]} </SCRIPT>'"
    f" WHEN 2 THEN '<script type=\"application/ld+json\">[{{\"@type\":\"Person\",\"t\":\"x' || {_NL} || 'y\"}},{{\"z\":3}}]</script>' WHEN 3 THEN '<script type=\"application/ld+json\">{{\"broken\":</script>' ELSE '' END"
    " || CASE WHEN page_id % 2 = 0 THEN '<meta property=\"og:title\" content=\"first\"><meta name=\"OG:kind\" content=\"k&amp;k\"><meta property=\"og:title\" content=\"t' || page_id || '\"><meta property=\"og:none\" content=\"\">' ELSE '' END"
    " || CASE WHEN page_id % 5 = 0 THEN '<table><tr><td><table><tr></tr></table></td></tr></table><table><tr></tr></table><table></table>' ELSE '' END"
    " || CASE WHEN page_id % 7 = 4 THEN '<script id=\"__NEXT_DATA__\">{\"props\":{\"pageProps\":{\"id\":' || page_id || '}}}</script>' WHEN page_id % 7 = 5 THEN '<script id=__NEXT_DATA__>{\"props\":{\"pageProps\":{}},\"q\":1}</script>' ELSE '' END"
    " || CASE WHEN page_id % 4 = 3 THEN '<script>kit.start({data: [null,{type:\"data\",data:{title:\"a]b\",id:' || page_id || '}},{\"plain\":[1,2,3]}, 7]})</script>' ELSE '' END"
    " || '<a href=\"/root?x=1\">r</a><a class=c href=''rel/' || page_id % 3 || '''>l</a><a href=\"#here\">h</a><a href=\"//other.org/p\">o</a><a href=\"mailto:m\">m</a><area href=\"/no\"><a data-href=\"/no\">n</a>'"
)
_LD = r"'(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>'"
_BODIES = f"list_transform(regexp_extract_all(h, {_LD}, 1), lambda b: trim(b, ' ' || chr(10)))"


def _source(parser: str) -> str:
    return f"{{'_parser': '{parser}', '_source_url': url}}"


@query(rf"""WITH p AS (SELECT page_id, url, {_HTML} AS h FROM pages), c AS (SELECT page_id, url, regexp_replace(h, '<!--.*?-->', '', 'gs') AS h FROM p),
b AS (SELECT page_id, url, TRY_CAST(unnest({_BODIES}) AS JSON) AS v FROM c),
v AS (SELECT page_id, url, unnest(CASE WHEN json_type(v, '$.results') = 'ARRAY' THEN json_extract(v, '$.results[*]') WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE [v] END) AS v FROM b WHERE v IS NOT NULL),
m AS (SELECT page_id, url, unnest(regexp_extract_all(h, '<meta [^>]*>')) AS m, unnest(range(len(regexp_extract_all(h, '<meta [^>]*>')))) AS i FROM c),
g AS (SELECT page_id, url, i, coalesce(nullif(regexp_extract(m, 'property="([^"]*)"', 1), ''), regexp_extract(m, 'name="([^"]*)"', 1)) AS k, replace(regexp_extract(m, 'content="([^"]*)"', 1), '&amp;', '&') AS x FROM m),
o AS (SELECT page_id, url, k, arg_max(x, i) AS x FROM g WHERE starts_with(lower(k), 'og:') AND x <> '' GROUP BY ALL),
r AS (SELECT page_id, url, 'json-ld' AS parser, json_merge_patch({_source('json-ld')}::JSON, v) AS item FROM v
 UNION ALL SELECT page_id, url, 'open-graph', json_merge_patch({_source('open-graph')}::JSON, json_group_object(k, x)) FROM o GROUP BY page_id, url
 UNION ALL SELECT page_id, url, 'html-table', json_merge_patch({_source('html-table')}::JSON, {{'rows': unnest([2, 1])}}::JSON) FROM c WHERE contains(h, '<table><tr><td><table>'))
SELECT DISTINCT page_id, parser, md5(array_to_string(list_sort(list_transform(json_keys(item), lambda k: k || '=' || (item -> ('$."' || k || '"'))::VARCHAR)), ';')) AS item_md5 FROM r""")
def page_data_items(spark, d):
    pages = table(spark, d, "pages").selectExpr("page_id", "url", f"{_spark(_HTML)} AS html")
    found = G.page_items(pages, "page_id").withColumn("v", F.parse_json("item"))
    each = found.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    pairs = F.array_join(F.array_sort(F.collect_list(F.concat("key", F.lit("="), F.to_json("value")))), ";")
    return each.groupBy("page_id", "at", "parser").agg(F.md5(pairs).alias("item_md5")).drop("at")


_MERGED = "CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE [v] END"


@query(rf"""WITH p AS (SELECT page_id, {_HTML} AS h FROM pages),
b AS (SELECT page_id, list_filter(list_transform({_BODIES}, lambda b: TRY_CAST(replace(b, 'x' || {_NL} || 'y', 'x\ny') AS JSON)), lambda v: v IS NOT NULL) AS vs, TRY_CAST(nullif(regexp_extract(h, '(?s)<script id="?__NEXT_DATA__"?>(.*?)</script>', 1), '') AS JSON) AS nx, regexp_extract(h, 'kit\.start\(.*?id:(\d+)', 1) AS kit FROM p),
j AS (SELECT page_id, nx, kit, flatten(list_transform(vs, lambda v: {_MERGED})) AS ld, CASE WHEN nx IS NULL THEN NULL WHEN (nx -> '$.props.pageProps')::VARCHAR <> '{{}}' THEN nx -> '$.props.pageProps' ELSE nx END AS props FROM b)
SELECT page_id, len(ld) AS n_json_ld, (nx IS NOT NULL)::INT AS n_next_data, CASE WHEN kit <> '' THEN 2 ELSE 0 END AS n_sveltekit, CASE WHEN len(ld) > 0 THEN 'jsonld' WHEN nx IS NOT NULL THEN 'next_data' WHEN kit <> '' THEN 'sveltekit' END AS kind,
 CASE WHEN len(ld) > 0 THEN (ld[1] -> 'n')::VARCHAR WHEN nx IS NOT NULL THEN (props -> 'id')::VARCHAR WHEN kit <> '' THEN kit END AS mark,
 CASE WHEN len(ld) > 0 THEN CASE WHEN json_type(ld[1], '$."@type"') = 'ARRAY' THEN ld[1] ->> '$."@type"[0]' ELSE ld[1] ->> '$."@type"' END END AS schema_type, CASE WHEN len(ld) > 0 THEN ld[1] ->> '$."@id"' END AS schema_id FROM j""")
def structured_passes(spark, d):
    pages = table(spark, d, "pages").selectExpr("page_id", f"{_spark(_HTML)} AS html")
    mark = F.coalesce(F.get_json_object("value", "$.n"), F.get_json_object("value", "$.id"))
    return G.structured_pass(pages, "page_id").select("page_id", "n_json_ld", "n_next_data", "n_sveltekit", "kind", mark.alias("mark"), "schema_type", "schema_id")


_ORIGIN, _DIR = "regexp_extract(url, '^[a-z]+://[^/?#]*')", "regexp_replace(regexp_extract(url, '^[^?#]*'), '[^/]*\\z', '')"


@query(rf"""WITH p AS (SELECT page_id, url, {_HTML} AS h FROM pages), t AS (SELECT page_id, url, unnest(regexp_extract_all(h, '<a[ \t\n\r][^>]*>')) AS t FROM p),
l AS (SELECT page_id, url, coalesce(nullif(regexp_extract(t, '\shref="([^"]*)"', 1), ''), regexp_extract(t, '\shref=''([^'']*)''', 1)) AS l FROM t)
SELECT DISTINCT page_id, CASE WHEN regexp_matches(l, '^https?://') THEN l WHEN starts_with(l, '//') THEN regexp_extract(url, '^[a-z]+:') || l WHEN starts_with(l, '/') THEN {_ORIGIN} || l ELSE {_DIR} || l END AS link
FROM l WHERE l <> '' AND NOT starts_with(l, '#') AND NOT starts_with(l, 'mailto:')""")
def page_anchors(spark, d):
    pages = table(spark, d, "pages").selectExpr("page_id", "url", f"{_spark(_HTML)} AS html")
    return pages.select("page_id", F.explode(G.anchors(F.col("url"), F.col("html"))).alias("link"))


#: A feed for each customer: RSS, Atom, JSON or a broken one, with repeats, relative links, missing links and encoded text.
_XML_NAME = "replace(c_name, '#', '&amp;')"
_FEED = (
    "CASE c_custkey % 4 WHEN 0 THEN '<?xml version=\"1.0\"?><rss version=\"2.0\"><channel><link>https://h.io/blog/</link><item><title> ' || " + _XML_NAME + " || ' </title><link>https://h.io/a?id=' || c_custkey || '&amp;utm_source=x</link><description>&lt;b&gt;' || c_mktsegment || '&lt;/b&gt;</description><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item>"
    "<item><title>again</title><link>https://h.io/a?id=' || c_custkey || '#x</link></item><item><title>rel</title><link>p/' || c_nationkey || '</link><guid>g' || c_custkey || '</guid></item><item><title>none</title></item></channel></rss>'"
    " WHEN 1 THEN '<feed xmlns=\"http://www.w3.org/2005/Atom\"><link href=\"https://s.io/\"/><entry><title>' || " + _XML_NAME + " || '</title><link rel=\"self\" href=\"https://no\"/><link rel=\"alternate\" href=\"/e/' || c_custkey || '\"/><summary>s</summary><updated>2024-01-02T03:04:05Z</updated></entry></feed>'"
    " WHEN 2 THEN '{\"items\":[{\"id\":\"https://j.io/' || c_custkey || '\",\"title\":\"\",\"content_text\":\"' || c_name || '\"},{\"id\":\"x\"}]}' ELSE '<rss><channel><item>' || c_name END"
)


@query(rf"""WITH f AS (SELECT c_custkey, c_custkey % 4 AS kind, {_FEED} AS t FROM customer),
r AS (SELECT c_custkey, unnest(regexp_extract_all(t, '(?s)<item>(.*?)</item>', 1)) AS e, unnest(range(len(regexp_extract_all(t, '(?s)<item>(.*?)</item>', 1)))) AS i FROM f WHERE kind = 0),
s AS (SELECT c_custkey, i, regexp_extract(e, '<title>(.*?)</title>', 1) AS title, replace(regexp_extract(e, '<link>(.*?)</link>', 1), '&amp;', '&') AS raw, regexp_extract(e, '<description>(.*?)</description>', 1) AS body, contains(e, 'pubDate') AS dated FROM r),
u AS (SELECT *, CASE WHEN regexp_matches(raw, '^https?:') THEN raw ELSE 'https://h.io/blog/' || raw END AS link, regexp_replace(regexp_replace(raw, '&utm_source=x', ''), '#.*', '') AS identity FROM s WHERE raw <> ''),
k AS (SELECT c_custkey, 'rss' AS format, link, trim(replace(title, '&amp;', '&')) AS title, replace(replace(body, '&lt;', '<'), '&gt;', '>') AS body_html, dated FROM u QUALIFY row_number() OVER (PARTITION BY c_custkey, identity ORDER BY i) = 1)
SELECT c_custkey, format, link, title, body_html, dated, NULL AS fault FROM k
UNION ALL SELECT c_custkey, 'atom', 'https://s.io' || regexp_extract(t, 'rel="alternate" href="([^"]*)"', 1), replace(regexp_extract(t, '<title>(.*?)</title>', 1), '&amp;', '&'), 's', TRUE, NULL FROM f WHERE kind = 1
UNION ALL SELECT c_custkey, 'json', t::JSON ->> '$.items[0].id', NULL, t::JSON ->> '$.items[0].content_text', FALSE, NULL FROM f WHERE kind = 2
UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, FALSE, 'no feed' FROM f WHERE kind = 3""")
def feed_entry_rows(spark, d):
    feeds = table(spark, d, "customer").selectExpr("c_custkey", f"{_FEED} AS text")
    found = G.feed_entries(feeds, "c_custkey")
    return found.select("c_custkey", "format", "link", "title", "body_html", (F.col("published").eqNullSafe(F.lit("2024-01-02 03:04:05").cast("timestamp"))).alias("dated"), "fault")


@query()
def page_markdown(spark, d):
    """Tests hold the Markdown against values written by hand."""
    return K.extracted(table(spark, d, "pages"), "page_id").select("page_id", F.md5("markdown").alias("markdown_md5"), "tier", "words")


#: Candidates of a ladder: parts of a document, of different lengths.
_SCORED, _BODY_TEXT = "CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN substr(text, 1, 100) ELSE substr(text, 1, 900) END", "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END"
_N = rf"len(regexp_extract_all(coalesce({{0}}, ''), '[^\s\x0b\x{{{{85}}}}\x{{{{A0}}}}\x{{{{1680}}}}\x{{{{2000}}}}-\x{{{{200A}}}}\x{{{{2028}}}}\x{{{{2029}}}}\x{{{{202F}}}}\x{{{{205F}}}}\x{{{{3000}}}}]+'))"


@query(f"""WITH c AS (SELECT doc_id, {_SCORED} AS s, {_BODY_TEXT} AS t, doc_id % 2 = 0 AS rooted, strlen(text) * 4 AS size FROM documents WHERE text IS NOT NULL), n AS (SELECT *, {_N.format('s')} AS a, {_N.format('t')} AS b FROM c)
SELECT doc_id, CASE WHEN size >= 5120 AND rooted AND a < 30 AND b > a THEN 'relaxed' WHEN size >= 5120 AND NOT rooted AND a < 200 AND b > 2.0 * a AND b > 50 THEN 'body' ELSE 'scored' END AS tier,
 CASE WHEN size >= 5120 AND ((rooted AND a < 30 AND b > a) OR (NOT rooted AND a < 200 AND b > 2.0 * a AND b > 50)) THEN b ELSE a END AS words FROM n""")
def extraction_ladder(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").selectExpr("doc_id", f"{_SCORED} AS s", f"{_BODY_TEXT} AS t", "doc_id % 2 = 0 AS rooted", "octet_length(text) * 4 AS size")
    found = K.ladder(F.col("s"), F.col("t"), F.col("t"), F.col("size"), F.col("rooted"))
    return docs.select("doc_id", found["tier"].alias("tier"), found["words"].alias("words"))


_SCRIPTED = (
    "html || '<script>fetch(\"/api/v1/items?x=' || page_id % 9 || '\");fetch(`/graphql`);fetch(\"/graphql\");new WebSocket(\"wss://ws.h.io/x\");var a=\"https://API.other.co.uk/v2/y\",b=\"https://nohost/api\",c=\"/static/app.js?api\",d=\"https://schema.org/api\";</script>"
    "<form action=\"rest/x/rest' || page_id % 4 || '\"></form><a href=\"/gateway/' || page_id % 3 || '\">g</a>'"
)


def _sql_text(x: str) -> str:
    return x.replace("'", "''")


_SHAPED = " UNION ALL ".join(
    f"SELECT page_id, url, {k} AS shape, unnest(regexp_extract_all(h, '{_sql_text(pattern)}', 1)) AS v, unnest(range(len(regexp_extract_all(h, '{_sql_text(pattern)}', 1)))) AS i FROM p" for k, (_, pattern) in enumerate(G.ENDPOINT_SHAPES)
)


@query(rf"""WITH p AS (SELECT page_id, url, {_SCRIPTED} AS h FROM pages), r AS ({_SHAPED}),
c AS (SELECT page_id, url, shape, i, regexp_replace(trim(v), '^["''`)(,;]+|["''`)(,;]+\z|\+\z', '', 'g') AS v FROM r),
k AS (SELECT *, lower(v) AS low FROM c WHERE CASE shape WHEN 1 THEN starts_with(v, '/') OR regexp_matches(lower(v), '^(https?|wss?)://') WHEN 4 THEN regexp_matches(lower(v), '^wss?://|graphql|/gql|/api|/v1/|/v2/|/rest|/gateway') ELSE TRUE END),
e AS (SELECT *, CASE WHEN regexp_matches(low, '^wss?://') THEN 'websocket' WHEN contains(low, 'graphql') OR contains(low, '/gql') THEN 'graphql' WHEN regexp_matches(low, '^https?://') THEN 'absolute_url' ELSE 'relative_path' END AS kind FROM k
 WHERE strlen(v) >= 4 AND low NOT IN ('/api', '/api/', '/rest', '/rest/') AND NOT regexp_matches(low, 'schema\.org|w3\.org|example\.(com|org|net)') AND NOT regexp_matches(low, '^[^?]*\.(js|css|png|jpe?g|gif|svg|ico|woff2?|ttf|eot|otf|webp|avif|mp4|webm|mp3|pdf|map)(\?|\z)')),
n AS (SELECT *, CASE WHEN kind = 'websocket' OR regexp_matches(v, '^https?://[^/?#]*/') THEN v WHEN regexp_matches(v, '^https?://') THEN regexp_replace(v, '^(https?://[^/?#]*)', '/') WHEN starts_with(v, '/') THEN {_ORIGIN} || v ELSE {_DIR} || v END AS normalized_url FROM e
 WHERE kind = 'relative_path' OR NOT regexp_matches(v, '^(https?|wss?)://') OR regexp_matches(v, '^(https?|wss?)://([^./:?#]+\.)+[A-Za-z]{{2,}}([/:?#]|\z)'))
SELECT page_id, v AS value, normalized_url, kind, CASE shape WHEN 4 THEN 'html_attribute' ELSE 'inline_script' END AS source, regexp_extract(lower(normalized_url), '^[a-z]+://([^/:?#]*)', 1) NOT IN ('ws.h.io', 'api.other.co.uk') AS first_party FROM n QUALIFY row_number() OVER (PARTITION BY page_id, normalized_url ORDER BY shape, i) = 1""")
def page_endpoints(spark, d):
    pages = table(spark, d, "pages").selectExpr("page_id", "url", f"{_SCRIPTED} AS html")
    return G.endpoints(pages, "page_id").drop("at")
