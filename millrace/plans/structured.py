"""Queries of structured records and citations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import structured as D
from millrace.plans.registry import query
from millrace.sources.tables import table

_NL = "chr(10)"
_ENDS = r"'^[ \t\r\n]+|[ \t\r\n]+\z', '', 'g'"


def _spark(sql: str) -> str:
    return sql.replace("chr(", "char(")


def _trim(x: str) -> str:
    return f"regexp_replace({x}, {_ENDS})"


#: Small tables of parts with quotes, commas, blank lines, short and long rows.
_CSV = (
    f"'id, name ,\"a \"\"q\"\"\"' || {_NL} || p_partkey || ',\"' || p_name || ', \"\"' || p_brand || '\"\"\"' || chr(13) || {_NL} || ' ' || {_NL} || p_type || {_NL}"
    f" || 'x\"y,z\"w,' || p_size || ',more,\"open, ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN {_NL} ELSE '' END"
)
_CUT = "string_split(array_to_string(list_transform(string_split({0}, '\"'), lambda p, i: CASE WHEN i % 2 = 1 THEN replace(p, ',', chr(30)) ELSE p END), '\"'), chr(30))"
_BARE = "list_transform({0}, lambda f: array_to_string(list_transform(string_split(f, '\"'), lambda p, i: CASE WHEN i % 2 = 1 AND i >= 3 AND i < len(string_split(f, '\"')) AND p = '' THEN '\"' ELSE p END), ''))"


def _fields(line: str) -> str:
    return _BARE.format(_CUT.format(line))


@query(rf"""WITH t AS (SELECT p_partkey, {_CSV} AS t FROM part), l AS (SELECT p_partkey, strlen(t) AS total, unnest(string_split(t, {_NL})) AS line, unnest(range(len(string_split(t, {_NL})))) AS i FROM t),
b AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY p_partkey ORDER BY i) - strlen(line) - 1 AS byte, first_value(line) OVER (PARTITION BY p_partkey ORDER BY i) AS head, regexp_replace(line, '\r+\z', '') AS bare FROM l),
f AS (SELECT *, {_fields('head')} AS h, {_fields('bare')} AS v FROM b WHERE i > 0 AND {_trim('bare')} <> '')
SELECT p_partkey, i - 1 AS csv_row, array_to_string(list_transform(range(1, least(len(h), len(v)) + 1), lambda k: {_trim('h[k]')} || ': ' || {_trim('v[k]')}), {_NL}) AS content, byte::BIGINT AS byte_start, least(byte + strlen(line) + 1, total)::BIGINT AS byte_end FROM f""")
def csv_record_rows(spark, d):
    return D.csv_records(table(spark, d, "part").selectExpr("p_partkey", f"{_spark(_CSV)} AS text"), "p_partkey")


#: A third are the pages themselves, whose tags need not be closed, a third small feeds, a third no XML.
_XML = "CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN '<?xml version=\"1.0\"?><rss a=\"b\">' || url || '<item id=\"1\"><x>' || page_id || '</x><y/>é</item> <!-- c --><e />' || CASE WHEN page_id % 2 = 0 THEN '<open>' ELSE '' END || '<z></z></rss><late></late>' ELSE ' no tags ' || url END"


@query(rf"""WITH t AS (SELECT page_id, {_XML} AS t FROM pages), h AS (SELECT page_id, t, regexp_extract(t, '^(?:<\?xml[^>]*>[^>]*>|[^>]*>)') AS head FROM t),
p AS (SELECT page_id, strlen(head) AS ini, regexp_extract_all(substr(t, length(head) + 1), '[^<]*<[^>]*>') AS ps FROM h WHERE head <> ''),
e AS (SELECT page_id, ini, unnest(ps) AS piece, unnest(range(len(ps))) AS i FROM p), g AS (SELECT *, regexp_replace(piece, '^[^<]*', '') AS tag FROM e),
s AS (SELECT *, CASE WHEN starts_with(tag, '</') THEN -1 WHEN regexp_matches(tag, '/>\z|^<[!?]') THEN 0 ELSE 1 END AS step FROM g),
d AS (SELECT *, sum(step) OVER w AS depth, ini + sum(strlen(piece)) OVER w AS fin FROM s WINDOW w AS (PARTITION BY page_id ORDER BY i)),
k AS (SELECT *, (depth = 1 AND step = 1) OR (depth = 0 AND step = 0) AS starts FROM (SELECT *, min(depth) OVER (PARTITION BY page_id ORDER BY i) AS low FROM d) WHERE low >= 0),
r AS (SELECT *, sum(starts::INT) OVER (PARTITION BY page_id ORDER BY i) AS record FROM k),
x AS (SELECT page_id, record, '/*/' || regexp_extract(max(tag) FILTER (WHERE starts), '^<*/*([^\s>/]*)', 1) AS locator, string_agg(CASE WHEN starts THEN tag ELSE piece END, '' ORDER BY i) AS content,
 max(fin - strlen(tag)) FILTER (WHERE starts) AS byte_start, max(fin) AS byte_end FROM r WHERE record > 0 GROUP BY page_id, record HAVING min(depth) = 0)
SELECT page_id, (record - 1)::BIGINT AS record, locator, md5(content) AS content_md5, NULL AS warning FROM x
UNION ALL SELECT page_id, 0, NULL, md5({_trim('t')}), 'chunk.structured_parse_failed: xml' FROM t WHERE {_trim('t')} <> '' AND page_id NOT IN (SELECT page_id FROM x)""")
def xml_record_rows(spark, d):
    docs = table(spark, d, "pages").selectExpr("page_id", f"{_XML} AS text")
    return D.structured_records(docs, "xml", "page_id").withColumn("content_md5", F.md5("content")).drop("content")


#: Lines of a tool: JSON objects with blank, missing and nested fields, and the turn itself.
_TOOL = (
    "'{\"tool\":\"' || role || '\",\"action\":' || CASE turn % 3 WHEN 0 THEN '\" \"' WHEN 1 THEN '7' ELSE '\"run\"' END || ',\"name\":\"n' || turn || '\",\"side_effect_class\":null,\"output\":{\"output_artifact_id\":\"a' || conv_id || '\"}}'"
    f" || {_NL} || '  ' || {_NL} || ' {{\"artifact_id\":\"' || conv_id || '\",\"output\":{{\"artifact_id\":\"no\"}}}} ' || {_NL} || text || {_NL} || '{{broken'"
)


def _string(*names: str) -> str:
    found = "coalesce(" + ", ".join(f"CASE WHEN json_type(v, '$.{n}') = 'VARCHAR' THEN v ->> '$.{n}' END" for n in names) + ")"
    return f"CASE WHEN {_trim(found)} <> '' THEN {found} END"


@query(rf"""WITH l AS (SELECT conv_id, turn, unnest(string_split(t, {_NL})) AS line, unnest(range(len(string_split(t, {_NL})))) AS i FROM (SELECT conv_id, turn, {_TOOL} AS t FROM conversations)),
c AS (SELECT conv_id, turn, i, {_trim('line')} AS content FROM l), v AS (SELECT *, CASE WHEN starts_with(content, '{{') THEN TRY_CAST(content AS JSON) END AS v FROM c WHERE content <> '')
SELECT conv_id, turn, i + 1 AS line, md5(content) AS content_md5, {_string('tool', 'tool_name')} AS tool_name, {_string('action', 'name')} AS tool_action, {_string('side_effect_class')} AS side_effect_class,
 coalesce({_string('tool_output_artifact_id', 'output_artifact_id', 'artifact_id')}, {_string('output.artifact_id', 'output.output_artifact_id')}) AS artifact_id FROM v""")
def tool_output_lines(spark, d):
    rows = table(spark, d, "conversations").selectExpr("struct(conv_id, turn) AS id", f"{_spark(_TOOL)} AS text")
    found = D.tool_output(rows, "id")
    return found.select("id.conv_id", "id.turn", "line", F.md5("content").alias("content_md5"), "tool_name", "tool_action", "side_effect_class", "artifact_id")


_ITEMS = "CASE event_id % 3 WHEN 0 THEN '[1,' || props || ',[]]' WHEN 1 THEN '{\"a/b\":[1,2],\"c~\":' || props || ',\"t\":\"x\"}' ELSE '{}' END"


@query(f"SELECT event_id, '/' || replace(replace(j.key, '~', '~0'), '/', '~1') AS locator, j.value::VARCHAR AS content FROM (SELECT event_id, {_ITEMS} AS t FROM events) e, json_each(e.t::JSON) j")
def json_item_rows(spark, d):
    """Items of arrays and members of objects; an empty object has none."""
    found = D.structured_records(table(spark, d, "events").selectExpr("event_id", f"{_ITEMS} AS text"), "json", "event_id")
    return found.select("event_id", "locator", "content")


#: Payloads of orders: most are whole, others lack a part or have one of another type, in turn.
_PAYLOAD = (
    "'{\"source_generation\":' || CASE WHEN o_orderkey % 13 = 1 THEN '\"7\"' ELSE '7' END || ',\"job_id\":\"' || CASE WHEN o_orderkey % 13 = 2 THEN 'x' ELSE '00000000-0000-0000-0000-00000000000A' END"
    " || '\",\"redaction_status\":\"' || CASE WHEN o_orderkey % 13 = 3 THEN 'no' ELSE 'clean' END || '\",\"visibility\":\"internal\",\"redaction_version\":\"' || CASE WHEN o_orderkey % 13 = 4 THEN ' ' ELSE 'v' END"
    " || '\",\"redacted_field_count\":0,\"dropped_field_count\":0,\"detector_count\":' || CASE WHEN o_orderkey % 13 = 5 THEN '-1' ELSE '2' END || ',\"detector_names\":' || CASE WHEN o_orderkey % 13 = 6 THEN '\"a\"' ELSE '[\"a\",\"b\"]' END"
    " || CASE WHEN o_orderkey % 13 = 7 THEN '' ELSE ',\"chunk_locator\":{\"canonical_uri\":\"https://h/' || o_custkey || '\",\"range\":{\"line_start\":9,\"line_end\":' || o_custkey % 100 || ',\"yaml_path\":\"y\"}}' END"
    " || CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN ',\"source_range\":{\"line_start\":\"1\"}' WHEN 2 THEN ',\"source_range\":{\"line_start\":1,\"line_end\":null,\"yaml_path\":\" \",\"csv_row\":3}' WHEN 3 THEN ',\"source_range\":[]' ELSE ',\"source_range\":{}' END || '}'"
)


@query(rf"""WITH m AS (SELECT o_orderkey AS point_id, ({_PAYLOAD})::JSON AS p, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'c' END AS chunk_id, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 'k' END AS item, o_orderkey % 13 AS k, o_orderkey % 5 AS r, o_custkey FROM orders),
f AS (SELECT *, CASE WHEN chunk_id IS NULL THEN 'missing_chunk_id' WHEN item IS NULL THEN 'missing_source_item_key' WHEN k = 1 THEN 'missing_source_generation' WHEN k = 2 THEN 'missing_job_id' WHEN k = 3 THEN 'missing_redaction_status' WHEN k = 4 THEN 'missing_redaction_version'
 WHEN k = 5 THEN 'missing_detector_count' WHEN k = 6 THEN 'missing_detector_names' WHEN k = 7 THEN 'missing_canonical_uri' WHEN r IN (1, 3) THEN 'invalid_source_range' END AS fault FROM m)
SELECT point_id, fault, CASE WHEN fault IS NULL THEN p ->> '$.chunk_locator.canonical_uri' END AS canonical_uri, CASE WHEN fault IS NULL THEN coalesce((p ->> '$.source_range.line_start')::BIGINT, (p ->> '$.chunk_locator.range.line_start')::BIGINT) END AS line_start,
 CASE WHEN fault IS NULL THEN coalesce((p ->> '$.source_range.line_end')::BIGINT, (p ->> '$.chunk_locator.range.line_end')::BIGINT) END AS line_end, CASE WHEN fault IS NULL THEN 'y' END AS yaml_path, CASE WHEN fault IS NULL AND r = 2 THEN 3::BIGINT END AS csv_row FROM f""")
def match_citations(spark, d):
    rows = table(spark, d, "orders").selectExpr(
        "o_orderkey AS point_id", "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'c' END AS chunk_id", "'d' AS document_id", "'s' AS source_id", "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 'k' END AS source_item_key", f"parse_json({_PAYLOAD}) AS payload"
    )
    return D.citations(rows).select("point_id", "fault", "canonical_uri", *[F.col(f"anchors.{a}").alias(a) for a in ("line_start", "line_end", "yaml_path", "csv_row")])
