"""Queries of differences between snapshots and of secrets in payloads, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import diffs as D
from millrace.operators import payloads as P
from millrace.operators import reports as R
from millrace.plans.registry import query
from millrace.sources.tables import table

#: The later snapshot of a document: a third is as it was, others have words put in their place or added.
_LATER = "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(replace(text, ' de ', ' of '), '. ', concat('.', chr(10))) ELSE text || ' two words' END"
_META = "'{{\"title\":\"' || source || '{0}\",\"language\":\"' || lang || '\",\"author\":{1},\"image\":' || CASE WHEN doc_id % 5 = {1} THEN 'null' ELSE '\"i\"' END || ',\"other\":\"{0}\"}}'"
_OLD_META, _NEW_META = _META.format("", 1), f"CASE WHEN doc_id % 3 = 0 AND doc_id % 5 = 4 THEN {_META.format('', 1)} ELSE {_META.format('!', 2)} END"
_SPACE = r"\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _text_of(meta: str, field: str) -> str:
    return f"CASE WHEN json_type({meta}, '$.{field}') = 'VARCHAR' THEN {meta} ->> '$.{field}' END"


_CHANGES = ", ".join(f"CASE WHEN {_text_of('om', f)} IS DISTINCT FROM {_text_of('nm', f)} THEN '{f}:' || coalesce({_text_of('om', f)}, '-') || '>' || coalesce({_text_of('nm', f)}, '-') END" for f in D.COMPARED)


@query(rf"""WITH p AS (SELECT doc_id, text AS ot, {_LATER} AS nt, ({_OLD_META})::JSON AS om, ({_NEW_META})::JSON AS nm, [doc_id % 10, doc_id % 7, doc_id % 7] AS ol, [doc_id % 10, doc_id % 4, 100] AS nl FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, ot = nt AS equal, array_to_string(list_filter([{_CHANGES}], lambda x: x IS NOT NULL), ';') AS metadata, array_to_string(list_filter(nl, lambda x: NOT list_contains(ol, x)), ',') AS added,
 array_to_string(list_filter(ol, lambda x: NOT list_contains(nl, x)), ',') AS removed, len(regexp_extract_all(nt, '[^{_SPACE}]+')) - len(regexp_extract_all(ot, '[^{_SPACE}]+')) AS word_count_delta FROM p)
SELECT doc_id, CASE WHEN equal AND metadata = '' AND added = '' AND removed = '' THEN 'same' ELSE 'changed' END AS status, metadata, added, removed, word_count_delta::BIGINT AS word_count_delta FROM c""")
def snapshot_changes(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    links = "transform(array({}), x -> named_struct('href', cast(x AS string), 'text', ''))"
    pairs = docs.selectExpr(
        "doc_id",
        "text AS old_text",
        f"{_LATER.replace('chr(', 'char(')} AS new_text",
        f"parse_json({_OLD_META}) AS old_meta",
        f"parse_json({_NEW_META}) AS new_meta",
        f"{links.format('doc_id % 10, doc_id % 7, doc_id % 7')} AS old_links",
        f"{links.format('doc_id % 10, doc_id % 4, 100')} AS new_links",
    )
    said = F.transform("metadata_changes", lambda c: F.concat(c["field"], F.lit(":"), F.coalesce(c["old"], F.lit("-")), F.lit(">"), F.coalesce(c["new"], F.lit("-"))))
    hrefs = lambda c: F.array_join(F.transform(c, lambda x: x["href"]), ",").alias("removed" if c == "links_removed" else "added")
    return D.page_changes(pairs, "doc_id").select("doc_id", "status", F.array_join(said, ";").alias("metadata"), hrefs("links_added"), hrefs("links_removed"), "word_count_delta")


@query()
def snapshot_text_diffs(spark, d):
    """Tests rebuild one text from the other by the diff and hold its length against a longest common subsequence."""
    pairs = table(spark, d, "documents").selectExpr("doc_id", "text AS old", f"{_LATER.replace('chr(', 'char(')} AS new")
    return D.text_diffs(pairs, "doc_id").select("doc_id", F.md5("text_diff").alias("diff_md5"), F.length("text_diff").alias("n_chars"))


#: Payloads of customers: each kind of secret in turn, two levels deep, beside fields that are none.
_PARTS = [
    '"access_token":"abc","b":{"password":{"x":1},"keep":[]}',
    '"path":"/home/u/x","url":"https://h/home/u"',
    '"oauth":["plain","Zq_\' || md5(c_name) || \'"],"other":"Zq_\' || md5(c_name) || \'"',
    '"Cookie":"c","deep":{"Secret":"forbidden, so it stays","id_token":1}',
    '"r":{"status":200,"headers":{},"body":"password=x"},"d":"C:/x"',
    '"note":"Bearer xyz","list":[[{"q":"API_KEY=1"},true],null]',
    '"n":[1,{"page":" <HTML><body>x</body></html>"}],"m":"~/x"',
]
_PAYLOAD = "'{\"title\":\"' || c_name || '\",\"meta\":{' || CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PARTS)) + " END || '},\"chunk_text\":\"see /tmp/x <html></html>\",\"visibility\":\"token=x\",\"k\":' || c_custkey || '}'"
_TREE = f"SELECT c_custkey, j.key AS name, j.type AS kind, j.atom ->> '$' AS value, substr(j.fullkey, 3) AS path, ends_with(j.fullkey, ']') AS item FROM (SELECT c_custkey, ({_PAYLOAD})::JSON AS p FROM customer) t, json_tree(t.p) j"


def _any(x: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{p}')" for p in parts) + ")"


_FORBIDDEN, _SECRET = _any("name", P.FORBIDDEN_NAMES), f"({_any('name', P.SECRET_NAMES)} OR ends_with(lower(name), '_token') OR lower(name) IN ('authorization', 'proxy-authorization'))"
_LOCAL = rf"(NOT regexp_matches(lower(value), '^(?:https?|local-code)://') AND ({_any('value', P.LOCAL_FOLDERS)} OR regexp_matches(value, '^\s*(?:~|\\\\|[A-Za-z]:[\\/])')))"
_MARKED = rf"({_any('value', T.SECRET_FRAGMENTS)} OR regexp_matches(value, '(?m)^[^\S\n]*[A-Z_][A-Z0-9_]*[^\S\n]*=[^\S\n]*\S') OR regexp_matches(value, '(?:^|[^A-Za-z0-9_-])(?:{'|'.join(T.BARE_PREFIXES)})[A-Za-z0-9_-]{{20}}'))"
_SHARE = "(len(list_filter(string_split(value, ''), lambda x: x = c)) / length(value))"
_OPAQUE = rf"(regexp_matches(value, '^[A-Za-z0-9_.-]{{20,}}\z') AND -list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: {_SHARE} * log2({_SHARE}))) >= 3)"
_LAST = "regexp_extract(path, '[^.]*\\z')"
_BELOW = "(starts_with(t.path, g.path || '.') OR starts_with(t.path, g.path || '['))"


@query(rf"""WITH t AS ({_TREE}), g AS (SELECT c_custkey, path FROM t WHERE NOT item AND {_SECRET} AND NOT {_FORBIDDEN}),
k AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.c_custkey = t.c_custkey AND (g.path = t.path OR {_BELOW})) AND kind = 'VARCHAR' AND path NOT IN ('chunk_text', 'visibility'))
SELECT c_custkey, path, 'dropped' AS action, 'secret_field_name' AS detector FROM t WHERE EXISTS (SELECT 1 FROM g WHERE g.c_custkey = t.c_custkey AND g.path = t.path) AND NOT EXISTS (SELECT 1 FROM g WHERE g.c_custkey = t.c_custkey AND {_BELOW})
UNION ALL SELECT c_custkey, path, 'redacted', CASE WHEN {_MARKED} THEN 'secret_value' WHEN {_LOCAL} THEN 'local_path' ELSE 'opaque_token_entropy' END FROM k WHERE {_MARKED} OR {_LOCAL} OR ({_any(_LAST, P.TOKEN_NAMES)} AND {_OPAQUE})""")
def payload_redaction_report(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey", f"parse_json({_PAYLOAD}) AS payload")
    return P.redaction_report(rows, "c_custkey", "payload")


@query(rf"""WITH t AS ({_TREE}),
o AS (SELECT c_custkey, path FROM t x WHERE kind = 'OBJECT' AND (SELECT count(*) FROM t y WHERE y.c_custkey = x.c_custkey AND y.path IN (x.path || '.status', x.path || '.status_code', x.path || '.headers', x.path || '.body', x.path || '.raw_body', x.path || '.response_body')) >= 3),
f AS (SELECT t.c_custkey, t.path, CASE WHEN NOT item AND {_FORBIDDEN} THEN 'field' WHEN o.path IS NOT NULL THEN 'response' WHEN kind = 'VARCHAR' AND ({_MARKED} OR (t.path <> 'chunk_text' AND ({_LOCAL} OR regexp_matches(lower(value), '^\s*(?:<!doctype html|<html)') OR (contains(lower(value), '<body') AND contains(lower(value), '</body>'))))) THEN 'value' END AS fault
 FROM t LEFT JOIN o ON o.c_custkey = t.c_custkey AND o.path = t.path)
SELECT c_custkey, path, fault FROM f t WHERE fault IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f g WHERE g.c_custkey = t.c_custkey AND g.fault IS NOT NULL AND {_BELOW})""")
def payload_faults(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey", f"parse_json({_PAYLOAD}) AS payload")
    return P.payload_faults(rows, "c_custkey", "payload")


#: What is left of each kind.
_LEFT = [
    '{"b":{"keep":[]}}',
    '{"path":"[REDACTED]","url":"https://h/home/u"}',
    '{"oauth":["plain","[REDACTED]"],"other":"Zq_\' || md5(c_name) || \'"}',
    '{"Cookie":"c","deep":{"Secret":"forbidden, so it stays"}}',
    '{"d":"[REDACTED]","r":{"body":"password=x","headers":{},"status":200}}',
    '{"list":[[{"q":"[REDACTED]"},true],null],"note":"[REDACTED]"}',
    '{"m":"[REDACTED]","n":[1,{"page":" <HTML><body>x</body></html>"}]}',
]


@query("SELECT c_custkey, CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_LEFT)) + " END AS meta, 'redacted' AS status FROM customer")
def payload_redacted(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey", f"parse_json({_PAYLOAD}) AS payload")
    out = P.redacted(rows, "c_custkey", "payload")
    return out.select("c_custkey", F.to_json(F.variant_get("payload", "$.meta", "variant")).alias("meta"), "status")


_POINT = (
    "'{\"url\":' || CASE c_custkey % 4 WHEN 0 THEN 'null' WHEN 1 THEN '7' ELSE '\"https://h\"' END || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ',\"chunk_text\":\"t\"' END || ',\"chunk_index\":' || CASE c_custkey % 5 WHEN 0 THEN '1.5' WHEN 1 THEN 'true' WHEN 2 THEN '\"1\"' ELSE '3' END"
    " || ',\"title\":{\"a\":1}' || CASE c_custkey % 3 WHEN 0 THEN ',\"scraped_at\":null,\"fileModifiedAt\":\"x\"' WHEN 1 THEN ',\"scrapedAt\":5,\"file_modified_at\":\"y\"' ELSE '' END || '}'"
)
_FOUND = {f: "coalesce(" + ", ".join(f"nullif(json_type(p, '$.{n}'), 'NULL')" for n in [f, *R.ALIASES.get(f, [])]) + ")" for f in R.AUDITED}


@query(
    f"WITH t AS (SELECT ({_POINT})::JSON AS p FROM customer), k AS (SELECT {', '.join(f'{x} AS {f}' for f, x in _FOUND.items())} FROM t) "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) FILTER (WHERE {f} IN ({chr(39) + 'VARCHAR' + chr(39) if kind == 'STRING' else repr('UBIGINT') + ', ' + repr('BIGINT') + ', ' + repr('BOOLEAN')})) AS present, count(*) - count({f}) AS missing, count({f}) - count(*) FILTER (WHERE {f} IN ({chr(39) + 'VARCHAR' + chr(39) if kind == 'STRING' else repr('UBIGINT') + ', ' + repr('BIGINT') + ', ' + repr('BOOLEAN')})) AS type_mismatch, count(*) AS total FROM k"
        for f, kind in R.AUDITED.items()
    )
)
def payload_schema_types(spark, d):
    return R.payload_schema(table(spark, d, "customer").selectExpr(f"parse_json({_POINT}) AS payload"), "payload")
