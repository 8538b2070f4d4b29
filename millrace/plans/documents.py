"""Queries of Markdown sections and code symbols, with their SQL. Texts of the tables are turned into Markdown and code by expressions that
Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import documents as D
from millrace.plans.registry import query
from millrace.sources.tables import table

_NL = "chr(10)"
_ENDS = r"'^[ \t\r\n]+|[ \t\r\n]+\z', '', 'g'"


def _spark(sql: str) -> str:
    return sql.replace("chr(", "char(")


def _lines(rows: str, text: str, *carry: str) -> str:
    """Each line of a text with its number, its first byte and the bytes of the text."""
    kept = "".join(f", {c}" for c in carry)
    return f"""SELECT doc_id{kept}, total, i, line, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - strlen(line) - 1 AS byte
 FROM (SELECT doc_id{kept}, strlen({text}) AS total, unnest(string_split({text}, {_NL})) AS line, unnest(range(len(string_split({text}, {_NL})))) AS i FROM {rows})"""


#: A third has frontmatter, half an introduction, a fifth a fence that stays open; sentences, clauses and a frequent word begin headings.
_MARKDOWN = (
    f"CASE WHEN doc_id % 3 = 0 THEN '---' || {_NL} || 'lang: ' || lang || {_NL} || '---' || {_NL} ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN 'Intro' || {_NL} ELSE '' END || '# ' || source || ' #' || {_NL}"
    f" || '```py' || {_NL} || '# code' || {_NL} || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '```' || {_NL} END"
    f" || replace(replace(replace(text, '. ', '.' || {_NL} || '### '), ', ', ',' || {_NL} || ' ## '), ' de ', {_NL} || '##### ')"
)
_W = "WINDOW w AS (PARTITION BY doc_id ORDER BY i)"
_LEVELS = range(1, 7)


@query(rf"""WITH d AS (SELECT doc_id, t, regexp_extract(t, '^---\n[\s\S]*?\n---[^\n]*\n?') AS front FROM (SELECT doc_id, {_MARKDOWN} AS t FROM documents WHERE text IS NOT NULL)),
n AS (SELECT doc_id, t, CASE WHEN front = '' THEN 0 ELSE len(string_split(front, {_NL})) - CASE WHEN ends_with(front, {_NL}) THEN 1 ELSE 0 END END AS front FROM d),
l AS (SELECT *, i >= front AS body, regexp_replace(line, '^\s+|\r+\z', '', 'g') AS bare, regexp_matches(line, '^\s*(?:```|~~~)') AND i >= front AS fence FROM ({_lines('n', 't', 'front')})),
f AS (SELECT *, sum(fence::INT) OVER w AS fences FROM l {_W}),
h AS (SELECT *, CASE WHEN body AND NOT fence AND fences % 2 = 0 AND regexp_matches(bare, '^#{{1,6}}(?:[ \t]|\z)') THEN length(regexp_extract(bare, '^#+')) END AS lvl FROM f),
t AS (SELECT *, CASE WHEN lvl IS NOT NULL THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '^#+', ''), {_ENDS}), '#+\z', ''), {_ENDS}) END AS title FROM h),
p AS (SELECT *, CASE WHEN body THEN count(lvl) OVER w ELSE -1 END AS section, {', '.join(f'max(CASE WHEN lvl = {n} THEN i END) OVER w AS i{n}, last_value(CASE WHEN lvl = {n} THEN title END IGNORE NULLS) OVER w AS t{n}' for n in _LEVELS)} FROM t {_W}),
c AS (SELECT *, list_filter([{', '.join(f"CASE WHEN i{n} > greatest(-1, {', '.join([f'coalesce(i{m}, -1)' for m in range(1, n)] or ['-1'])}) THEN t{n} END" for n in _LEVELS)}], lambda x: x IS NOT NULL) AS path,
 regexp_replace(regexp_extract(line, '^\s*(?:```|~~~)(.*)', 1), {_ENDS}) AS label FROM p),
g AS (SELECT doc_id, section, max(lvl) AS level, max(title) AS title, any_value(array_to_string(path, ' > ')) FILTER (WHERE lvl IS NOT NULL) AS heading_path, arg_min(label, i) FILTER (WHERE body AND label <> '') AS fence_language,
 regexp_replace(string_agg(line, {_NL} ORDER BY i), {_ENDS}) AS content, min(i) + 1 AS line_start, max(i) FILTER (WHERE byte < total OR i = 0) + 1 AS line_end, min(byte)::BIGINT AS byte_start, least(max(byte + strlen(line) + 1), any_value(total))::BIGINT AS byte_end FROM c GROUP BY doc_id, section)
SELECT doc_id, section, CASE WHEN section < 0 THEN 'frontmatter' ELSE 'section' END AS kind, level, title, coalesce(heading_path, '') AS heading_path, fence_language, md5(content) AS content_md5, line_start, line_end, byte_start, byte_end FROM g WHERE content <> ''""")
def markdown_sections(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", f"{_spark(_MARKDOWN)} AS text")
    return D.markdown_sections(docs).withColumn("heading_path", F.array_join("heading_path", " > ")).withColumn("content_md5", F.md5("content")).drop("content")


@query(rf"""WITH n AS (SELECT doc_id, {_MARKDOWN} AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, line, length(regexp_extract(line, '^\s*(#+)', 1)) AS level FROM ({_lines('n', 't')}) WHERE regexp_matches(line, '^\s*#{{1,6}}(?:[^#\s]|\s+\S)')),
h AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^\s*#+', ''), {_ENDS}), '#+\z', ''), {_ENDS}) AS heading, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l),
p AS (SELECT *, least(k, k + min(level - k) OVER w) AS depth FROM h {_W}),
c AS (SELECT *, {', '.join(f'last_value(CASE WHEN depth = {n} THEN heading END IGNORE NULLS) OVER w AS t{n}' for n in _LEVELS)} FROM p {_W})
SELECT doc_id, i + 1 AS line, level, heading, trim(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '-') AS anchor, array_to_string([{', '.join(f't{n}' for n in _LEVELS)}][1:depth], ' > ') AS heading_path FROM c""")
def markdown_headings(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", f"{_spark(_MARKDOWN)} AS text")
    return D.heading_facts(docs).withColumn("heading_path", F.array_join("heading_path", " > "))


#: Sentences end blocks and begin functions, clauses begin methods, a frequent word assigns; every seventh text has no symbols, every sixth packs two files.
_PLAIN = f"'import x' || {_NL} || replace(replace(replace(text, '. ', ';' || {_NL} || '}}' || {_NL} || 'pub fn '), ', ', ' {{' || {_NL} || '  def '), ' de ', {_NL} || '    export const x = () => \"}}\" ')"
_CODE = (
    f"CASE WHEN doc_id % 7 = 0 THEN replace(text, ', ', ',' || {_NL}) WHEN doc_id % 6 = 0 THEN 'head' || {_NL} || '========' || {_NL} || 'File: src/' || source || {_NL} || '========' || {_NL} || {_PLAIN}"
    f" || {_NL} || '--------' || {_NL} || {_NL} || 'File: b.py' || {_NL} || '--------' || {_NL} || 'class Z:' || {_NL} || '  x = 1' || {_NL} || {_NL} ELSE {_PLAIN} END"
)
_CODE_PATH = "CASE doc_id % 5 WHEN 0 THEN 'src/a.rs' WHEN 1 THEN 'b.ts' WHEN 2 THEN 'tests/c_test.py' WHEN 3 THEN 'd.unknown' ELSE 'E.JS' END"
_STRIP = r"'^(?:export default |export |declare |abstract )*'"
_VIS = r"'^(?:pub |pub\(crate\) |pub\(super\) )'"
_REST = f"regexp_replace(regexp_replace(regexp_replace(line, '^\\s+', ''), {_STRIP}, ''), {_VIS}, '')"


def _assigned(x: str) -> str:
    return rf"(regexp_matches({x}, '^(?:const|let|var) [A-Za-z0-9_$]+') AND regexp_matches(regexp_replace({x}, '^(?:const|let|var) [A-Za-z0-9_$]+', ''), '=>|function|React\.FC'))"


_WORDS = "'^(?:pub fn |fn |def |class |struct |enum |impl |async function |function |interface |type )'"
_KIND_OF = rf"regexp_replace(regexp_replace(regexp_extract(content, '^\s*([^\n]*)', 1), {_STRIP}, ''), {_VIS}, '')"


def _files(columns: str) -> str:
    return f"(SELECT doc_id, {_CODE} AS t{columns} FROM documents WHERE text IS NOT NULL)"


_LANGUAGE = "CASE doc_id % 5 WHEN 0 THEN 'rust' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' WHEN 3 THEN 'unknown' ELSE 'javascript' END"


@query(rf"""WITH RECURSIVE l AS (SELECT *, regexp_replace(line, {_ENDS}) AS bare FROM ({_lines(_files(''), 't')})),
m AS (SELECT *, regexp_matches(bare, '^[=-]{{8,}}\z') AS divider, regexp_extract(bare, '^File: \s*(\S[\s\S]*)', 1) AS path FROM l),
k AS (SELECT *, path <> '' AND (coalesce(lag(divider) OVER w, FALSE) OR coalesce(lead(divider) OVER w, FALSE)) AS marker FROM m {_W}),
f AS (SELECT *, sum(marker::INT) OVER w AS file, coalesce(lag(marker) OVER w, FALSE) AS below FROM k {_W}),
i AS (SELECT *, file > 0 AND NOT marker AND NOT (below AND divider) AS inside FROM f),
s AS (SELECT *, max(CASE WHEN inside AND NOT divider AND bare <> '' THEN i END) OVER (PARTITION BY doc_id, file) AS solid, max(CASE WHEN marker THEN path END) OVER (PARTITION BY doc_id, file) AS original_path FROM i),
p AS (SELECT *, coalesce(inside AND i <= solid, FALSE) AS packed FROM s),
a AS (SELECT *, bool_or(packed) OVER (PARTITION BY doc_id) AS any_packed FROM p),
b AS (SELECT doc_id, total, i, line, byte, CASE WHEN any_packed THEN file ELSE 0 END AS file, CASE WHEN any_packed THEN original_path END AS original_path, {_REST} AS rest FROM a WHERE packed OR NOT any_packed),
y AS (SELECT *, regexp_matches(rest, {_WORDS}) OR {_assigned('rest')} AS starts FROM b),
c AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id, file ORDER BY i) AS chunk, bool_or(starts) OVER (PARTITION BY doc_id, file) AS any_starts FROM y),
g AS (SELECT doc_id, file, chunk, any_value(original_path) AS original_path, max(regexp_extract(regexp_replace(rest, CASE WHEN regexp_matches(rest, {_WORDS}) THEN {_WORDS} ELSE '^(?:const|let|var) ' END, ''), '^[\p{{L}}\p{{N}}_]*')) FILTER (WHERE starts) AS symbol,
 string_agg(line, {_NL} ORDER BY i) AS raw, min(i) + 1 AS line_start, min(byte)::BIGINT AS byte_start, least(max(byte + strlen(line) + 1), any_value(total))::BIGINT AS byte_end FROM c WHERE chunk > 0 OR NOT any_starts GROUP BY doc_id, file, chunk),
x AS (SELECT *, regexp_replace(raw, {_ENDS}) AS content, regexp_extract(raw, '^[ \t\r\n]*') AS lead FROM g),
big AS (SELECT * FROM x WHERE strlen(content) > {D.MOST_BYTES}),
z AS (SELECT doc_id, file, chunk, unnest(string_split(content, {_NL})) AS line, unnest(range(len(string_split(content, {_NL})))) AS n, len(string_split(content, {_NL})) AS lines FROM big),
o AS (SELECT *, sum(strlen(line) + CASE WHEN n < lines - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, file, chunk ORDER BY n) AS fin FROM z),
q AS (SELECT *, coalesce(lag(fin) OVER (PARTITION BY doc_id, file, chunk ORDER BY n), 0) AS ini FROM o),
j AS (SELECT u.doc_id, u.file, u.chunk, u.n, any_value(u.ini) AS ini, min(v.n) AS nxt, any_value(u.lines) AS lines FROM q u LEFT JOIN q v ON v.doc_id = u.doc_id AND v.file = u.file AND v.chunk = u.chunk AND v.n > u.n AND v.fin - u.ini > {D.PIECE_BYTES} GROUP BY u.doc_id, u.file, u.chunk, u.n),
r AS (SELECT *, 0 AS part FROM j WHERE n = 0 UNION ALL SELECT j.*, r.part + 1 FROM r JOIN j ON j.doc_id = r.doc_id AND j.file = r.file AND j.chunk = r.chunk AND j.n = r.nxt),
w AS (SELECT r.doc_id, r.file, r.chunk, r.part, r.n, any_value(r.ini) AS ini, max(q.fin) AS fin, regexp_replace(string_agg(q.line, {_NL} ORDER BY q.n), {_ENDS}) AS content FROM r JOIN q ON q.doc_id = r.doc_id AND q.file = r.file AND q.chunk = r.chunk AND q.n >= r.n AND q.n < coalesce(r.nxt, r.lines) GROUP BY r.doc_id, r.file, r.chunk, r.part, r.n),
u AS (SELECT doc_id, NULL::BIGINT AS part, symbol, original_path, content, line_start, byte_start, byte_end FROM x WHERE content <> '' AND strlen(content) <= {D.MOST_BYTES}
 UNION ALL SELECT w.doc_id, w.part, symbol || '#part' || w.part, original_path, w.content, line_start + length(lead) - length(replace(lead, {_NL}, '')) + w.n, byte_start + strlen(lead) + w.ini, byte_start + strlen(lead) + w.fin FROM w JOIN big ON big.doc_id = w.doc_id AND big.file = w.file AND big.chunk = w.chunk WHERE w.content <> '')
SELECT doc_id, symbol, CASE WHEN regexp_matches({_KIND_OF}, '^(?:pub fn |fn |def |async function |function )') OR {_assigned(_KIND_OF)} THEN 'function' WHEN regexp_matches({_KIND_OF}, '^(?:class |interface |type |struct )') THEN 'type'
 WHEN starts_with({_KIND_OF}, 'enum ') THEN 'enum' WHEN starts_with({_KIND_OF}, 'impl ') THEN 'impl' ELSE 'symbol' END AS kind, original_path, {_LANGUAGE} AS language, doc_id % 5 = 2 AS is_test,
 CASE WHEN part IS NULL AND symbol IS NOT NULL THEN 'heuristic_symbol' ELSE 'line_window' END AS chunk_source, CASE WHEN part IS NOT NULL THEN 'partial' WHEN symbol IS NULL AND doc_id % 5 = 3 THEN 'unsupported' ELSE 'fallback' END AS parse_status,
 CASE WHEN part IS NOT NULL OR symbol IS NOT NULL THEN 'fallback' WHEN doc_id % 5 = 3 THEN 'unsupported' ELSE 'none' END AS extraction_status, md5(content) AS content_md5, line_start::BIGINT AS line_start, byte_start::BIGINT AS byte_start, byte_end::BIGINT AS byte_end FROM u""")
def code_chunks(spark, d):
    files = table(spark, d, "documents").selectExpr("doc_id", f"{_spark(_CODE)} AS text", f"{_CODE_PATH} AS path")
    return D.code_chunks(files).withColumn("content_md5", F.md5("content")).drop("content")


def _declares(head: str, words: str) -> str:
    return f"'^{head}({words}) ([A-Za-z0-9_$]*)'"


_RUST, _PYTHON = _declares("(?:pub )?", "struct|enum|trait|async fn|fn"), _declares("", "class|def")
_SCRIPT = _declares("(?:export default |export |declare |abstract )*", "async function|function|class|interface|type|enum")
_ASSIGNS = "'^(?:export default |export |declare |abstract )*(?:const|let|var) ([A-Za-z0-9_$]+)([\\s\\S]*)'"
_EXPORTED = "CASE WHEN regexp_matches(bare, '^(?:declare |abstract )*export ') THEN 'public' ELSE 'private' END"


@query(rf"""WITH n AS (SELECT doc_id, regexp_replace(replace(t, chr(13) || chr(10), {_NL}), '\n\z', '') AS t, CASE doc_id % 5 WHEN 1 THEN 'typescript' WHEN 4 THEN 'javascript' END AS script FROM {_files('')}),
l AS (SELECT doc_id, script, i, line, regexp_replace(line, '^\s+', '') AS bare, length(regexp_extract(line, '^[ \t]*')) AS indent, regexp_replace(line, {_ENDS}) = '' AS blank,
 regexp_replace(line, '"(?:[^"\\]|\\.)*"|''[{{}}]''|//.*', '', 'g') AS code FROM ({_lines('n', 't', 'script')})),
b AS (SELECT *, length(code) - length(replace(code, '{{', '')) AS o, length(code) - length(replace(code, '}}', '')) AS c FROM l),
s AS (SELECT *, sum(o) OVER w AS os, sum(o - c) OVER w AS depth, count(*) OVER (PARTITION BY doc_id) AS n, CASE WHEN regexp_matches(bare, '^(?://|#|/\*|\*|"|''|r#"|r")') THEN NULL WHEN regexp_matches(bare, {_RUST}) THEN 'rust'
 WHEN script IS NOT NULL AND regexp_matches(bare, {_SCRIPT}) THEN 'declared' WHEN script IS NOT NULL AND regexp_matches(bare, {_ASSIGNS}) THEN 'assigned' WHEN regexp_matches(bare, {_PYTHON}) THEN 'python' END AS how FROM b {_W}),
y AS (SELECT *, CASE how WHEN 'rust' THEN regexp_extract(bare, {_RUST}, 2) WHEN 'declared' THEN regexp_extract(bare, {_SCRIPT}, 2) WHEN 'assigned' THEN regexp_extract(bare, {_ASSIGNS}, 1) ELSE regexp_extract(bare, {_PYTHON}, 2) END AS name,
 CASE how WHEN 'rust' THEN regexp_extract(bare, {_RUST}, 1) WHEN 'declared' THEN regexp_extract(bare, {_SCRIPT}, 1) WHEN 'assigned' THEN CASE WHEN regexp_matches(regexp_extract(bare, {_ASSIGNS}, 2), '=>|function|React\.FC') THEN 'fn' ELSE 'constant' END ELSE regexp_extract(bare, {_PYTHON}, 1) END AS word FROM s WHERE how IS NOT NULL),
e AS (SELECT y.doc_id, y.i, min(s.i) FILTER (WHERE s.os > y.os - y.o AND s.depth <= y.depth - y.o + y.c) AS braces, min(s.i) FILTER (WHERE s.i > y.i AND NOT s.blank AND s.indent <= y.indent) AS back FROM y JOIN s ON s.doc_id = y.doc_id AND s.i >= y.i AND s.i < y.i + {D.SCAN_LINES} GROUP BY y.doc_id, y.i),
t AS (SELECT y.doc_id, y.i, max(s.i) AS last FROM y JOIN e ON e.doc_id = y.doc_id AND e.i = y.i JOIN s ON s.doc_id = y.doc_id AND s.i >= y.i AND s.i < least(y.i + {D.SCAN_LINES}, coalesce(e.back, y.n)) AND (s.i = y.i OR NOT s.blank) GROUP BY y.doc_id, y.i),
p AS (SELECT y.doc_id, y.i, arg_max(x.name, x.i) AS parent FROM y JOIN y x ON x.doc_id = y.doc_id AND x.i < y.i AND x.indent < y.indent GROUP BY y.doc_id, y.i),
f AS (SELECT y.*, p.parent, least(y.n, y.i + {D.SCAN_LINES}) AS lim, CASE WHEN how = 'python' THEN t.last WHEN NOT contains(line, '{{') AND regexp_matches(line, ';\s*\z') THEN y.i ELSE e.braces END AS fin FROM y JOIN e ON e.doc_id = y.doc_id AND e.i = y.i JOIN t ON t.doc_id = y.doc_id AND t.i = y.i LEFT JOIN p ON p.doc_id = y.doc_id AND p.i = y.i)
SELECT doc_id, i + 1 AS line_start, coalesce(fin + 1, lim) AS line_end, name, CASE WHEN how IN ('rust', 'python') THEN how ELSE script END AS language, CASE WHEN word IN ('fn', 'async fn', 'def', 'async function') THEN 'function' ELSE word END AS kind,
 CASE how WHEN 'rust' THEN CASE WHEN starts_with(bare, 'pub ') THEN 'public' ELSE 'private' END WHEN 'python' THEN CASE WHEN starts_with(name, '_') THEN 'private' ELSE 'public' END ELSE {_EXPORTED} END AS visibility, parent,
 lim < n AND (fin IS NULL OR (how = 'python' AND fin + 1 = lim)) AS truncated FROM f""")
def code_symbols(spark, d):
    files = table(spark, d, "documents").selectExpr("doc_id", f"{_spark(_CODE)} AS text", f"{_CODE_PATH} AS path")
    return D.code_symbols(files)
