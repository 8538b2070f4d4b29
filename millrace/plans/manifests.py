"""The query of package manifests, with its SQL. Parts pass for projects: each has a manifest of one of six kinds."""

from __future__ import annotations

from millrace.operators import manifests as M
from millrace.plans.registry import query
from millrace.sources.tables import table

_NL = "chr(10)"
_PATH = "CASE p_partkey % 6 WHEN 0 THEN 'a/Cargo.toml' WHEN 1 THEN 'package.json' WHEN 2 THEN 'requirements.txt' WHEN 3 THEN 'pyproject.toml' WHEN 4 THEN 'go.mod' ELSE 'pom.xml' END"
_TEXT = (
    f"CASE p_partkey % 6 WHEN 0 THEN '[package]' || {_NL} || 'edition = \"2021\"' || {_NL} || 'name = \"n\"' || {_NL} || '[dependencies]' || {_NL} || ' d' || p_size || ' = {{ version = \"' || p_size || '.1\", path = ''p'' }}' || {_NL} || '# no = \"1\"' || {_NL} || 'bare = 7' || {_NL} || '[workspace]' || {_NL} || 'members = [\"m1\", ''m2'']' || {_NL} || '[odd]' || {_NL} || 'x = \"1\"'"
    " WHEN 1 THEN CASE WHEN p_partkey % 5 = 0 THEN '{\"dependencies\":' ELSE '{\"dependencies\":{\"d' || p_size || '\":\"^1\",\"w\":{\"v\":1}},\"scripts\":{\"b\":\"\",\"t\":\"run\"},\"engines\":{\"node\":\">=18\",\"n\":1}}' END"
    f" WHEN 2 THEN '# c' || {_NL} || 'd' || p_size || ' >= ' || p_size || {_NL} || {_NL} || '==1' || {_NL} || 'plain[x]'"
    f" WHEN 3 THEN '[project]' || {_NL} || 'dependencies = [\"d' || p_size || '~=1\", ''e'']' || {_NL} || 'requires-python = \">=3.9\"' || {_NL} || '[project.optional-dependencies]' || {_NL} || 'dev = [\"x\", \"y\"]' || {_NL} || '[tool]' || {_NL} || 'q = \"1\"'"
    f" WHEN 4 THEN 'module m' || {_NL} || 'go 1.' || p_size || {_NL} || 'toolchain go1.9' || {_NL} || 'require a.io/b v1' || {_NL} || 'require (' || {_NL} || chr(9) || 'x.io/d' || p_size || ' v2 // i' || {_NL} || '// c' || {_NL} || ')' || {_NL} || 'exclude z v1'"
    f" ELSE '<p><java.version> 17 </java.version>' || {_NL} || '<dependency><groupId>g</groupId>' || {_NL} || '<artifactId>d' || p_size || '</artifactId><version>1</version></dependency><dependency><groupId>g</groupId></dependency>' || {_NL} || '<dependency><groupId>h</groupId><artifactId>b</artifactId></dependency></p>' END"
)
_QUOTED = r"""list_transform(regexp_extract_all({0}, '"[^"]*"|''[^'']*'''), lambda q: q[2:-2])"""
_KEY, _REST = "trim(regexp_extract(l, '^([^=]*)=', 1))", "regexp_extract(l, '^[^=]*=(.*)', 1)"


@query(rf"""WITH f AS (SELECT p_partkey, p_partkey % 6 AS kind, {_TEXT} AS t FROM part),
l AS (SELECT p_partkey, kind, unnest(string_split(t, {_NL})) AS raw, unnest(range(1, len(string_split(t, {_NL})) + 1)) AS line FROM f),
s AS (SELECT *, regexp_replace(raw, '^[ \t\r\n]+|[ \t\r\n]+\z', '', 'g') AS l FROM l),
h AS (SELECT *, last_value(CASE WHEN starts_with(l, '[') AND ends_with(l, ']') THEN l END IGNORE NULLS) OVER w AS section, starts_with(l, '[') AND ends_with(l, ']') AS header,
 coalesce(last_value(CASE WHEN l IN ('require (', ')') THEN l END IGNORE NULLS) OVER (PARTITION BY p_partkey ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'require (', FALSE) AS inside FROM s WINDOW w AS (PARTITION BY p_partkey ORDER BY line)),
j AS (SELECT p_partkey, TRY_CAST(t AS JSON) AS v FROM f WHERE kind = 1),
x AS (SELECT p_partkey, unnest(regexp_extract_all(t, '(?s).*?<dependency>.*?</dependency>')) AS b, unnest(range(1, 4)) AS i, t FROM f WHERE kind = 5),
y AS (SELECT *, sum(length(b) - length(replace(b, {_NL}, ''))) OVER (PARTITION BY p_partkey ORDER BY i) - (length(regexp_extract(b, '(?s)<dependency>.*')) - length(replace(regexp_extract(b, '(?s)<dependency>.*'), {_NL}, ''))) + 1 AS line FROM x)
SELECT p_partkey, line, 'cargo' AS ecosystem, 'package' AS scope, 'toolchain' AS fact, 'rust' AS name, ({_QUOTED.format('l')})[1] AS version, l AS quote, NULL AS fault FROM h WHERE kind = 0 AND section = '[package]' AND {_KEY} = 'edition'
UNION ALL SELECT p_partkey, line, 'cargo', 'dependencies', 'dependency', {_KEY}, ({_QUOTED.format('l')})[1], l, NULL FROM h WHERE kind = 0 AND section = '[dependencies]' AND NOT header AND NOT starts_with(l, '#')
UNION ALL SELECT p_partkey, line, 'cargo', 'workspace.members', 'workspace_member', unnest({_QUOTED.format('l')}), NULL, l, NULL FROM h WHERE kind = 0 AND section = '[workspace]' AND {_KEY} = 'members'
UNION ALL SELECT p_partkey, 1, 'npm', 'dependencies', 'dependency', k, CASE WHEN json_type(v, '$.dependencies."' || k || '"') = 'VARCHAR' THEN v ->> ('$.dependencies."' || k || '"') END, k || ': ' || (v -> ('$.dependencies."' || k || '"'))::VARCHAR, NULL FROM (SELECT p_partkey, v, unnest(json_keys(v, '$.dependencies')) AS k FROM j)
UNION ALL SELECT p_partkey, 1, 'npm', 'scripts', 'toolchain_script', k, nullif(v ->> ('$.scripts.' || k), ''), k || ': ' || (v ->> ('$.scripts.' || k)), NULL FROM (SELECT p_partkey, v, unnest(json_keys(v, '$.scripts')) AS k FROM j)
UNION ALL SELECT p_partkey, 1, 'npm', 'engines', 'toolchain_version', 'node', v ->> '$.engines.node', 'node: ' || (v ->> '$.engines.node'), NULL FROM j WHERE v IS NOT NULL
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'parse.manifest.invalid' FROM j WHERE v IS NULL
UNION ALL SELECT p_partkey, line, 'python', 'runtime', 'dependency', trim(regexp_extract(l, '^[^=<>!~\[]*')), nullif(regexp_extract(l, '[=<>!~\[].*'), ''), l, NULL FROM h WHERE kind = 2 AND l <> '' AND NOT starts_with(l, '#') AND trim(regexp_extract(l, '^[^=<>!~\[]*')) <> ''
UNION ALL SELECT p_partkey, line, 'python', 'project.dependencies', 'dependency', regexp_extract(q, '^[^=<>!~\[]*'), nullif(regexp_extract(q, '[=<>!~\[].*'), ''), q, NULL FROM (SELECT p_partkey, line, unnest({_QUOTED.format('l')}) AS q FROM h WHERE kind = 3 AND starts_with(l, 'dependencies'))
UNION ALL SELECT p_partkey, line, 'python', 'project', 'toolchain_version', 'python', ({_QUOTED.format(_REST)})[1], l, NULL FROM h WHERE kind = 3 AND {_KEY} = 'requires-python'
UNION ALL SELECT p_partkey, line, 'python', 'project.optional-dependencies', 'manifest_extra', {_KEY}, array_to_string({_QUOTED.format(_REST)}, ', '), l, NULL FROM h WHERE kind = 3 AND section = '[project.optional-dependencies]' AND NOT header
UNION ALL SELECT p_partkey, line, 'go', 'toolchain', 'toolchain_version', 'go', regexp_replace(l, '^(go|toolchain go) ?', ''), l, NULL FROM h WHERE kind = 4 AND regexp_matches(l, '^(go|toolchain) ')
UNION ALL SELECT p_partkey, line, 'go', 'require', 'dependency', string_split(regexp_replace(l, '^require ', ''), ' ')[1], string_split(regexp_replace(l, '^require ', ''), ' ')[2], l, NULL FROM h WHERE kind = 4 AND ((inside AND l <> ')' AND NOT starts_with(l, '//')) OR (starts_with(l, 'require ') AND l <> 'require ('))
UNION ALL SELECT p_partkey, line::BIGINT, 'maven', 'dependencies', 'dependency', regexp_extract(b, '<groupId>(.*?)<', 1) || ':' || regexp_extract(b, '<artifactId>(.*?)<', 1), nullif(regexp_extract(b, '<version>(.*?)<', 1), ''), replace(regexp_extract(b, '(?s)<dependency>.*'), {_NL}, ' '), NULL FROM y WHERE contains(b, '<artifactId>')
UNION ALL SELECT p_partkey, 1, 'maven', 'properties', 'toolchain_version', 'java', '17', '<java.version>17</java.version>', NULL FROM f WHERE kind = 5""")
def manifest_declarations(spark, d):
    files = table(spark, d, "part").selectExpr("p_partkey", f"{_TEXT.replace('chr(', 'char(')} AS text", f"{_PATH} AS path")
    return M.manifest_facts(files, "p_partkey").drop("parser")
