"""Queries of dumps and transcripts, with their SQL. Rows of the tables pass for files: their JSON is put together by expressions that both engines
read alike, a fifth or so of them malformed."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.sources import dumps as D
from millrace.sources.tables import table

_POSTS = (
    "'[{\"title\":' || CASE c_custkey % 4 WHEN 0 THEN 'null' ELSE '\"' || c_name || '\"' END || ',\"permalink\":\"/r/' || c_custkey || '\",\"author\":\"' || CASE c_custkey % 3 WHEN 0 THEN '' ELSE c_mktsegment END || '\",\"selftext\":\"' || CASE c_custkey % 2 WHEN 0 THEN 'body' ELSE '' END"
    " || '\",\"score\":' || CASE c_custkey % 11 WHEN 5 THEN '1.5' ELSE '-3' END || ',\"num_comments\":' || CASE c_custkey % 13 WHEN 6 THEN '-1' ELSE '2' END || ',\"upvote_ratio\":1,\"comments\":[{\"body\":\"c1\",\"parent_text\":\"p\"},{' || CASE c_custkey % 7 WHEN 3 THEN '' ELSE '\"body\":\"c2\"' END || '}]},{}]'"
)
_BAD = "c_custkey % 11 = 5 OR c_custkey % 13 = 6 OR c_custkey % 7 = 3"


@query(f"""WITH p AS (SELECT c_custkey, t::JSON AS t, {_BAD} AS bad FROM (SELECT *, {_POSTS} AS t FROM customer)),
g AS (SELECT c_custkey, unnest(json_extract(t, '$[*]')) AS p, unnest([0, 1]) AS i FROM p WHERE NOT bad), v AS (SELECT *, coalesce(p ->> 'title', 'Untitled') AS title FROM g)
SELECT c_custkey, i::BIGINT AS at, 'https://www.reddit.com' || coalesce(p ->> 'permalink', '') AS url, coalesce(nullif(p ->> 'author', ''), '[deleted]') AS author, (p ->> 'score')::BIGINT AS score,
 md5('# ' || title || CASE WHEN coalesce(p ->> 'selftext', '') = '' THEN '' ELSE chr(10) || chr(10) || (p ->> 'selftext') END || CASE WHEN i = 0 THEN chr(10) || chr(10) || '---' || chr(10) || 'Post: ' || title || chr(10) || chr(10) || 'Replying to: p' || chr(10) || chr(10) || 'c1' || chr(10) || chr(10) || '---' || chr(10) || 'Post: ' || title || chr(10) || chr(10) || 'c2' ELSE '' END) AS content_md5, NULL AS fault FROM v
UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, NULL, 'adapter.reddit.dump_invalid' FROM p WHERE bad""")
def dump_posts(spark, d):
    found = D.reddit_posts(table(spark, d, "customer").selectExpr("c_custkey", f"{_POSTS} AS text"), "c_custkey")
    return found.select("c_custkey", "at", "url", "author", "score", F.md5("content").alias("content_md5"), "fault")


_VIDEOS = (
    "CASE p_partkey % 9 WHEN 0 THEN '{\"videos\":' WHEN 1 THEN '{\"videos\":7}' ELSE '{\"videos\":[{\"video_id\":\"v' || p_partkey || '\",\"title\":' || CASE p_partkey % 2 WHEN 0 THEN '5' ELSE '\"' || p_type || '\"' END || ',\"view_count\":' || (p_size - 5) || ',\"tags\":[\"a\",1,\"' || p_brand || '\"]},"
    "{\"video_id\":\"' || CASE p_partkey % 9 WHEN 4 THEN ' ' ELSE 'w' END || '\"}]}' END"
)


@query(f"""WITH f AS (SELECT p_partkey, TRY_CAST({_VIDEOS} AS JSON) AS t FROM part), v AS (SELECT p_partkey, unnest(json_extract(t, '$.videos[*]')) AS v, unnest([0, 1]) AS i FROM f WHERE p_partkey % 9 NOT IN (0, 1, 4))
SELECT p_partkey, i::BIGINT AS at, v ->> 'video_id' AS video_id, CASE WHEN json_type(v, '$.title') = 'VARCHAR' THEN v ->> 'title' ELSE '' END AS title, CASE WHEN (v ->> 'view_count')::BIGINT >= 0 THEN (v ->> 'view_count')::BIGINT END AS view_count, CASE WHEN i = 0 THEN 'a,' || (v ->> '$.tags[2]') ELSE '' END AS tags, NULL AS fault FROM v
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, CASE p_partkey % 9 WHEN 0 THEN 'adapter.youtube.dump.invalid' ELSE 'adapter.youtube.dump.video_id.missing' END FROM f WHERE p_partkey % 9 IN (0, 4)""")
def dump_videos(spark, d):
    found = D.youtube_videos(table(spark, d, "part").selectExpr("p_partkey", f"{_VIDEOS} AS text"), "p_partkey")
    return found.select("p_partkey", "at", "video_id", "title", "view_count", F.array_join("tags", ",").alias("tags"), "fault")


_PACKAGES = (
    "'{\"registry\":\"' || CASE s_suppkey % 10 WHEN 0 THEN ' ' ELSE 'npm' END || '\",\"package\":' || CASE s_suppkey % 10 WHEN 1 THEN '3' ELSE '\"' || s_name || '\"' END || ',\"keywords\":[' || CASE s_suppkey % 10 WHEN 2 THEN '1' ELSE '\"k\"' END || '],\"versions\":[' || CASE s_suppkey % 10 WHEN 3 THEN '' ELSE"
    " '{\"version\":\"1.0\",\"readme\":null},{\"version\":\"' || CASE s_suppkey % 10 WHEN 4 THEN '' ELSE '1.1' END || '\",\"is_latest\":' || CASE s_suppkey % 3 WHEN 0 THEN 'true' ELSE 'false' END || '},{\"version\":\"2.0\",\"published_at\":\"t\"}' END || ']}'"
)


@query(f"""WITH f AS (SELECT s_suppkey, s_suppkey % 10 AS k, ({_PACKAGES})::JSON AS t FROM supplier), v AS (SELECT s_suppkey, t, unnest(json_extract(t, '$.versions[*]')) AS v, unnest([0, 1, 2]) AS i FROM f WHERE k > 4)
SELECT s_suppkey, t ->> 'package' AS package, v ->> 'version' AS version, v ->> 'published_at' AS published_at, i = CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 2 END AS latest, NULL AS fault FROM v
UNION ALL SELECT s_suppkey, NULL, NULL, NULL, NULL, CASE WHEN k IN (1, 2) THEN 'adapter.registry.dump_malformed' ELSE 'adapter.registry.dump_invalid' END FROM f WHERE k <= 4""")
def dump_packages(spark, d):
    found = D.registry_versions(table(spark, d, "supplier").selectExpr("s_suppkey", f"{_PACKAGES} AS text"), "s_suppkey")
    return found.select("s_suppkey", "package", "version", "published_at", "latest", "fault")




@query("""WITH t AS (SELECT conv_id, turn, role, turn % 5 = 4 AS meta, turn % 7 = 6 AS broken, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' $', '') AS said FROM conversations WHERE text IS NOT NULL),
k AS (SELECT *, said || CASE WHEN role = 'assistant' THEN ' see [redacted-secret], ok' ELSE '' END AS full_text FROM t WHERE role IN ('user', 'assistant') AND NOT meta AND NOT broken)
SELECT c.conv_id, md5(coalesce((SELECT string_agg(chr(10) || chr(10) || '### ' || upper(role) || ':' || chr(10) || full_text, '' ORDER BY turn) FROM k WHERE k.conv_id = c.conv_id AND full_text <> ''), '')) AS text_md5,
 (SELECT count(*) FROM k WHERE k.conv_id = c.conv_id AND role = 'user' AND full_text <> '') AS turn_count, (SELECT arg_min('m' || turn, turn) FROM k WHERE k.conv_id = c.conv_id AND role = 'assistant') AS model,
 coalesce((SELECT string_agg(DISTINCT 'tool' || turn % 2, ',' ORDER BY 'tool' || turn % 2) FROM k WHERE k.conv_id = c.conv_id AND role = 'assistant'), '') AS tools,
 (SELECT arg_max('t' || turn, turn) FROM k WHERE k.conv_id = c.conv_id) AS last_message_at, count(*) FILTER (WHERE broken) AS malformed_lines FROM t c GROUP BY c.conv_id""")
def session_transcripts(spark, d):
    turns = table(spark, d, "conversations").where("text IS NOT NULL")
    said = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("see sk-abc123, ok").alias("text"))).alias("x"))))
    parts = F.regexp_replace(F.regexp_replace(said, r'^\{"x":\[', ""), r"\]\}\z", "")
    tool = F.concat(F.lit('{"type":"tool_use","name":"tool'), F.col("turn") % 2, F.lit('"}'))
    content = F.when(F.col("role") == "assistant", F.concat(F.lit("["), parts, F.lit(","), tool, F.lit("]"))).otherwise(F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]\z", ""))
    line = F.concat(F.lit('{"type":"'), "role", F.lit('","isMeta":'), F.when(F.col("turn") % 5 == 4, "true").otherwise("false"), F.lit(',"timestamp":"t'), "turn", F.lit('","message":{"model":"m'), "turn", F.lit('","content":'), content, F.lit("}}"))
    lines = turns.select("conv_id", "turn", F.when(F.col("turn") % 7 == 6, F.lit("{broken")).otherwise(line).alias("line"))
    files = lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("text"))
    out = D.session_turns(files, "conv_id")
    return out.select("conv_id", F.md5("text").alias("text_md5"), "turn_count", "model", F.array_join("tools_used", ",").alias("tools"), "last_message_at", "malformed_lines")
