"""Registered queries of the engine's own operators, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.operators import jobs as J
from millrace.operators import lifecycle as L
from millrace.operators import reports as P
from millrace.operators import retrieval as R
from millrace.sources.tables import table
from millrace.streaming import events as S

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _points(spark, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


#: The query set of a search: every row whose id is divisible by 20.
_EVERY = "id % 20 = 0"


def _asked(spark, d: str) -> DataFrame:
    return _points(spark, d).where(_EVERY).select(F.col("id").alias("query_id"), F.col("v").alias("q"))


_DOT = "list_sum(list_transform(range(1, len(p.embedding) + 1), lambda i: p.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE))"
_DENSE = f"SELECT q.vec_id AS query_id, p.vec_id AS id, {_DOT} AS score FROM embeddings p, embeddings q WHERE q.vec_id % 20 = 0"
_URL = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '')"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(f"SELECT query_id, id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_DENSE})) WHERE rank <= 10")
def retrieval_dense_topk(spark, d):
    return R.dense_topk(_points(spark, d), _asked(spark, d), 10).withColumn("score", F.round("score", 9))


@query(f"SELECT query_id, id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_DENSE} AND p.label IN (1, 3))) WHERE rank <= 10")
def retrieval_filtered_topk(spark, d):
    return R.dense_topk(R.matching(_points(spark, d), {"label": [1, 3]}), _asked(spark, d), 10).withColumn("score", F.round("score", 9))


@query(f"SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_DENSE.replace('AS id,', 'AS id, p.label,')})) WHERE rank <= 10 AND (label NOT IN (2) OR label IS NULL)")
def retrieval_exclude_after_topk(spark, d):
    """The exclusion comes after the limit, so fewer rows than the limit may be left."""
    hits = R.dense_topk(_points(spark, d), _asked(spark, d), 10)
    return hits.join(_points(spark, d).select("id", "label"), "id").where(~F.col("label").isin(2) | F.col("label").isNull()).select("query_id", "id", "rank")


_TERMS = f"""
t AS (SELECT doc_id, lower(term) AS term FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS term FROM documents) WHERE len(term) >= 3),
u AS (SELECT doc_id, term, count(*) AS n FROM t WHERE term NOT IN ({', '.join(repr(w) for w in T.STOP_WORDS)}) GROUP BY ALL),
m AS (SELECT term, list_reduce(list_prepend({T.FNV_START}, list_transform(string_split(term, ''), lambda c: ascii(c))), lambda h, b: (xor(h, b) * {T.FNV_PRIME}) % 65536) AS bucket FROM (SELECT DISTINCT term FROM u)),
w AS (SELECT doc_id, m.bucket, sum(n) AS tf, ln(1 + sum(n)) AS weight FROM u JOIN m USING (term) GROUP BY ALL)"""


@query(f"WITH {_TERMS} SELECT doc_id, bucket, tf, round(weight, 9) AS weight FROM w")
def sparse_term_vectors(spark, d):
    return T.term_weights(table(spark, d, "documents")).withColumn("weight", F.round("weight", 9))


def _sparse(spark, d, k):
    """The search writes its points and queries, so terms are made once of each."""
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "id")
    asked = docs.where(_EVERY).withColumnRenamed("id", "query_id")
    return R.sparse_topk(T.term_lists(docs, "id"), T.term_lists(asked, "query_id"), k)


_SPARSE = """, q AS (SELECT doc_id AS query_id, bucket, weight FROM w WHERE doc_id % 20 = 0),
s AS (SELECT query_id, w.doc_id AS id, sum(w.weight * q.weight) AS score FROM w JOIN q USING (bucket) GROUP BY ALL)"""


@query(f"WITH {_TERMS}{_SPARSE} SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM s) WHERE rank <= 10")
def retrieval_sparse_topk(spark, d):
    return _sparse(spark, d, 10)


@query(f"""WITH {_TERMS}{_SPARSE}, a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM ({_DENSE}) QUALIFY r <= 100),
b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS r FROM s QUALIFY r <= 100),
f AS (SELECT query_id, id, sum(1::DOUBLE / (60 + r)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT query_id, id, round(score, 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 10""")
def retrieval_hybrid_rrf(spark, d):
    """Dense and sparse rankings of a hundred each, fused by reciprocal ranks; ids of both tables are taken as the same."""
    return R.fuse(R.dense_topk(_points(spark, d), _asked(spark, d), 100), _sparse(spark, d, 100), 10).withColumn("score", F.round("score", 12))


_DEFANGED = "strlen(regexp_replace(replace(replace(replace(replace(text, '## Sources', '## \u200bSources'), '## Source Document', '## \u200bSource Document'), '## Top Chunk', '## \u200bTop Chunk'), '## Supplemental Chunk', '## \u200bSupplemental Chunk'), '\\[S([0-9]+)\\]', '[\u200bS\\1]', 'g'))"


@query(f"""WITH h AS (SELECT lang AS query_id, coalesce({_DEFANGED}, 0) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents),
c AS (SELECT query_id, rank, (sum(n) OVER w + 2 * (rank - 1))::BIGINT AS bytes_so_far FROM h WINDOW w AS (PARTITION BY query_id ORDER BY rank))
SELECT query_id, rank, bytes_so_far, ceil(bytes_so_far / 4.0)::BIGINT AS tokens_so_far FROM c WHERE bytes_so_far <= 20000 AND ceil(bytes_so_far / 4.0) <= 4000""")
def context_budget(spark, d):
    hits = table(spark, d, "documents").select(F.col("lang").alias("query_id"), "doc_id", F.octet_length(T.defang(F.col("text"))).alias("bytes"))
    return R.leading(hits, "doc_id", 20000, 4000).select("query_id", "rank", "bytes_so_far", "tokens_so_far")


@query("SELECT coalesce(source, 'unknown') AS value, count(*) AS n FROM documents WHERE coalesce(source, 'x') <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def facet_sources(spark, d):
    return R.facet(table(spark, d, "documents"), F.col("source"), 10)


@query(f"SELECT CASE WHEN coalesce({_URL}, '') = '' THEN 'unknown' ELSE {_URL} END AS domain, count(*) AS vectors, count(DISTINCT nullif(url, '')) AS urls FROM pages GROUP BY 1")
def domains_detailed(spark, d):
    p = table(spark, d, "pages").withColumn("domain", U.domain(F.col("url")))
    return p.groupBy("domain").agg(F.count("*").alias("vectors"), F.count_distinct(F.nullif("url", F.lit(""))).alias("urls"))


@query(f"SELECT page_id, {_URL} AS host, {_PATH} AS path, suffix(lower({_PATH}), '.md') AS markdown, regexp_matches({_PATH}, '^(?:/[^/]+)?(?:/fr|/de)(?:[/-]|$)') AS excluded FROM pages")
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", U.host(u).alias("host"), U.path(u).alias("path"), F.lower(U.path(u)).endswith(".md").alias("markdown"), U.excluded(u, ["/fr", "/de"]).alias("excluded"))


@query(r"""WITH c AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
p AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$', 1) AS r FROM c)
SELECT page_id, s || '://' || CASE s WHEN 'https' THEN regexp_replace(h, ':443$', '') WHEN 'http' THEN regexp_replace(h, ':80$', '') ELSE h END
 || CASE WHEN regexp_replace(regexp_extract(r, '^[^?]*'), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(r, '^[^?]*'), '/+$', '') END || regexp_extract(r, '\?.*$') AS canonical FROM p""")
def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical"))


@query(rf"""WITH p AS (SELECT page_id, url, lower({_PATH}) AS p, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS h FROM pages)
SELECT page_id, (CASE WHEN regexp_matches(h || p, '{'|'.join(U.HIGH_VALUE)}') THEN 4 ELSE 0 END + CASE WHEN len(list_filter(string_split(p, '/'), lambda s: s <> '')) = 0 THEN 1 ELSE 0 END
 + CASE WHEN len(list_filter(string_split(p, '/'), lambda s: s <> '')) BETWEEN 1 AND 4 THEN 2 ELSE 0 END - CASE WHEN contains(regexp_replace(url, '#.*$', ''), '?') THEN 2 ELSE 0 END
 - CASE WHEN regexp_matches(p, '{'|'.join(U.LOW_VALUE)}') THEN 3 ELSE 0 END - CASE WHEN regexp_matches(p, '\.(zip|gz|tar|exe|dmg)$') THEN 6 ELSE 0 END) AS score FROM p""")
def url_suggestion_scores(spark, d):
    return table(spark, d, "pages").select("page_id", U.suggestion_score(F.col("url")).alias("score"))


@query(f"""SELECT url FROM pages WHERE length(url) > 2048 OR contains(url, '&amp;') OR regexp_matches(lower({_PATH}), '%3c|%3e|%7b|%7d')
 OR length(url) - length(replace(url, '%20', '')) >= 9 OR contains(url, '''%20') OR contains(url, '%20''') UNION SELECT min(url) FROM pages""")
def url_junk_and_first(spark, d):
    p = table(spark, d, "pages")
    return p.where(U.junk(F.col("url"))).select("url").union(p.agg(F.min("url").alias("url"))).distinct()


@query("""WITH a AS (SELECT doc_id, md5(text) AS h, n_chars FROM documents WHERE doc_id % 7 <> 0),
b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN md5(text || 'x') ELSE md5(text) END AS h, n_chars FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed'
 WHEN a.h IS NOT DISTINCT FROM b.h AND a.n_chars IS NOT DISTINCT FROM b.n_chars THEN 'unchanged' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def manifest_diff(spark, d):
    """Two generations made from one table: some rows go, some come, some change."""
    docs = table(spark, d, "documents")
    a = docs.where("doc_id % 7 <> 0").select("doc_id", F.md5("text").alias("h"), "n_chars")
    b = docs.where("doc_id % 11 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text")).alias("h"), "n_chars")
    return L.manifest_diff(a, b, "doc_id", ["h", "n_chars"])


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_documents(spark, d):
    return L.orphans(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, source, max(n_chars) AS n_chars FROM documents GROUP BY source")
def dedupe_keep_best(spark, d):
    return R.keep_best(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], "n_chars", "doc_id")


@query("SELECT sha256(text) AS key, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE url IS NULL OR url = '') AS no_url, count(*) FILTER (WHERE html IS NULL) AS no_content, count(*) FILTER (WHERE trim(html) = '') AS blank FROM pages")
def data_quality(spark, d):
    p = table(spark, d, "pages")
    return p.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("url"), F.lit("")) == "").alias("no_url"), F.count_if(F.col("html").isNull()).alias("no_content"), F.count_if(F.trim("html") == "").alias("blank"))


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t\r]*\n'), lambda x: trim(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x <> '') AS ps FROM documents),
c AS (SELECT doc_id, flatten(list_transform(ps, lambda x: list_transform(range(0, (length(x) - 1) // 2000 + 1), lambda i: substring(x, (i * 2000 + 1)::BIGINT, 2000)))) AS cs FROM p)
SELECT doc_id, generate_subscripts(cs, 1) - 1 AS chunk_index, md5(unnest(cs)) AS chunk FROM c""")
def chunk_paragraphs(spark, d):
    return T.paragraphs(table(spark, d, "documents")).select("doc_id", "chunk_index", F.md5("chunk_text").alias("chunk"))


@query("SELECT doc_id, pos AS line_no, md5(line) AS line FROM (SELECT doc_id, unnest(string_split(text, E'\\n')) AS line, generate_subscripts(string_split(text, E'\\n'), 1) AS pos FROM documents) WHERE trim(line) <> ''")
def chunk_lines(spark, d):
    return T.lines(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "line_no", F.md5("line").alias("line"))


@query("""SELECT conv_id, md5(string_agg(role || ': ' || text, E'\\n' ORDER BY turn)) AS rendered, count(*) AS turns FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def conversation_render(spark, d):
    c = table(spark, d, "conversations").where(F.trim("text") != "").select("conv_id", F.col("turn").alias("chunk_index"), F.concat("role", F.lit(": "), "text").alias("chunk_text"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text")))
    return c.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(parts, lambda p: p["chunk_text"]), "\n")).alias("rendered"), F.count("*").alias("turns"))


@query("SELECT conv_id, turn, coalesce(lag(turn) OVER w, -1) AS prev, coalesce(lead(turn) OVER w, -1) AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_links(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.lag("turn").over(w), F.lit(-1)).alias("prev"), F.coalesce(F.lead("turn").over(w), F.lit(-1)).alias("next"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PARTS = r"list_filter(list_transform(string_split(text, ';'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query(rf"""SELECT doc_id, {' OR '.join(f"contains({_LOWER}, '{x}')" for x in T.SECRET_FRAGMENTS)}
 OR regexp_matches(text, '(?m)^[^\S\n]*[A-Z_][A-Z0-9_]*[^\S\n]*=[^\S\n]*\S') OR regexp_matches(text, '(?:^|[^A-Za-z0-9_-])(?:{'|'.join(T.BARE_PREFIXES)})[A-Za-z0-9_-]{{20}}')
 OR regexp_matches(text, '-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----') OR regexp_matches(text, '[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@[^\s/]+')
 OR (len({_PARTS}) >= 2 AND len(list_filter({_PARTS}, lambda s: NOT regexp_matches(s, '^([A-Za-z0-9_-]+=\S+|[A-Za-z0-9]+)$'))) = 0
  AND len(list_filter({_PARTS}, lambda s: contains(s, '=') AND strlen(regexp_replace(s, '^[^=]*=', '')) >= 16)) > 0) AS secret FROM documents""")
def secret_detection(spark, d):
    return table(spark, d, "documents").select("doc_id", T.contains_secret(F.col("text")).alias("secret"))


@query()
def secret_redaction(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.redact(F.col("text"))).alias("redacted"), (T.redact(F.col("text")) != F.col("text")).alias("changed"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g')) AS clean FROM documents")
def whitespace_cleanup(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.squeeze(F.col("text"))).alias("clean"))


@query("""WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS c, length(text) AS n FROM benchmark), f AS (SELECT item_id, c, count(*) / any_value(n) AS p FROM c GROUP BY item_id, c)
SELECT item_id, round(-sum(p * log2(p)), 9) AS bits FROM f GROUP BY item_id""")
def text_entropy(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.round(T.entropy(F.col("text")), 9).alias("bits"))


@query("SELECT event_type AS kind, json_extract_string(props, '$.k') AS status, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def active_by_kind(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("status")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events GROUP BY user_id")
def most_valuable_event(spark, d):
    return R.keep_best(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "value", "event_id")


@query("SELECT user_id, epoch(max(ts) - min(ts)) AS span_s, count(*) / nullif(epoch(max(ts) - min(ts)), 0) AS rate FROM events GROUP BY user_id")
def duration_and_rate(spark, d):
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return table(spark, d, "events").groupBy("user_id").agg(span.alias("span_s"), (F.count("*") / F.nullif(span, F.lit(0.0))).alias("rate"))


@query("SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return S.tumbling(table(spark, d, "events"), "1 day")


@query("""SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 hours, ts), time_bucket(INTERVAL 12 hours, ts) - INTERVAL 12 hours]) AS s FROM events) GROUP BY ALL""")
def events_sliding(spark, d):
    return S.sliding(table(spark, d, "events"), "24 hours", "12 hours")


@query("""WITH g AS (SELECT user_id, ts, sum(CASE WHEN ts - prev < INTERVAL 6 hours THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
 FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 hours AS "end", count(*) AS n FROM g GROUP BY user_id, s""")
def events_sessions(spark, d):
    return S.sessions(table(spark, d, "events"), "6 hours")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def events_sequence(spark, d):
    return S.sequenced(table(spark, d, "events")).select("event_id", "user_id", "sequence")


@query("""SELECT event_id, round(least(greatest((0.45 * (value - floor(value)) + 0.20 * 0.5 + 0.15 * 0.4 + 0.10 + 0.10 * least(ln(1 + user_id) / 5, 1))
 * CASE WHEN user_id % 7 = 0 OR event_id % 6 = 5 THEN 1 ELSE power(0.5, greatest(epoch(TIMESTAMP '2024-02-01' - ts) / 86400.0, 0) / [1, 7, 30, 180, 730, 1][(event_id % 6 + 1)::INT]) END
 - CASE user_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 WHEN 3 THEN 0.25 ELSE 0 END, 0), 1), 9) AS score FROM events""")
def memory_scores(spark, d):
    """Profiles and states go round with the ids; every seventh user's memories are pinned."""
    e = table(spark, d, "events")
    pick = lambda key, *names: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))
    age = (F.unix_timestamp(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) / 86400
    decayed = L.decay(age, L.half_life(pick("event_id", "very_fast", "fast", "normal", "slow", "very_slow", "none")), F.col("user_id") % 7 == 0)
    status = pick("user_id", "forgotten", "superseded", "archived", "contradicted", "active", "working")
    score = L.memory_score(F.col("value") - F.floor("value"), F.lit(0.5), F.lit(0.4), F.lit(1.0), F.col("user_id"), decayed, status)
    return e.select("event_id", F.round(score, 9).alias("score"))


_EDGES = "e AS (SELECT DISTINCT o_custkey AS src, o_custkey % 97 AS dst FROM orders)"


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN (SELECT src, dst FROM e UNION SELECT dst, src FROM e) e ON e.src = r.node WHERE r.depth < 3)
SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def graph_traverse(spark, d):
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") % 97).alias("dst"))
    return L.traverse(edges, spark.range(1, 2).select(F.col("id").alias("node")), 3, both=True)


_KINDED = "e AS (SELECT o_orderkey AS edge_id, o_orderpriority AS kind, o_custkey AS src, o_orderkey % 89 AS dst FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW'))"


@query(f"""WITH RECURSIVE {_KINDED}, r AS (SELECT 7::BIGINT AS node, 0 AS depth UNION SELECT CASE WHEN e.src = r.node THEN e.dst ELSE e.src END, r.depth + 1 FROM r JOIN e ON e.src = r.node OR e.dst = r.node WHERE r.depth < 1),
n AS (SELECT node, min(depth) AS depth FROM r GROUP BY node), m AS (SELECT e.*, min(n.depth) AS depth FROM e JOIN n ON n.node = e.src OR n.node = e.dst GROUP BY ALL)
SELECT * FROM m WHERE (depth, edge_id) > (0, 40) ORDER BY depth, edge_id LIMIT 500""")
def graph_edge_page(spark, d):
    """Orders pass for edges of their priority's kind; a page of those within two steps of a node."""
    edges = table(spark, d, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 89).alias("dst"))
    met = L.reached_edges(edges, spark.range(7, 8).select(F.col("id").alias("node")), 2, "both", ["1-URGENT", "2-HIGH", "5-LOW"])
    return L.edge_page(met, 500, (0, 40))


@query("""SELECT user_id % 10 AS node_id, arg_max(a, r) AS authority, least(max(value), 1) AS confidence, list_sort(list(DISTINCT event_type)) AS source_ids, arg_max(event_id, ts) AS label FROM
 (SELECT *, CASE event_id % 8 WHEN 0 THEN 'unknown' WHEN 1 THEN 'community' WHEN 2 THEN 'mirror' WHEN 3 THEN 'inferred' WHEN 4 THEN 'verified' WHEN 5 THEN 'official' WHEN 6 THEN 'user_pinned' END AS a,
  CASE event_id % 8 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 5 WHEN 6 THEN 6 ELSE 0 END AS r FROM events WHERE event_id % 8 <= user_id % 8) GROUP BY 1""")
def graph_merge_nodes(spark, d):
    e = table(spark, d, "events").where("event_id % 8 <= user_id % 8")
    names = ["unknown", "community", "mirror", "inferred", "verified", "official", "user_pinned"]
    authority = F.try_element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 8 + 1).cast("int"))
    return L.merge_nodes(e.select((F.col("user_id") % 10).alias("node_id"), authority.alias("authority"), F.col("value").alias("confidence"), F.col("event_type").alias("source_id"), F.col("event_id").alias("label"), F.col("ts").alias("updated_at")))


@query("""SELECT event_id, greatest(0, user_id % 6 - least(4, floor(greatest(epoch(TIMESTAMP '2024-01-15') - floor(epoch(ts)), 0) / 3600)))::INT AS effective FROM events""")
def priority_aging(spark, d):
    jobs = table(spark, d, "events").select("event_id", (F.col("user_id") % 6).cast("int").alias("priority"), F.col("ts").cast("timestamp").alias("created_at"))
    return L.claim_order(jobs, F.lit("2024-01-15").cast("timestamp"), quantum_s=3600).select("event_id", "effective")


@query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3")
def retention_newest(spark, d):
    return L.newest(table(spark, d, "events"), "user_id", "event_id", 3).select("event_id", "user_id", "ts")


@query("SELECT doc_id, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def keyset_page(spark, d):
    return R.page_after(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 100, 50)


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars < 200) AS thin, round(100.0 * count(*) FILTER (WHERE n_chars < 200) / count(*), 2) AS thin_rate, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY source")
def thin_documents(spark, d):
    thin = F.count_if(F.col("n_chars") < 200)
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), thin.alias("thin"), F.round(100.0 * thin / F.count("*"), 2).alias("thin_rate"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


_LATER_HTML = "CASE page_id % 6 WHEN 0 THEN html || '<div class=\"cf-turnstile\">' WHEN 1 THEN '' WHEN 2 THEN 'thin' WHEN 3 THEN html || '!' ELSE html END"


@query(f"""WITH p AS (SELECT page_id, html, {_LATER_HTML} AS h FROM pages)
SELECT page_id, CASE WHEN page_id % 6 = 0 AND strlen(h) < 100000 THEN 'challenged' WHEN coalesce(h, '') = '' THEN 'empty' WHEN strlen(h) < 1500 THEN 'thin' WHEN page_id % 6 <> 3 AND page_id % 7 <> 0 AND page_id % 6 <> 0 THEN 'reused' ELSE 'write' END AS verdict FROM p""")
def page_verdicts(spark, d):
    """The last run knows six of seven pages; some have changed since, some are challenges, empty or thin."""
    pages = table(spark, d, "pages")
    last = pages.where("page_id % 7 <> 0").select("page_id", F.sha2("html", 256).alias("content_hash"))
    now = pages.selectExpr("page_id", f"{_LATER_HTML} AS html")
    return P.page_verdicts(now, last, "page_id", F.col("html"), F.col("html"), 1500).select("page_id", "verdict")


@query("""SELECT vec_id, len(embedding) = 64 AS dims_ok, len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS finite, count(*) OVER (PARTITION BY vec_id) = 1 AS alone FROM embeddings""")
def validate_vectors(spark, d):
    e = table(spark, d, "embeddings")
    once = e.groupBy("vec_id").agg((F.count("*") == 1).alias("alone"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.join(once, "vec_id").select("vec_id", (F.size("embedding") == 64).alias("dims_ok"), finite.alias("finite"), "alone")


@query("""WITH k AS (SELECT source AS name, sha256(text) AS key, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL)
SELECT name, sum(n)::BIGINT AS points, count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1) AS duplicate_groups, sum(n - 1)::BIGINT AS duplicate_points,
       round(100.0 * sum(n - 1) / sum(n), 2) AS duplicate_rate FROM k GROUP BY name""")
def duplicate_breakdown(spark, d):
    return P.duplicate_breakdown(table(spark, d, "documents"), F.col("source"), F.sha2("text", 256))


@query("""SELECT count(*) AS total, count(ts) AS timed, count(*) - count(ts) AS untimed, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-13') AS stale,
       coalesce(round(100.0 * count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-13') / nullif(count(ts), 0), 2), 0) AS stale_rate,
       epoch(min(ts)) AS oldest, epoch(max(ts)) AS newest FROM events""")
def stale_events(spark, d):
    found = P.staleness(table(spark, d, "events"), F.col("ts").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"), 7)
    seconds = {c: F.unix_micros(c) / 1e6 for c in ("oldest", "newest")}
    return found.withColumns(seconds)


@query("""SELECT count(*) FILTER (WHERE l IS NULL) AS added, count(*) FILTER (WHERE k IS NULL) AS removed, count(*) FILTER (WHERE k IS NOT NULL AND l IS NOT NULL) AS unchanged
FROM (SELECT DISTINCT doc_id AS k FROM documents) FULL JOIN (SELECT DISTINCT doc_id AS l FROM labels) ON k = l""")
def set_audit(spark, d):
    """Labelled ids against all ids."""
    return P.set_audit(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id")


@query("""SELECT epoch(TIMESTAMP '2024-03-01') - floor(epoch(min(ts))) AS waited_s FROM events WHERE event_type = 'click' AND user_id % 2 = 1
HAVING count(*) > 0""")
def starvation_probe(spark, d):
    """Clicks pass for interactive jobs, those of odd users for queued ones; none runs."""
    e = table(spark, d, "events")
    priority, status = F.when(F.col("event_type") == "click", "interactive").otherwise("background"), F.when(F.col("user_id") % 2 == 1, "queued").otherwise("done")
    jobs = e.select(priority.alias("priority"), status.alias("status"), F.col("ts").cast("timestamp").alias("created_at"))
    return P.starved(jobs, F.lit("2024-03-01").cast("timestamp"), 60)


@query("SELECT event_id, user_id FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-20', 500) ORDER BY ts DESC, event_id DESC LIMIT 50")
def history_page(spark, d):
    cursor = (F.lit("2024-01-20").cast("timestamp"), F.lit(500))
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return P.page_before(e, "ts", "event_id", cursor, 50).select("event_id", "user_id")


@query("SELECT lines, count(*) AS documents FROM (SELECT len(string_split(text, E'\\n')) AS lines FROM documents WHERE text IS NOT NULL) GROUP BY lines")
def line_distribution(spark, d):
    """How many documents have each number of lines."""
    lines = F.size(F.split("text", "\n", -1)).alias("lines")
    return table(spark, d, "documents").where("text IS NOT NULL").select(lines).groupBy("lines").agg(F.count("*").alias("documents"))


_JOBS = "SELECT o_orderkey AS job_id, o_custkey AS watch_id, CASE WHEN o_orderkey % 301 = 0 THEN 'running' WHEN o_orderkey % 97 = 0 THEN 'queued' ELSE 'completed' END AS status FROM orders"


@query(f"""WITH w AS (SELECT c_custkey AS watch_id, c_custkey % 200 AS source_id, c_custkey % 7 <> 0 AS enabled, 10 + c_custkey % 60 AS every_seconds, c_custkey * 100 % 7919 AS next_run_at, CASE WHEN c_custkey % 5 = 0 THEN 5000 + c_custkey % 2 * 2000 END AS lease FROM customer),
j AS ({_JOBS}), a AS (SELECT * FROM j WHERE status <> 'completed'),
able AS (SELECT * FROM w WHERE enabled AND every_seconds >= 30 AND next_run_at <= 6000 AND (lease IS NULL OR lease < 6000))
SELECT source_id, next_run_at, watch_id FROM able w WHERE watch_id = (SELECT x.watch_id FROM able x WHERE x.source_id = w.source_id ORDER BY next_run_at, watch_id LIMIT 1)
 AND source_id NOT IN (SELECT w.source_id FROM a JOIN w ON w.watch_id = a.watch_id WHERE a.job_id % 97 <> 0) AND watch_id NOT IN (SELECT watch_id FROM a WHERE job_id % 97 = 0)
ORDER BY next_run_at, watch_id LIMIT 50""")
def due_watches(spark, d):
    """Customers pass for watches, orders for their jobs; every 97th job is known by its key alone."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    lease = F.when(k % 5 == 0, 5000 + k % 2 * 2000).alias("lease_expires_at")
    watches = table(spark, d, "customer").select(k.alias("watch_id"), (k % 200).alias("source_id"), (k % 7 != 0).alias("enabled"), (10 + k % 60).alias("every_seconds"), (k * 100 % 7919).alias("next_run_at"), lease)
    orders = table(spark, d, "orders")
    status = F.when(o % 301 == 0, "running").when(o % 97 == 0, "queued").otherwise("completed")
    key = F.when(o % 97 == 0, F.concat(F.lit("source-watch:"), "o_custkey", F.lit(":"), "o_orderkey"))
    jobs = orders.select(o.alias("job_id"), status.alias("status"), key.alias("idempotency_key"))
    runs = orders.where(o % 97 != 0).select(o.alias("job_id"), F.col("o_custkey").alias("watch_id"))
    return J.due_watches(watches, runs, jobs, F.lit(6000), 50)


@query("""SELECT event_id, user_id FROM events WHERE ts >= CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 50) THEN TIMESTAMP '2024-01-10' ELSE TIMESTAMP '2024-01-20' END""")
def event_retention(spark, d):
    """Users pass for jobs; one with an error of a value above 50 has failed."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("timestamp"), "event_type", "value")
    jobs = e.where("event_type = 'error' AND value > 50").select("job_id", F.lit("failed").alias("status"))
    at = [F.lit(x).cast("timestamp") for x in ("2024-01-20", "2024-01-10")]
    return J.events_kept(e, jobs, *at).select("event_id", F.col("job_id").alias("user_id"))


@query("""WITH a AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'A'), b AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F')
SELECT l_orderkey AS page_id, l_partkey AS href, 'added' AS change FROM b WHERE (l_orderkey, l_partkey) NOT IN (SELECT (l_orderkey, l_partkey) FROM a)
UNION ALL SELECT l_orderkey, l_partkey, 'removed' FROM a WHERE (l_orderkey, l_partkey) NOT IN (SELECT (l_orderkey, l_partkey) FROM b)""")
def link_changes(spark, d):
    """Orders pass for pages, their parts for links; the versions hold lines of other flags and states."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("href"), "l_returnflag", "l_linestatus")
    before, after = lines.where("l_returnflag <> 'A'"), lines.where("l_linestatus = 'F'")
    return J.link_changes(before.select("page_id", "href"), after.select("page_id", "href"))


@query("SELECT doc_id, 1 AS generation FROM documents UNION ALL SELECT doc_id, 2 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def generation_carry(spark, d):
    """Labelled documents did not change: they are carried into the second generation."""
    points = table(spark, d, "documents").select("doc_id", F.lit(1).cast("long").alias("generation"))
    return J.carried(points, table(spark, d, "labels"), "doc_id", 2)


@query("""SELECT user_id, ['public', 'derived', 'internal', 'redacted', 'sensitive'][(max(event_id % 5) + 1)::INT] AS visibility, max(value) AS confidence FROM events GROUP BY user_id""")
def memory_compaction(spark, d):
    """Every user's events become one record: the greatest confidence, the most restrictive visibility."""
    names = F.array(*map(F.lit, J.VISIBILITIES))
    e = table(spark, d, "events").select("user_id", "value", F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("visibility"))
    return e.groupBy("user_id").agg(J.most_restrictive(F.col("visibility")).alias("visibility"), F.max("value").alias("confidence"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r > 3 AND o_orderstatus <> 'O'""")
def generations_prunable(spark, d):
    """Orders pass for generations of their customer; an open one is current."""
    g = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "O").alias("current"))
    return J.prunable(g, "o_custkey", "o_orderkey", "current", 3).select("o_custkey", "o_orderkey")


@query("""WITH c AS (SELECT DISTINCT doc_id AS k FROM documents), v AS (SELECT vec_id AS k, count(*) AS n, max(len(embedding)) AS most, min(len(embedding)) AS least FROM embeddings GROUP BY vec_id)
SELECT coalesce(c.k, v.k) AS chunk_id, CASE WHEN v.k IS NULL THEN 'missing' WHEN c.k IS NULL THEN 'unexpected' WHEN n > 1 THEN 'duplicate' WHEN most <> 64 OR least <> 64 THEN 'wrong_dimension' ELSE 'ok' END AS verdict FROM c FULL JOIN v ON c.k = v.k""")
def embedding_audit(spark, d):
    """Documents pass for chunks; vectors are theirs by id."""
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return J.embedding_audit(chunks, vectors, "chunk_id", "embedding", 64)


@query("""SELECT conv_id, md5(trim(string_agg(text, E'\\n' ORDER BY CASE WHEN turn % 4 = 3 THEN 1 ELSE 0 END, CASE WHEN turn % 4 <> 3 THEN turn END, text))) AS rendered FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def document_render(spark, d):
    """Turns pass for chunks; every fourth has no index and comes last."""
    c = table(spark, d, "conversations").select("conv_id", F.when(F.col("turn") % 4 != 3, F.col("turn")).alias("at"), "text")
    return J.rendered(c, "conv_id", "at", "text").select("conv_id", F.md5("text").alias("rendered"))
