"""Queries of retrieval for answers and of prepared documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import answers as A
from millrace.operators import ledger as L
from millrace.operators import payloads as P
from millrace.plans.registry import _DENSE, _EVERY, query
from millrace.sources.tables import table

#: What a vector's point holds: some lack a job, others sit in a kind that is not shown.
_PAYLOAD = (
    "'{\"source_generation\":1,\"job_id\":\"' || CASE WHEN vec_id % 11 = 0 THEN 'none' ELSE '00000000-0000-0000-0000-000000000001' END || '\",\"redaction_status\":\"clean\",\"visibility\":\"public\",\"redaction_version\":\"v\",\"redacted_field_count\":0,\"dropped_field_count\":0,\"detector_count\":0,"
    "\"detector_names\":[],\"chunk_locator\":{\"canonical_uri\":\"https://h' || label || '.io/' || vec_id || '\"},\"source_range\":{\"line_start\":' || vec_id || '}}'"
)
_TEXT = "repeat('word [S1] ', (vec_id % 40 + 1)::INT)"


@query(f"""WITH r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_DENSE} AND p.label <> 2) QUALIFY rank <= 20),
p AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, 10 * (id % 40 + 1) + 3 * (id % 40 + 1) AS n FROM r JOIN embeddings e ON e.vec_id = r.id WHERE label NOT IN (3, 5)),
c AS (SELECT *, (sum(n) OVER (PARTITION BY query_id ORDER BY place) + 2 * (place - 1))::BIGINT AS b FROM p), a AS (SELECT *, b <= 1000 AND ceil(b / 4.0) <= 240 AS admitted, min(b) OVER (PARTITION BY query_id) AS least FROM c)
SELECT query_id, place, id, round(score, 9) AS score, admitted, CASE WHEN id % 11 = 0 THEN 'missing_job_id' WHEN NOT (least <= 1000 AND ceil(least / 4.0) <= 240) THEN 'context_budget_too_small' END AS fault,
 CASE WHEN admitted AND id % 11 <> 0 THEN 'https://h' || label || '.io/' || id END AS canonical_uri, CASE WHEN admitted AND id % 11 <> 0 THEN id END AS line_start FROM a JOIN embeddings e ON e.vec_id = a.id""")
def retrieval_answers(spark, d):
    """Vectors pass for chunks of all labels but one; two labels are kinds that are not shown."""
    e = table(spark, d, "embeddings")
    points = e.selectExpr("vec_id AS id", "embedding AS v", "label", "CASE WHEN label IN (3, 5) THEN 'memory' ELSE 'web' END AS source_kind", f"{_TEXT.replace('(vec_id % 40 + 1)::INT', 'cast(vec_id % 40 + 1 AS int)')} AS text", "'c' AS chunk_id", "'d' AS document_id", "'s' AS source_id", "'k' AS source_item_key", f"parse_json({_PAYLOAD}) AS payload")
    queries = points.where(_EVERY).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    labels = [r[0] for r in e.select("label").distinct().collect() if r[0] is not None and r[0] != 2]  # few classes
    found = A.retrieve(points, queries, 20, {"label": labels}, ["memory"], 1000, 240)
    return found.select("query_id", "place", "id", F.round("score", 9).alias("score"), "admitted", "fault", "canonical_uri", F.col("anchors.line_start").alias("line_start"))


_URI = "CASE turn % 3 WHEN 0 THEN concat('https://User@Docs.h', conv_id % 5, '.io:8080/p?q') WHEN 1 THEN 'note' ELSE concat('http://x.io/', turn) END"
_BODY = "text || ' ## Sources [S2] [S] ## Top Chunk'"
_HOSTED = "CASE WHEN regexp_matches(uri, '^https?://') THEN regexp_extract(uri, '^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1) ELSE uri END"


@query(rf"""WITH h AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, {_URI} AS uri, {_BODY} AS body FROM conversations),
e AS (SELECT conv_id, rank, uri, {_HOSTED} AS source, '## Top Chunk [S' || rank || ']: ' || {_HOSTED} || chr(10) || chr(10) || '<retrieved_content trust="evidence_only">' || chr(10) || regexp_replace(replace(replace(body, '## Sources', '## ​Sources'), '## Top Chunk', '## ​Top Chunk'), '\[S([0-9]+)\]', '[​S\1]', 'g') || chr(10) || '</retrieved_content>' AS entry FROM h WHERE rank <= 4),
s AS (SELECT *, 9 + sum(strlen(entry)) OVER (PARTITION BY conv_id ORDER BY rank) + 7 * (rank - 1) <= 1500 AS fits FROM e)
SELECT conv_id, md5('Sources:' || chr(10) || coalesce(string_agg(entry, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) FILTER (WHERE fits), '')) AS context_md5, count(*) FILTER (WHERE fits) AS chunks,
 coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (WHERE fits AND source <> uri)), ','), '') AS domains, coalesce(string_agg(uri, ',' ORDER BY rank) FILTER (WHERE fits), '') AS urls FROM s GROUP BY conv_id""")
def answer_contexts(spark, d):
    """Turns pass for hits of their conversation."""
    rows = table(spark, d, "conversations").selectExpr("conv_id AS query_id", "cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS int) AS rank", f"{_URI} AS canonical_uri", f"{_BODY} AS text")
    out = A.ask_context(rows, 4, 1500)
    return out.select(F.col("query_id").alias("conv_id"), F.md5("context").alias("context_md5"), F.col("chunks").cast("long").alias("chunks"), F.array_join("domains", ",").alias("domains"), F.array_join("urls", ",").alias("urls"))


_DOCS = "o_orderkey AS document_id, CASE WHEN o_orderkey % 10 = 0 THEN ' ' ELSE 's' END AS source_id, CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE 'k' END AS source_item_key, {0} AS fields, o_orderkey % 7 + 3 AS lines"
_CHUNKS = "l_orderkey AS document_id, l_partkey % 300 AS chunk_id, l_suppkey % 40 AS chunk_key, CASE WHEN l_partkey % 60 = 0 THEN ' ' ELSE 'x' END AS content, {0} AS fields, l_linenumber AS line_start, CASE WHEN l_suppkey % 15 = 0 THEN 0 ELSE l_linenumber + 1 END AS line_end"
_DOC_FIELDS, _CHUNK_FIELDS = "CASE WHEN o_custkey % 9 = 0 THEN {0}('title', 'Raw_HTML') ELSE {0}('title') END", "CASE WHEN l_partkey % 33 = 0 THEN {0}('my_api_key') END"


def _fields(x: str) -> str:
    return f"len(list_filter(coalesce({x}, []), lambda f: " + " OR ".join(f"contains(lower(f), '{p}')" for p in P.FORBIDDEN_NAMES) + ")) > 0"


@query(f"""WITH d AS (SELECT {_DOCS.format(_DOC_FIELDS.format('list_value'))} FROM orders WHERE o_orderkey % 25 <> 1), c AS (SELECT {_CHUNKS.format(_CHUNK_FIELDS.format('list_value'))} FROM lineitem WHERE l_orderkey % 9 <> 2),
a AS (SELECT document_id, bool_or({_fields('fields')}) AS f, bool_or(trim(content) = '') AS b, bool_or(line_end < line_start) AS t, max(greatest(line_start, line_end)) AS hi, min(least(line_start, line_end)) AS lo, count(*) - count(DISTINCT chunk_id) > 0 AS di, count(*) - count(DISTINCT chunk_key) > 0 AS dk FROM c GROUP BY 1),
e AS (SELECT d.document_id, list_filter([CASE WHEN trim(source_id) = '' THEN 'source_id is empty' END, CASE WHEN source_item_key IS NULL THEN 'source_item_key is empty' END, CASE WHEN {_fields('fields')} THEN 'sensitive document metadata field' END, CASE WHEN a.document_id IS NULL THEN 'no chunks' END,
 CASE WHEN f THEN 'sensitive chunk metadata field' END, CASE WHEN di THEN 'duplicate chunk id' END, CASE WHEN dk THEN 'duplicate chunk key' END, CASE WHEN b THEN 'empty content' END, CASE WHEN t THEN 'range ends before it starts' END, CASE WHEN hi > lines OR lo < 1 THEN 'range outside the document' END], lambda x: x IS NOT NULL) AS faults FROM d LEFT JOIN a ON a.document_id = d.document_id)
SELECT document_id, array_to_string(faults, '; ') AS faults FROM e WHERE len(faults) > 0""")
def prepared_document_faults(spark, d):
    """Orders pass for documents, their lines for chunks."""
    docs = table(spark, d, "orders").where("o_orderkey % 25 <> 1").selectExpr(*_split(_DOCS.format(_DOC_FIELDS.format("array"))))
    chunks = table(spark, d, "lineitem").where("l_orderkey % 9 <> 2").selectExpr(*_split(_CHUNKS.format(_CHUNK_FIELDS.format("array"))))
    return L.prepared_faults(docs, chunks).select("document_id", F.array_join("faults", "; ").alias("faults"))


def _split(columns: str) -> list[str]:
    """The expressions of a list of columns; commas within brackets divide nothing."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
