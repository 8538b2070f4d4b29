"""What an answer is made from: hits that may be shown, their citations, and the context that fits a model's budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.operators import retrieval as R
from millrace.operators.structured import citations

#: What a context begins with, what stands between its entries, and how many citations an answer may have.
PREFIX, SEPARATOR, MOST_CITATIONS = "Sources:\n", "\n\n---\n\n", 256


def ask_context(hits: DataFrame, chunk_limit: int, most_bytes: int) -> DataFrame:
    """(query_id, context, chunks, domains, urls) of hits (query_id, rank, canonical_uri, text), ranked from 1.

    Entries are numbered as sources, with the host and the defanged text, in order of rank: at most chunk_limit of them, and none from the first
    on that would go beyond most_bytes. A query whose first entry does not fit has an empty list of sources."""
    limit = min(max(chunk_limit, 1), MOST_CITATIONS)
    source = F.when(U.host(F.col("canonical_uri")) != "", F.regexp_extract("canonical_uri", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)).otherwise(F.col("canonical_uri"))
    body = T.defang(F.coalesce("text", F.lit("")))
    entry = F.concat(F.lit("## Top Chunk [S"), F.col("rank").cast("string"), F.lit("]: "), source, F.lit('\n\n<retrieved_content trust="evidence_only">\n'), body, F.lit("\n</retrieved_content>"))
    each = hits.where(F.col("rank") <= limit).select("query_id", "rank", "canonical_uri", source.alias("source"), entry.alias("entry"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    size = len(PREFIX) + F.sum(F.octet_length("entry")).over(w) + len(SEPARATOR) * (F.col("rank") - 1)
    fits = each.withColumn("fits", size <= most_bytes)
    item = F.when(F.col("fits"), F.struct("rank", "entry", "source", "canonical_uri"))
    kept = fits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("e"))
    host = F.filter("e", lambda x: x["source"] != x["canonical_uri"])
    return kept.select(
        "query_id",
        F.concat(F.lit(PREFIX), F.array_join(F.transform("e", lambda x: x["entry"]), SEPARATOR)).alias("context"),
        F.size("e").alias("chunks"),
        F.array_sort(F.array_distinct(F.transform(host, lambda x: x["source"]))).alias("domains"),
        F.transform("e", lambda x: x["canonical_uri"]).alias("urls"),
    )


def retrieve(points: DataFrame, queries: DataFrame, k: int, wanted: dict[str, object], excluded_kinds: list[str], most_bytes: int, most_tokens: int) -> DataFrame:
    """(query_id, place, id, score, admitted, fault, canonical_uri, anchors) of the hits of queries (query_id, q) among points (id, v, source_kind, text,
    chunk_id, document_id, source_id, source_item_key, payload and the fields of wanted).

    The k nearest of the points that match wanted; then those of excluded kinds go, so fewer may be left. In their order, as many as both budgets
    hold are admitted to the context; only these carry a citation. fault is what a citation lacks, or that the context admits none."""
    found = R.dense_topk(R.matching(points, wanted), queries, k)
    fields = ["source_kind", "chunk_id", "document_id", "source_id", "source_item_key", "payload"]
    held = points.select("id", F.octet_length(T.defang(F.col("text"))).alias("bytes"), *fields)
    shown = found.join(held, "id").where(F.col("source_kind").isNull() | ~F.col("source_kind").isin(excluded_kinds) if excluded_kinds else F.lit(True))
    placed = shown.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    admitted = R.context(placed.select("query_id", F.col("place").alias("rank"), "bytes"), most_bytes, most_tokens).select("query_id", F.col("rank").alias("place"), F.lit(True).alias("admitted"))
    cited = citations(placed.select(F.struct("query_id", "place").alias("point_id"), *fields[1:])).select("point_id.*", "fault", "canonical_uri", "anchors")
    every = placed.select("query_id", "place", "id", "score").join(admitted, ["query_id", "place"], "left").join(cited, ["query_id", "place"])
    none = F.max(F.coalesce("admitted", F.lit(False))).over(Window.partitionBy("query_id"))
    own = F.coalesce("admitted", F.lit(False))
    return every.select(
        "query_id",
        "place",
        "id",
        "score",
        own.alias("admitted"),
        F.coalesce("fault", F.when(~none, "context_budget_too_small")).alias("fault"),
        F.when(own, F.col("canonical_uri")).alias("canonical_uri"),
        F.when(own, F.col("anchors")).alias("anchors"),
    )
