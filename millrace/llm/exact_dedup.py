"""Exact deduplication by progressive refinement: length, then a prefix hash, then a full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stored, text_rows

PREFIX_CHARS = 64

#: Rows of a group are dealt over so many tasks.
SALTS = 256


def exact_groups(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Each row of docs as (doc_id, keep_id, group_size, kept, text_sha256): rows of equal text form a group.

    Lengths held by one row need no further look; of the rest, lengths and prefix hashes held by one row are done; only
    what is left is grouped by SHA-256 of the whole text. Every row is asked for its SHA-256, so it is taken where the
    text is read and no text is sent on. Rows carry a salt: counts by (key, salt) come first and give those by key, and
    what a key is found to be goes back to its salts, so a group with a third of all rows is spread over many tasks. The largest doc_id of a group stays.
    A null text is the empty text. A null doc_id is smaller than any other. Rows that repeat a doc_id count
    each in group_size, and are kept together. An empty table gives an empty result; columns other than
    doc_id and text play no part.
    """
    text = F.coalesce("text", F.lit(""))
    light = text_rows(docs).select(
        "doc_id",
        F.octet_length(text).alias("len"),
        F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix"),
        F.sha2(text, 256).alias("text_sha256"),
    )
    light = stored(light.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "digests")
    dealt = stored(light.groupBy("len", "prefix", "salt").agg(F.count("*").alias("n")), "prefix-counts")
    by_prefix = dealt.groupBy("len", "prefix").agg(F.sum("n").alias("n"))
    by_len = by_prefix.groupBy("len").agg(F.sum("n").alias("rows")).where("rows > 1").select("len")
    survivors = by_prefix.where("n > 1").join(by_len, "len", "left_semi").select("len", "prefix")
    where = dealt.select("len", "prefix", "salt").join(survivors, ["len", "prefix"], "left_semi")
    parts = (
        light.join(where, ["len", "prefix", "salt"], "left_semi")
        .groupBy("len", "text_sha256", "salt")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    parts = stored(parts, "text-counts")
    whole = parts.groupBy("len", "text_sha256").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = parts.select("len", "text_sha256", "salt").join(whole.where("group_size > 1"), ["len", "text_sha256"])
    return light.join(groups, ["len", "text_sha256", "salt"], "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs without the rows that lose to an equal text; all columns stay."""
    losers = exact_groups(docs).where("not kept").select("doc_id").where("doc_id is not null").distinct()
    return docs.join(losers, "doc_id", "left_anti")
