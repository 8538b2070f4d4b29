"""Reports over stored points and jobs: duplicates by group, staleness, set audits, starvation, pages by a composite key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T


def duplicate_breakdown(points: DataFrame, group: Column, key: Column) -> DataFrame:
    """Per group: points, distinct keys, keys of several points, points beyond the first of a key, their share in per cent.

    Counted by (group, key) first, so a large group is spread over its keys."""
    by_key = points.where(key.isNotNull()).groupBy(group.alias("name"), key.alias("key")).agg(F.count("*").alias("n"))
    points_, extra = F.sum("n"), F.sum(F.col("n") - 1)
    return by_key.groupBy("name").agg(
        points_.alias("points"),
        F.count("*").alias("distinct_keys"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        extra.alias("duplicate_points"),
        F.round(100.0 * extra / points_, 2).alias("duplicate_rate"),
    )


def staleness(points: DataFrame, at: Column, now: Column, days: int) -> DataFrame:
    """One row: points with and without a time, those older than `days`, their share in per cent (0 without any), the ends."""
    timed, stale = F.count(at), F.count_if(at < now - F.make_dt_interval(F.lit(days)))
    return points.agg(
        F.count("*").alias("total"),
        timed.alias("timed"),
        (F.count("*") - timed).alias("untimed"),
        stale.alias("stale"),
        F.coalesce(F.round(100.0 * stale / F.nullif(timed, F.lit(0)), 2), F.lit(0.0)).alias("stale_rate"),
        F.min(at).alias("oldest"),
        F.max(at).alias("newest"),
    )


def set_audit(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: how many distinct keys came, went and stayed; one shuffle for both sides."""
    marked = before.select(key, F.lit(1).alias("side")).unionByName(after.select(key, F.lit(2).alias("side")))
    sides = marked.groupBy(key).agg(F.bit_or("side").alias("sides"))
    return sides.agg(*[F.count_if(F.col("sides") == s).alias(n) for s, n in ((2, "added"), (1, "removed"), (3, "unchanged"))])


def starved(jobs: DataFrame, now: Column, slo_s: int) -> DataFrame:
    """The wait of the oldest queued interactive job, if it reached slo_s and none runs; else, and for slo_s <= 0, no row."""
    queued = F.min(F.when(F.col("status") == "queued", F.col("created_at")))
    found = jobs.where("priority = 'interactive'").agg(F.count_if(F.col("status") == "running").alias("running"), queued.alias("oldest"))
    waited = F.unix_timestamp(now) - F.unix_timestamp("oldest")
    return found.where((F.lit(slo_s) > 0) & (F.col("running") == 0)).select(waited.alias("waited_s")).where(F.col("waited_s") >= slo_s)


def page_before(df: DataFrame, at: str, key: str, cursor: tuple[Column, Column], limit: int) -> DataFrame:
    """The next page, newest first, after the cursor (at, key)."""
    last_at, last_key = cursor
    older = (F.col(at) < last_at) | ((F.col(at) == last_at) & (F.col(key) < last_key))
    return df.where(older).orderBy(F.desc(at), F.desc(key)).limit(limit)


def page_verdicts(pages: DataFrame, previous: DataFrame, key: str, body: Column, content: Column, least_bytes: int) -> DataFrame:
    """pages with verdict, vendor and content_hash: challenged if the body is a bot wall's, else empty without content, thin below least_bytes, reused
    if the last run (key, content_hash) has the same content, else write."""
    found = pages.withColumns({"vendor": T.challenge(body), "content_hash": F.sha2(content, 256), "_bytes": F.octet_length(F.coalesce(content, F.lit("")))})
    last = previous.groupBy(key).agg(F.first("content_hash").alias("_last"))
    verdict = (
        F.when(F.col("vendor").isNotNull(), "challenged")
        .when(F.col("_bytes") == 0, "empty")
        .when(F.col("_bytes") < least_bytes, "thin")
        .when(F.col("_last") == F.col("content_hash"), "reused")
        .otherwise("write")
    )
    return found.join(last, key, "left").withColumn("verdict", verdict).drop("_last", "_bytes")


#: The fields of a point that are looked at, the type each should have, and other names of one.
AUDITED = {"url": "STRING", "chunk_text": "STRING", "chunk_index": "BIGINT", "title": "STRING", "scraped_at": "STRING"}
ALIASES = {"scraped_at": ["scrapedAt", "file_modified_at", "fileModifiedAt"]}


def payload_schema(points: DataFrame, payload: str) -> DataFrame:
    """(field, present, missing, type_mismatch, total): over all points, whether their VARIANT payload has each field, or one of its other names, and of
    the right type. Null is missing; truth values pass for whole numbers."""

    def kind(field: str) -> Column:
        held = [F.try_variant_get(payload, f"$.{name}", "variant") for name in [field, *ALIASES.get(field, [])]]
        return F.coalesce(*[F.when(F.schema_of_variant(v) != "VOID", F.schema_of_variant(v)) for v in held])

    each = points.select(*[kind(f).alias(f) for f in AUDITED])
    right = lambda f: F.col(f).isin(AUDITED[f], *(["BOOLEAN"] if AUDITED[f] == "BIGINT" else []))
    sums = [x for f in AUDITED for x in (F.count_if(right(f)).alias(f"{f}_right"), F.count(f).alias(f"{f}_held"))]
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_right").alias("present"), (F.col("total") - F.col(f"{f}_held")).alias("missing"), (F.col(f"{f}_held") - F.col(f"{f}_right")).alias("type_mismatch"), "total") for f in AUDITED])
    return each.agg(F.count("*").alias("total"), *sums).select(F.inline(rows))
