"""Watches, job events and generations: what is due, what is kept, what is carried on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States in which a job has ended; visibilities from the least restrictive to the most.
ENDED = ["completed", "completed_degraded", "failed", "canceled", "expired", "skipped"]
VISIBILITIES = ["public", "derived", "internal", "redacted", "sensitive"]
LEAST_PERIOD_S = 30
#: Links of one task on average; rows of a repeated link that are made at a time.
LINKS_A_TASK, COPIES = 1_000_000, 10_000


def due_watches(watches: DataFrame, runs: DataFrame, jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    """The watches to lease at `now` (milliseconds), the longest due first: one a source, the earliest by (next_run_at,
    watch_id), unless a job of that source still runs or one keyed 'source-watch:<watch_id>:...' does. Watch ids hold no colon.

    All joins are by equality; a source with very many watches is reduced by a partial minimum, not by a window."""
    free = F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < now)
    able = watches.where(F.col("enabled") & (F.col("every_seconds") >= LEAST_PERIOD_S) & (F.col("next_run_at") <= now) & free)
    first = able.groupBy("source_id").agg(F.min(F.struct("next_run_at", "watch_id")).alias("w")).select("source_id", "w.*")
    active = jobs.where(~F.col("status").isin(ENDED))
    busy = runs.join(active, "job_id", "left_semi").join(watches.select("watch_id", "source_id"), "watch_id").select("source_id").distinct()
    key = F.col("idempotency_key")
    keyed = active.where(key.startswith("source-watch:") & (F.size(F.split(key, ":")) > 2)).select(F.split_part(key, F.lit(":"), F.lit(2)).alias("text_id")).distinct()
    idle = first.join(busy, "source_id", "left_anti").withColumn("text_id", F.col("watch_id").cast("string")).join(keyed, "text_id", "left_anti")
    return idle.drop("text_id").orderBy("next_run_at", "watch_id").limit(limit)


def events_kept(events: DataFrame, jobs: DataFrame, cutoff: Column, failed_cutoff: Column) -> DataFrame:
    """Events at or after the cutoff of their job: failed jobs keep theirs by failed_cutoff, all others by cutoff."""
    failed = jobs.where("status = 'failed'").select("job_id", F.lit(True).alias("failed")).distinct()
    marked = events.join(failed, "job_id", "left")
    return marked.where(F.col("timestamp") >= F.when(F.col("failed"), failed_cutoff).otherwise(cutoff)).drop("failed")


def link_changes(before: DataFrame, after: DataFrame, page: str = "page_id", href: str = "href") -> DataFrame:
    """(page, href, change): links of each page that came or went between two versions; a link listed twice is reported twice. Nulls are equal.

    Both versions are dealt together, LINKS_A_TASK of their links to a task on average, and counted once: no task grows with the tables."""
    both = before.select(page, href, F.lit(1).alias("old")).union(after.select(page, href, F.lit(0)))
    tasks = max(-(-both.count() // LINKS_A_TASK), int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = both.repartition(tasks, page, href).groupBy(page, href).agg(F.count("*").alias("n"), F.sum("old").alias("old")).where("old = 0 or old = n")
    part = n.select(page, href, F.when(F.col("old") == 0, "added").otherwise("removed").alias("change"), "n", F.explode(F.expr(f"sequence(0, (n - 1) div {COPIES})")).alias("part"))
    copies = F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES))
    return part.select(page, href, "change", F.explode(copies).alias("copy")).drop("copy")


def carried(points: DataFrame, unchanged: DataFrame, key: str, generation: int) -> DataFrame:
    """points and copies, in the new generation, of those whose item did not change."""
    copies = points.join(unchanged.select(key).distinct(), key, "left_semi").withColumn("generation", F.lit(generation).cast("long"))
    return points.unionByName(copies)


def most_restrictive(visibility: Column) -> Column:
    """Aggregate: the most restrictive visibility, internal if there is none."""
    rank = F.array_position(F.array(*map(F.lit, VISIBILITIES)), visibility)
    return F.coalesce(F.max_by(visibility, rank), F.lit("internal"))


def prunable(generations: DataFrame, source: str, sequence: str, current: str, keep: int) -> DataFrame:
    """Generations beyond the newest `keep` of their source; the current one always stays."""
    newest = Window.partitionBy(source).orderBy(F.desc(sequence))
    return generations.withColumn("place", F.row_number().over(newest)).where((F.col("place") > keep) & ~F.col(current)).drop("place")


def embedding_audit(chunks: DataFrame, vectors: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """(key, verdict) of each key on either side: missing, unexpected, duplicate, wrong_dimension, not_finite or ok."""
    bad = ~F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    per = vectors.groupBy(key).agg(F.count("*").alias("n"), F.max((F.size(vector) != dimensions).cast("int")).alias("sized"), F.max(bad.cast("int")).alias("bad"))
    both = chunks.select(key, F.lit(True).alias("known")).distinct().join(per, key, "full")
    verdict = F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    verdict = verdict.when(F.col("sized") == 1, "wrong_dimension").when(F.col("bad") == 1, "not_finite").otherwise("ok")
    return both.select(key, verdict.alias("verdict"))


def rendered(points: DataFrame, document: str, index: str, text: str) -> DataFrame:
    """(document, text): chunks in order of index, those without one last, blank ones left out, joined by line feeds, trimmed."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(index).isNull().alias("late"), F.col(index).alias("at"), F.col(text).alias("t"))))
    whole = F.array_join(F.transform(parts, lambda p: p["t"]), "\n")
    return points.where(F.trim(text) != "").groupBy(document).agg(F.trim(whole).alias("text"))
