"""Jobs, documents and generations: valid states, claims, sweeps, counters, debts and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.payloads import forbidden_name

#: The states that may follow each state of a job.
TRANSITIONS = {
    "queued": ["blocked", "running", "failed", "canceling", "expired"],
    "pending": ["queued", "running", "failed", "canceling", "expired"],
    "blocked": ["queued", "running", "canceling", "failed", "expired"],
    "running": ["waiting", "canceling", "completed", "completed_degraded", "failed", "expired"],
    "waiting": ["running", "canceling", "failed", "expired"],
    "canceling": ["canceled", "failed"],
}
#: Priorities in the order they are served.
PRIORITIES = ["interactive", "high", "normal", "background", "maintenance"]


def may_become(before: Column, after: Column) -> Column:
    """Whether a job may go from one state to another; any may stay as it is."""
    out = before == after
    for state, following in TRANSITIONS.items():
        out |= (before == state) & after.isin(following)
    return F.coalesce(out, F.lit(False))


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that stand in several rows, with their number."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def claimable(jobs: DataFrame, now: Column, sources: bool = True) -> DataFrame:
    """Jobs that may be claimed, queued, waiting or blocked and not cooling down, with the rank of their priority."""
    rank = F.lit(len(PRIORITIES))
    for at, name in enumerate(PRIORITIES):
        rank = F.when(F.col("priority") == name, at).otherwise(rank)
    free = F.col("status").isin("queued", "waiting", "blocked") & (F.col("cooldown_until").isNull() | (F.col("cooldown_until") <= now))
    kind = F.lit(True) if sources else F.col("kind") != "source"
    return jobs.where(free & kind).withColumn("priority_rank", rank)


def claim(jobs: DataFrame, now: Column, limit: int = 1, sources: bool = True) -> DataFrame:
    """The next jobs to run: by priority, then the longest unchanged, then the smallest id."""
    return claimable(jobs, now, sources).orderBy("priority_rank", "updated_at", "job_id").limit(limit)


def swept(jobs: DataFrame, now: Column, stale_s: int, attempts: int) -> DataFrame:
    """Jobs after a sweep: one past its deadline expires; a running one without a heartbeat for stale_s is queued again, or fails if
    it was its last attempt."""
    active = F.col("status").isin("queued", "pending", "blocked", "running", "waiting")
    late = active & F.coalesce(F.col("deadline_at") <= now, F.lit(False))
    stale = (F.col("status") == "running") & F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("heartbeat_at") > stale_s, F.lit(False))
    status = F.when(late, "expired").when(stale & (F.col("attempt") >= attempts), "failed").when(stale, "queued").otherwise(F.col("status"))
    attempt = F.when(~late & stale & (F.col("attempt") < attempts), F.col("attempt") + 1).otherwise(F.col("attempt"))
    return jobs.withColumns({"status": status, "attempt": attempt})


def appended(events: DataFrame, job: str, dedupe: str, order: Sequence[str]) -> DataFrame:
    """Events with their number within the job; one whose dedupe key the job has had is left out."""
    first = Window.partitionBy(job, dedupe).orderBy(*order)
    once = events.withColumn("_n", F.when(F.col(dedupe).isNull(), 1).otherwise(F.row_number().over(first))).where("_n = 1").drop("_n")
    return once.withColumn("sequence", F.row_number().over(Window.partitionBy(job).orderBy(*order)))


def counters(reports: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Progress reports (done, total) with done never falling within a phase, total the first known one, and done at most total."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.first("total", ignorenulls=True).over(w)
    done = F.max("done").over(w)
    return reports.withColumns({"total": total, "done": F.when(total.isNotNull(), F.least(done, total)).otherwise(done)})


def latest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last written row of each key: the greatest time, then the greatest `tie`; found by aggregation."""
    others = [c for c in rows.columns if c not in (key, at, tie)]
    last = rows.groupBy(key).agg(F.max(F.struct(at, tie, *others)).alias("r"))
    return last.select(key, *[F.col(f"r.{c}").alias(c) for c in (at, tie, *others)])


def stale_debt(previous: DataFrame, following: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, reason) of the items whose old points must go once the next generation is out: removed or changed."""
    p, n = previous.select(key, F.col(mark).alias("_old")), following.select(key, F.col(mark).alias("_new"), F.lit(True).alias("_is"))
    both = p.join(n, key, "left").where(F.col("_is").isNull() | ~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select(key, F.when(F.col("_is").isNull(), "removed").otherwise("changed").alias("reason"))


def next_generation(generations: DataFrame, source: str, sequence: str) -> DataFrame:
    """(source, next): one beyond the greatest sequence so far, 1 for a source without any."""
    return generations.groupBy(source).agg((F.coalesce(F.max(sequence), F.lit(0)) + 1).alias("next"))


def leases(held: DataFrame, wanted: DataFrame, key: str, now: Column) -> DataFrame:
    """(key, owner, verdict) of each wanted lease: free or expired ones are granted, one's own live lease is renewed, another's refused."""
    h = held.select(key, F.col("owner").alias("_owner"), F.col("expires_at").alias("_until"))
    live = F.coalesce(F.col("_until") > now, F.lit(False))
    verdict = F.when(live & (F.col("_owner") != F.col("owner")), "refused").when(live, "renewed").when(F.col("_owner").isNotNull(), "replaced").otherwise("granted")
    return wanted.join(h, key, "left").select(key, "owner", verdict.alias("verdict"))


def document_faults(chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, faults): what is wrong with a document's chunks: blank contents, chunk ids that repeat, ranges whose end comes first."""
    once = chunks.groupBy(document, "chunk_id").agg(F.count("*").alias("n"), F.max((F.trim("content") == "").cast("int")).alias("blank"), F.max((F.col("end") < F.col("start")).cast("int")).alias("turned"))
    flag = lambda c, name: F.when(F.max(c), F.lit(name))
    found = once.groupBy(document).agg(F.array_compact(F.array(flag(F.col("blank") == 1, "blank"), flag(F.col("n") > 1, "repeated"), flag(F.col("turned") == 1, "turned"))).alias("faults"))
    return found.where(F.size("faults") > 0)


def prepared_faults(documents: DataFrame, chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, faults) of documents (document, source_id, source_item_key, fields, lines) that must not be stored: blank ids, names of fields that are
    forbidden, no chunks, chunk ids or keys that repeat, blank contents, and ranges that end before they start or beyond the document.

    chunks: (document, chunk_id, chunk_key, content, fields, line_start, line_end). A chunk of no known document is none of theirs."""
    bad_field = lambda fields: F.exists(F.coalesce(fields, F.array().cast("array<string>")), forbidden_name)
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    repeats = [chunks.groupBy(document, c).agg(F.count("*").alias("n")).groupBy(document).agg((F.max("n") > 1).alias(f"repeated_{c}")) for c in ("chunk_id", "chunk_key")]
    own = chunks.groupBy(document).agg(
        F.count("*").alias("n"),
        F.bool_or(bad_field(F.col("fields"))).alias("chunk_field"),
        F.bool_or(blank("content")).alias("blank"),
        F.bool_or(F.col("line_end") < F.col("line_start")).alias("turned"),
        F.max(F.greatest("line_start", "line_end")).alias("last"),
        F.min(F.least("line_start", "line_end")).alias("first"),
    )
    each = documents.join(own, document, "left").join(repeats[0], document, "left").join(repeats[1], document, "left")
    tests = [
        (blank(document), "document_id is empty"),
        (blank("source_id"), "source_id is empty"),
        (blank("source_item_key"), "source_item_key is empty"),
        (bad_field(F.col("fields")), "sensitive document metadata field"),
        (F.col("n").isNull(), "no chunks"),
        (F.col("chunk_field"), "sensitive chunk metadata field"),
        (F.col("repeated_chunk_id"), "duplicate chunk id"),
        (F.col("repeated_chunk_key"), "duplicate chunk key"),
        (F.col("blank"), "empty content"),
        (F.col("turned"), "range ends before it starts"),
        ((F.col("last") > F.greatest("lines", F.lit(1))) | (F.col("first") < 1), "range outside the document"),
    ]
    faults = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for t, name in tests]))
    return each.select(document, faults.alias("faults")).where(F.size("faults") > 0)


def job_statistics(jobs: DataFrame, now: Column) -> DataFrame:
    """Per kind of completed jobs (kind, started_at, finished_at, docs, chunks): number, mean seconds, mean documents a second, sums
    of documents and chunks, seconds since the last one, those of the last day, estimated tokens a document."""
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    docs, chunks = F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("chunks"), F.lit(0))
    return jobs.where("status = 'completed'").groupBy("kind").agg(
        F.count("*").alias("completed"), F.avg(seconds).alias("mean_seconds"), F.avg(F.col("docs") / F.nullif(seconds, F.lit(0.0))).alias("docs_per_second"),
        docs.alias("docs"), chunks.alias("chunks"), F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(F.max("finished_at"))).alias("seconds_ago"),
        F.count_if(F.col("finished_at") >= now - F.expr("INTERVAL 1 DAY")).alias("last_day"), F.when(docs > 0, chunks / docs * 500.0).alias("tokens_per_doc"),
    )


def token_statistics(chunks: DataFrame, document: str, text: str, most: int = 5000, order: str = "chunk_id") -> DataFrame:
    """Mean characters a chunk and a document, and a quarter of these as tokens, over the first `most` chunks that are not blank."""
    some = chunks.where(F.length(text) > 0).orderBy(order).limit(most)
    per = some.groupBy(document).agg(F.sum(F.length(text)).alias("chars"), F.count("*").alias("n"))
    out = per.agg((F.sum("chars") / F.sum("n")).alias("chars_per_chunk"), F.avg("chars").alias("chars_per_doc"))
    return out.withColumns({"tokens_per_chunk": F.col("chars_per_chunk") / 4, "tokens_per_doc": F.col("chars_per_doc") / 4})
