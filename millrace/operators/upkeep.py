"""Upkeep: prune plans and their outcomes, validators of pages fetched on condition, memories that come and go, bounds of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is pruned, in the order in which it is; counts that make up each.
PRUNE_ORDER = {
    "vector": ["vector_points"],
    "artifact": ["artifacts"],
    "graph": ["graph_nodes", "graph_edges"],
    "memory": ["memory_records"],
    "ledger": ["ledger_generations"],
    "job_retention": ["jobs"],
    "cache": ["cache_entries"],
}


def prune_steps(estimates: DataFrame, plan: str) -> DataFrame:
    """(plan, rank, target, estimated) of each target with something to delete, in the order in which it is done."""
    each = F.array(*[F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("target"), sum((F.coalesce(F.col(c), F.lit(0)) for c in counts), F.lit(0)).cast("long").alias("estimated")) for rank, (name, counts) in enumerate(PRUNE_ORDER.items())])
    return estimates.select(plan, F.inline(F.filter(each, lambda s: s["estimated"] > 0)))


def prune_outcomes(steps: DataFrame, plan: str, current: Column, generation: Column, admin: Column, failed: Column) -> DataFrame:
    """(plan, rank, target, status, deleted, debt) of the steps (plan, rank, target, estimated) of generation prunes.

    Without the rights of an administrator a plan is denied, as is one of the current generation. A step that fails owes what it was to
    delete; the ledger's step is skipped after a failure, and owes it too, as its rows are the way back."""
    denied = F.when(~admin, "admin_required").when(generation == current, "fence_check_failed")
    before = Window.partitionBy(plan).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    told = steps.select("*", denied.alias("denied"), failed.alias("failed"))
    blocked = (F.col("target") == "ledger") & F.coalesce(F.max("failed").over(before), F.lit(False))
    status = F.when(F.col("denied").isNotNull(), F.col("denied")).when(blocked, "skipped").when(F.col("failed"), "failed").otherwise("completed")
    out = told.withColumn("status", status)
    return out.select(plan, "rank", "target", "status", F.when(F.col("status") == "completed", F.col("estimated")).otherwise(0).alias("deleted"), F.when(F.col("status").isin("failed", "skipped"), F.col("estimated")).otherwise(0).alias("debt"))


def plan_status(outcomes: DataFrame, plan: str) -> DataFrame:
    """(plan, status, deleted, debt): failed if steps failed and none completed, degraded if some did, else completed; a denied plan says why."""
    failed, done = F.bool_or(F.col("status") == "failed"), F.bool_or(F.col("status") == "completed")
    denied = F.max(F.when(F.col("status").isin("admin_required", "fence_check_failed"), F.col("status")))
    status = F.coalesce(denied, F.when(failed & done, "completed_degraded").when(failed, "failed").otherwise("completed"))
    return outcomes.groupBy(plan).agg(status.alias("status"), F.sum("deleted").alias("deleted"), F.sum("debt").alias("debt"))


def reconcile_targets(previous: DataFrame, seeded: DataFrame, arrived: DataFrame, visited: DataFrame, validators: DataFrame, most_misses: int, key: str = "url") -> DataFrame:
    """The pages of the previous run to keep: asked for with a validator, visited and not sent again; not those that were missed most_misses times."""
    kept = previous.select(key).distinct().join(seeded.select(key), key, "left_semi").join(visited.select(key), key, "left_semi").join(arrived.select(key), key, "left_anti")
    known = validators.groupBy(key).agg(F.max("miss_count").alias("misses"))
    return kept.join(known, key, "left").where(F.coalesce("misses", F.lit(0)) < most_misses).select(key)


def next_validators(previous: DataFrame, arrived: DataFrame, fresh: DataFrame, most_misses: int, key: str = "url") -> DataFrame:
    """(url, etag, last_modified, miss_count) for the next run.

    Of a page that arrived the fresh validators (url, etag, last_modified), nothing if both are null, its old ones if the cache does not know it;
    its misses start at 0. Another page keeps its validators with one miss more, up to most_misses, at which it goes."""
    here = arrived.select(key).distinct().withColumn("here", F.lit(True))
    new = fresh.select(key, F.col("etag").alias("e"), F.col("last_modified").alias("m"), F.lit(True).alias("cached")).join(here.select(key), key, "left_semi")
    both = previous.select(key, "etag", "last_modified", "miss_count", F.lit(True).alias("known")).join(new, key, "full").join(here, key, "left")
    arrived_, cached = F.coalesce("here", F.lit(False)), F.coalesce("cached", F.lit(False))
    out = both.select(
        key,
        F.when(cached, F.col("e")).otherwise(F.col("etag")).alias("etag"),
        F.when(cached, F.col("m")).otherwise(F.col("last_modified")).alias("last_modified"),
        F.when(arrived_, 0).otherwise(F.col("miss_count") + 1).alias("miss_count"),
        (cached & F.col("e").isNull() & F.col("m").isNull()).alias("emptied"),
    )
    return out.where(~F.col("emptied") & (F.col("miss_count") < most_misses)).drop("emptied")


def imported(records: DataFrame, incoming: DataFrame, replace_scopes: bool = False, most_bytes: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(memory_id, body, memory_type, scope_kind, scope_value, status) after an import, and (memory_id, outcome) of each incoming record.

    Merging skips a record whose body, type and scope are known, or come in twice; replacing archives what the scopes that come in held. Bodies
    above most_bytes cannot be checked for secrets and are skipped. What comes in is `review`, whatever it was."""
    columns = ["memory_id", "body", "memory_type", "scope_kind", "scope_value", "status"]
    content, scope = ["body", "memory_type", "scope_kind", "scope_value"], ["scope_kind", "scope_value"]
    large = F.octet_length("body") > most_bytes
    if replace_scopes:
        judged = incoming.withColumn("outcome", F.when(large, "redaction_failed").otherwise("created"))
        gone = incoming.select(*scope).distinct().withColumn("gone", F.lit(True))
        kept = records.join(gone, scope, "left").withColumn("status", F.when(F.col("gone"), "archived").otherwise(F.col("status")))
    else:
        known = records.select(*content).distinct().withColumn("known", F.lit(True))
        order = Window.partitionBy(*content).orderBy("memory_id")
        repeated = F.coalesce("known", F.lit(False)) | (F.row_number().over(order) > 1)
        judged = incoming.join(known, content, "left").withColumn("outcome", F.when(repeated, "duplicate").when(large, "redaction_failed").otherwise("created"))
        kept = records
    new = judged.where("outcome = 'created'").withColumn("status", F.lit("review"))
    return kept.select(*columns).unionByName(new.select(*columns)), judged.select("memory_id", "outcome")


def exported(records: DataFrame, archived: bool = False, working: bool = False, scope: tuple[str, str] | None = None) -> DataFrame:
    """The records that an export holds: none that is forgotten, archived and working ones where asked for, those of one scope where one is given."""
    left_out = ["forgotten", *([] if archived else ["archived"]), *([] if working else ["working"])]
    out = records.where(~F.col("status").isin(left_out))
    return out if scope is None else out.where((F.col("scope_kind") == scope[0]) & (F.col("scope_value") == scope[1]))


def time_bound(text: Column, now: Column, end: bool = False) -> Column:
    """A bound of time: `3d` or `2w` before now, a day (its last microsecond as an end), or a time with a zone; null if it is none of these."""
    bare = F.trim(text)
    back = F.when(bare.rlike(r"^[+-]?\d{1,9}[dw]\z"), F.regexp_extract(bare, r"^([+-]?\d+)", 1).cast("long") * F.when(bare.endswith("w"), 7).otherwise(1))
    day = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_timestamp(bare, F.lit("yyyy-MM-dd")))
    whole = F.timestamp_micros(F.unix_micros(day) + (86_400_000_000 - 1 if end else 0))
    zoned = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})\z"), F.try_to_timestamp(F.upper(bare)))
    return F.coalesce(F.timestamp_micros(F.unix_micros(now) - back * 86_400_000_000), whole, zoned)


def bounds(rows: DataFrame, since: str, before: str, now: Column, carry: Sequence[str] = ()) -> DataFrame:
    """(carried, since_at, before_at, fault): both bounds as times; fault tells a bound that is not blank and cannot be read, or bounds the wrong way round."""
    full = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    low, high = time_bound(F.col(since), now), time_bound(F.col(before), now, end=True)
    fault = F.when((full(since) & low.isNull()) | (full(before) & high.isNull()), "invalid temporal bound").when(low > high, "since is later than before")
    return rows.select(*carry, low.alias("since_at"), high.alias("before_at"), fault.alias("fault"))
