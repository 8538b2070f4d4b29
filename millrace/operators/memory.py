"""Memories: visibility, scores, search, contexts within budgets, and the changes of a record's state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\n"


def recallable(status: Column, archived: bool = False, statuses: Sequence[str] = ()) -> Column:
    """Search visibility: never forgotten; superseded and archived only where asked for."""
    superseded = F.lit("superseded" in statuses)
    return F.when(status == "forgotten", False).when(status == "superseded", superseded).when(status == "archived", F.lit(archived or "archived" in statuses)).otherwise(True)


def in_context(status: Column, working: bool = False) -> Column:
    """Context visibility: never forgotten, superseded or archived; working only where asked for."""
    return F.when(status.isin("forgotten", "superseded", "archived"), False).when(status == "working", F.lit(working)).otherwise(True)


def keyword_semantic(body: Column, query: str) -> Column:
    """1 if the body holds the whole query, else the share of its words that it holds; 0 for a blank query."""
    q, terms = query.lower(), query.lower().split()
    if not terms:
        return F.lit(0.0)
    low = F.lower(body)
    hits = sum((F.when(low.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    return F.when(low.contains(q), 1.0).otherwise(hits / len(terms))


def scope_score(kind: Column, value: Column, wanted: str | None = None) -> Column:
    """1 for the scope asked for, 0.5 for a global one, else 0.25."""
    exact = F.coalesce(value == wanted, F.lit(False)) if wanted is not None else F.lit(False)
    return F.when(exact, 1.0).when(F.coalesce(kind, F.lit("")).isin("global", ""), 0.5).otherwise(0.25)


def age_days(reinforced: Column, last_event: Column, now: Column) -> Column:
    """Days since the last reinforcement, else since the last event of the history; 0 without either or in the future."""
    at = F.coalesce(reinforced, last_event)
    return F.coalesce(F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400, F.lit(0.0))


def best(records: DataFrame, score: str, key: str, limit: int) -> DataFrame:
    """The records of the highest scores, one at least, ties to the smaller key."""
    return records.orderBy(F.desc(score), key).limit(max(limit, 1))


def with_records(hits: DataFrame, records: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Hits with their record, and the hits whose record is gone."""
    return hits.join(records, key), hits.join(records, key, "left_anti")


def review_queue(reviews: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Records that have an open review, once each."""
    return records.join(reviews.where("NOT resolved").select(key).distinct(), key, "left_semi")


def packed(records: DataFrame, group: str, order: Sequence[Column], key: str, cost: str, budget: int) -> DataFrame:
    """(group, ids, used): records taken in order while they fit the budget; one that does not fit is passed over and later ones
    may still fit. Of records of one cost no more than budget / cost can ever be taken, so only these, the first in order,
    go to the group's fold: its size is bounded by the budget, whatever the group's."""
    by_cost = Window.partitionBy(group, cost).orderBy(*order)
    few = records.where(F.col(cost).between(1, budget)).withColumn("_n", F.row_number().over(by_cost)).where(F.col("_n") * F.col(cost) <= budget)
    numbered = few.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    items = F.array_sort(F.collect_list(F.struct("_at", F.col(cost).cast("long").alias("cost"), F.col(key).cast("long").alias("id"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    take = lambda a, x: F.when(a["used"] + x["cost"] <= budget, F.struct((a["used"] + x["cost"]).alias("used"), F.concat(a["ids"], F.array(x["id"])).alias("ids"))).otherwise(a)
    return numbered.groupBy(group).agg(F.aggregate(items, start, take).alias("r")).select(group, "r.ids", "r.used")


def clipped_prefix(entries: DataFrame, group: str, order: str, text: str, most_chars: int, overhead: int) -> DataFrame:
    """(group, order, text): the longest prefix of entries that fits beside `overhead` characters; where not even the first fits, it
    is cut to what is left. An entry has a character at least, so no more than most_chars are looked at."""
    w = Window.partitionBy(group).orderBy(order)
    first = entries.where(F.length(text) > 0).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most_chars)
    held = first.withColumn("_sum", F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    room = max(most_chars - overhead, 0)
    kept = held.where((F.col("_sum") <= room) | (F.col("_n") == 1) & F.lit(room > 0))
    return kept.select(group, order, F.substring(F.col(text), 1, room).alias(text))


def reinforced(records: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Records after all reinforcements (key, amount, at): salience within 0 and 1, the count and the last time.

    Amounts are of one sign, as reinforcements are, so the sum may be clamped once."""
    total = changes.groupBy(key).agg(F.sum("amount").alias("_amount"), F.count("*").alias("_n"), F.max("at").alias("_at"))
    joined = records.join(total, key, "left")
    return joined.select(
        *[c for c in records.columns if c not in ("salience", "reinforcement_count", "last_reinforced_at")],
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("salience") + F.coalesce("_amount", F.lit(0.0)))).alias("salience"),
        (F.col("reinforcement_count") + F.coalesce("_n", F.lit(0))).alias("reinforcement_count"),
        F.coalesce("_at", "last_reinforced_at").alias("last_reinforced_at"),
    )


def superseded(records: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Records after supersessions (key, by): a pair of itself, or whose replacement does not exist, is refused."""
    good = pairs.where(F.col(key) != F.col("by")).join(records.select(F.col(key).alias("by")).distinct(), "by", "left_semi").groupBy(key).agg(F.max("by").alias("superseded_by"))
    out = records.join(good, key, "left")
    return out.withColumn("status", F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise(F.col("status")))


def contradicted(records: DataFrame, pairs: DataFrame, key: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """Records after contradictions (key, other), and the reviews (key, reason, at) that they call for.

    Both of a pair become contradicted and point at each other, at the greatest where there are several; a pair of itself or of a record that does
    not exist is refused. Forgotten records stay as they are, and so do those they would contradict."""
    open_ = records.where("status <> 'forgotten'").select(F.col(key).alias("k"))
    good = pairs.where(F.col(key) != F.col("other")).join(open_.withColumnRenamed("k", key), key, "left_semi").join(open_.withColumnRenamed("k", "other"), "other", "left_semi")
    both = good.select(key, "other").union(good.select(F.col("other"), F.col(key)))
    met = both.groupBy(key).agg(F.max("other").alias("contradicts"))
    out = records.drop("contradicts").join(met, key, "left").withColumn("status", F.when(F.col("contradicts").isNotNull(), "contradicted").otherwise(F.col("status")))
    return out, met.select(key, F.concat(F.lit("contradicts "), F.col("contradicts").cast("string")).alias("reason"), at.alias("at"))


def with_status(records: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Records after changes of status (key, status, at), the last one counting, with the number of events that their history gained; and the keys that
    are to be reviewed, once each."""
    last = changes.groupBy(key).agg(F.max(F.struct("at", F.col("status").alias("s"))).alias("_l"), F.count("*").alias("_n"))
    out = records.join(last, key, "left").withColumns({"status": F.coalesce("_l.s", "status"), "events": F.coalesce("_n", F.lit(0))}).drop("_l", "_n")
    return out, changes.where("status = 'review'").select(key).distinct().join(records.select(key), key, "left_semi")
