"""Generations, differences, orphans, memory scores, graphs and jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import graph
from millrace.sources.tables import written


def manifest_diff(previous: DataFrame, following: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """(key, change): added, removed, modified (a compared column differs, null being equal to null) or unchanged."""
    a, b = previous.select(key, *compared).alias("a"), following.select(key, *compared).alias("b")
    same = F.lit(True)
    for c in compared:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    change = F.when(F.col(f"a.{key}").isNull(), "added").when(F.col(f"b.{key}").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), change.alias("change"))


def orphans(stored: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Distinct stored keys without a live owner."""
    return stored.select(key).where(F.col(key).isNotNull()).join(live.select(key), key, "left_anti").distinct()


def newest(df: DataFrame, key: str, order: str, keep: int) -> DataFrame:
    """The newest `keep` rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("age_rank", F.row_number().over(w)).where(F.col("age_rank") <= keep)


#: Days after which a memory of each decay profile counts half; `none` never decays.
HALF_LIVES = {"very_fast": 1.0, "fast": 7.0, "normal": 30.0, "slow": 180.0, "very_slow": 730.0}
#: What is taken off the score of a memory by its status; an archived one loses nothing where archived ones are asked for.
PENALTIES = {"forgotten": 1.0, "superseded": 0.5, "archived": 0.25}
CONTRADICTED = 0.25


def half_life(profile: Column) -> Column:
    """Days of a decay profile; null, which means no decay, for `none` and for others."""
    out = F.lit(None).cast("double")
    for name, days in HALF_LIVES.items():
        out = F.when(profile == name, days).otherwise(out)
    return out


def decay(age_days: Column, half_life: Column, pinned: Column | None = None) -> Column:
    """0.5 ^ (age / half-life); no decay without a half-life or while pinned; ages below 0 count as 0."""
    factor = F.coalesce(F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life), F.lit(1.0))
    return factor if pinned is None else F.when(pinned, 1.0).otherwise(factor)


def status_penalty(status: Column, archived: bool = False) -> Column:
    out = F.lit(0.0)
    for name, lost in PENALTIES.items():
        if not (archived and name == "archived"):
            out = F.when(status == name, lost).otherwise(out)
    return out


def memory_score(semantic: Column, confidence: Column, salience: Column, scope: Column, reinforcements: Column, decayed: Column, status: Column, archived: bool = False) -> Column:
    """Weighted sum times decay, less the penalties of the status, within 0 and 1; each part counts within 0 and 1, reinforcement as
    ln(1 + n) / 5."""
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    base = 0.45 * unit(semantic) + 0.20 * unit(confidence) + 0.15 * unit(salience) + 0.10 * unit(scope) + 0.10 * unit(F.log1p(reinforcements) / 5)
    return unit(base * decayed - F.when(status == "contradicted", CONTRADICTED).otherwise(0.0) - status_penalty(status, archived))


def traverse(edges: DataFrame, start: DataFrame, depth: int, both: bool = False) -> DataFrame:
    """(node, depth) reached from start (node) over edges (src, dst) in at most `depth` steps, at its least depth."""
    step = edges.select("src", "dst")
    if both:
        step = step.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    step = written(step.distinct())
    seen = written(start.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):  # each level is written, so the next one reads it instead of making it again
        reached = front.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = written(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.union(front)
    return seen


def reached_edges(edges: DataFrame, start: DataFrame, depth: int, direction: str = "both", kinds: Sequence[str] = ()) -> DataFrame:
    """(edge_id, kind, src, dst, depth) of the edges (edge_id, kind, src, dst) that a traversal from start (node) meets: those of the kinds, all if
    none is named, at a node less than `depth` steps away, walked out, in or both; depth is that of the nearer end."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction: {direction}")
    own = edges.where(F.col("kind").isin(list(kinds))) if kinds else edges
    walked = own if direction != "in" else own.select("edge_id", "kind", F.col("dst").alias("src"), F.col("src").alias("dst"))
    near = written(traverse(walked, start, max(depth - 1, 0), both=direction == "both")) if depth > 0 else start.select("node", F.lit(0).alias("depth")).limit(0)
    ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
    met = [own.join(near, own[e] == near["node"]).select("edge_id", "kind", "src", "dst", "depth") for e in ends]
    every = met[0] if len(met) == 1 else met[0].unionByName(met[1])
    return every.groupBy("edge_id", "kind", "src", "dst").agg(F.min("depth").alias("depth"))


def edge_page(reached: DataFrame, limit: int, after: tuple[int, object] | None = None) -> DataFrame:
    """The next edges in order of (depth, edge_id), strictly after that pair."""
    rest = reached if after is None else reached.where((F.col("depth") > after[0]) | ((F.col("depth") == after[0]) & (F.col("edge_id") > F.lit(after[1]))))
    return rest.orderBy("depth", "edge_id").limit(limit)


def merge_nodes(nodes: DataFrame, fallback: float = 0.0) -> DataFrame:
    """One row a node_id: highest authority, greatest confidence (fallback without any, within 0 and 1), all source ids, label of the latest row."""
    confidence = F.least(F.greatest(F.coalesce(F.max("confidence"), F.lit(fallback)), F.lit(0.0)), F.lit(1.0))
    return nodes.groupBy("node_id").agg(
        F.coalesce(F.max_by("authority", F.struct(graph.rank(F.col("authority")), "authority")), F.lit("unknown")).alias("authority"),
        confidence.alias("confidence"),
        F.array_sort(F.collect_set("source_id")).alias("source_ids"),
        F.max_by("label", "updated_at").alias("label"),
    )


def claim_order(jobs: DataFrame, now: Column, quantum_s: int = 30, most: int = 4) -> DataFrame:
    """Jobs with their effective priority: less is sooner; waiting lowers it by one a quantum, `most` times at most."""
    waited = F.greatest(F.unix_timestamp(now) - F.unix_timestamp("created_at"), F.lit(0))
    aged = jobs.withColumn("effective", F.greatest(F.lit(0), F.col("priority") - F.least(F.lit(most), F.floor(waited / quantum_s).cast("int"))))
    return aged
