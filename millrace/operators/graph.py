"""Graph rules: authority, conflicts, aliases, and edges that find their ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far a claim is to be trusted, from the least; claims from `verified` on establish edges.
AUTHORITIES = ["unknown", "community", "mirror", "inferred", "verified", "official", "user_pinned"]


def rank(authority: Column) -> Column:
    """Place of an authority, 0 for one that is unknown."""
    out = F.lit(0)
    for at, name in enumerate(AUTHORITIES):
        out = F.when(authority == name, at).otherwise(out)
    return out


def resolved(existing: Column, incoming: Column) -> Column:
    """struct(winner, conflict): the higher rank wins, the existing claim a tie, which is a conflict if both are authoritative."""
    winner = F.when(rank(incoming) > rank(existing), incoming).otherwise(existing)
    return F.struct(winner.alias("winner"), ((rank(existing) == rank(incoming)) & (rank(existing) >= AUTHORITIES.index("verified"))).alias("conflict"))


def upserted_edges(edges: DataFrame, incoming: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Edges after an upsert (key, authority, confidence), one incoming row a key, and the conflicts met.

    Confidence is the greater one. On a conflict the edge's authority becomes `conflicting` and a conflict row tells both."""
    e, i = edges.alias("e"), incoming.alias("i")
    both = e.join(i, F.col(f"e.{key}") == F.col(f"i.{key}"), "full").select(
        F.coalesce(f"e.{key}", f"i.{key}").alias(key), F.col("e.authority").alias("old"), F.col("i.authority").alias("new"), F.greatest("e.confidence", "i.confidence").alias("confidence"), resolved(F.col("e.authority"), F.col("i.authority")).alias("r")
    )
    met = F.col("old").isNotNull() & F.col("new").isNotNull()
    authority = F.when(met & F.col("r.conflict"), "conflicting").when(met, F.col("r.winner")).otherwise(F.coalesce("old", "new"))
    conflicts = both.where(met & F.col("r.conflict")).select(key, F.col("old").alias("existing_authority"), F.col("new").alias("incoming_authority"))
    return both.select(key, authority.alias("authority"), "confidence"), conflicts


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge candidates (from_key, to_key, ...) with the node ids of both ends; one whose end is no node is dropped."""
    ends = lambda side: nodes.select(F.col("stable_key").alias(f"{side}_key"), F.col("node_id").alias(f"{side}_node_id"))
    return edges.join(ends("from"), "from_key").join(ends("to"), "to_key")


def by_alias(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """(asked, node_id, confidence): the node of each name, through the aliases (alias_kind, alias_value, node_id) by node id, then
    canonical address, then stable key; confidence is 1 for a hit, and null, as node_id, for a miss."""
    kinds = F.array(F.lit("node_id"), F.lit("canonical_uri"), F.lit("stable_key"))
    known = aliases.select("node_id", F.col("alias_value").alias("asked"), F.array_position(kinds, F.col("alias_kind")).alias("order")).where("order > 0")
    found = known.groupBy("asked").agg(F.min(F.struct("order", "node_id")).alias("f"))
    return asked.select("asked").distinct().join(found, "asked", "left").select("asked", F.col("f.node_id").alias("node_id"), F.when(F.col("f").isNotNull(), 1.0).alias("confidence"))
