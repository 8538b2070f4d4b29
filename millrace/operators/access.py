"""Which points a search, a reader or a deletion may see; listing of sources; addresses in scope."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import urls as U
from millrace.operators import retrieval as R

#: The fields of a point that may hold its address, in the order they are asked.
URI_FIELDS = ["item_canonical_uri", "source_canonical_uri", "source_item_key", "locator_uri"]


def uri_matches(uri: str, prefix: bool = False, fields: Sequence[str] = URI_FIELDS) -> Column:
    """Whether any of the fields is uri, or begins with it; a field that is null matches nothing."""
    test = (lambda c: c.startswith(uri)) if prefix else (lambda c: c == uri)
    return F.exists(F.array(*[F.col(f).cast("string") for f in fields]), lambda c: F.coalesce(test(c), F.lit(False)))


def same_value(column: Column, expected: object) -> Column:
    """Equality as text, so a generation that is stored as a number equals one that is asked for as a string."""
    return F.coalesce(column.cast("string") == F.lit(str(expected)), F.lit(False))


def retrievable(visibility: Sequence[str], source_id: object = None, namespaces: Sequence[str] = (), since=None, before=None) -> Column:
    """What a search may return: visibility allowed, redaction clean, published, and the source, namespaces and times asked for,
    both ends of which count."""
    out = R.matches(F.col("visibility"), list(visibility)) & R.matches(F.col("redaction_status"), "clean") & R.matches(F.col("document_status"), "published")
    if source_id is not None:
        out &= same_value(F.col("source_id"), source_id)
    if namespaces:
        out &= R.matches(F.col("vector_namespace"), list(namespaces))
    if since is not None:
        out &= F.coalesce(F.col("embedded_at") >= since, F.lit(False))
    if before is not None:
        out &= F.coalesce(F.col("embedded_at") <= before, F.lit(False))
    return out


def readable() -> Column:
    """What reading by address may return: committed, not redacted, its redaction not failed, not retired."""
    other = lambda c, v: F.coalesce(F.col(c) != v, F.lit(True))
    return F.col("committed_generation").isNotNull() & other("visibility", "redacted") & other("redaction_status", "failed") & F.col("retired_epoch").isNull()


def selected(kind: str, **of: object) -> Column:
    """The points that a deletion by `kind` takes: source (with or without a generation), generation, collection, document
    (with or without a generation), chunks, points, uri (exact or prefix) or filter."""
    generation = lambda: same_value(F.col("source_generation"), of["generation"]) if of.get("generation") is not None else F.lit(True)
    tests = {
        "source": lambda: same_value(F.col("source_id"), of["source_id"]) & generation(),
        "generation": lambda: same_value(F.col("source_id"), of["source_id"]) & same_value(F.col("source_generation"), of["generation"]),
        "collection": lambda: F.lit(True),
        "document": lambda: same_value(F.col("document_id"), of["document_id"]) & generation(),
        "chunks": lambda: R.matches(F.col("chunk_id"), list(of["chunk_ids"])),
        "points": lambda: R.matches(F.col("point_id"), list(of["point_ids"])),
        "uri": lambda: uri_matches(of["uri"], bool(of.get("prefix"))),
        "filter": lambda: reduce(and_, [R.matches(F.col(k), v) for k, v in of["filter"].items()]) if of["filter"] else F.lit(True),
    }
    return F.coalesce(tests[kind](), F.lit(False))


def without(points: DataFrame, kind: str, **of: object) -> DataFrame:
    """points after a deletion: what is left is written anew, as files do not change."""
    return points.where(~selected(kind, **of))


def listed(sources: DataFrame, source_kind=None, adapter=None, status=None, authority=None, watched=None, tag=None, query=None) -> DataFrame:
    """Sources that meet every condition given: adapter and tags without regard to case, query anywhere in address or name."""
    out = F.lit(True)
    for column, value in (("source_kind", source_kind), ("status", status), ("authority", authority)):
        if value is not None:
            out &= F.col(column) == value
    if adapter is not None:
        out &= F.lower("adapter") == adapter.lower()
    if watched is not None:
        out &= F.col("watch_id").isNotNull() == watched
    if tag is not None:
        out &= F.exists("tags", lambda t: F.lower(t) == tag.lower())
    if query is not None and query.strip():
        out &= F.lower(F.concat_ws(" ", "canonical_uri", "display_name")).contains(query.strip().lower())
    return sources.where(F.coalesce(out, F.lit(False)))


def in_scope(url: Column, start_host: str, start_path: str = "/", subdomains: bool = False, excluded: Sequence[str] = ()) -> Column:
    """Whether an address lies on the start's host (www. or not, subdomains if asked) and at or below its path, and is not excluded."""
    home = start_host.lower().removeprefix("www.")
    on = U.host(url) == home
    if subdomains:
        on |= U.host(url).endswith("." + home)
    if start_path not in ("", "/"):
        on &= (U.path(url) == start_path) | U.path(url).startswith(start_path + "/")
    return F.coalesce(on & ~U.excluded_any_case(url, excluded), F.lit(False))


def lookups(url: Column, canonical_first: bool = False) -> Column:
    """The forms under which an address may be stored: as given, normalized, without and with a slash at its end; once each."""
    normalized = U.with_scheme(url)
    trimmed = F.regexp_replace(normalized, "/+$", "")
    forms = [normalized, trimmed, F.concat(trimmed, F.lit("/"))]
    forms = [*forms, url] if canonical_first else [url, *forms]
    return F.filter(F.array_distinct(F.array(*forms)), lambda v: v != "")


def not_indexed(candidates: DataFrame, indexed: DataFrame, url: str = "url") -> DataFrame:
    """Candidates of which no form is among the indexed addresses."""
    forms = candidates.select(F.col(url).alias("_url"), F.explode(lookups(F.col(url))).alias("_form"))
    known = forms.join(indexed.select(F.col(url).alias("_form")).distinct(), "_form", "left_semi").select("_url").distinct()
    return candidates.join(known, F.col(url) == F.col("_url"), "left_anti")


def read_by_url(points: DataFrame, asked: DataFrame, url: str = "url", most: int = 500, within: Sequence[str] = ()) -> DataFrame:
    """(asked, within, url, chunk_index, chunk_text, truncated): for each address asked for the chunks of the first of its forms that has
    any, in order of index, `most` of them; truncated tells that the bound was reached. within: columns of both tables; an address
    finds only points of its own values there, so several who store under one address are told apart."""
    key = ["asked", *within]
    forms = asked.select(F.col(url).alias("asked"), *within, F.posexplode(lookups(F.col(url), True)).alias("rank", "form")).distinct()
    hits = forms.join(points.where(readable()).select(F.col(url).alias("form"), *within, "chunk_index", "chunk_text"), ["form", *within])
    best = hits.groupBy(*key).agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
    own = hits.join(best.select(*key, "rank"), [*key, "rank"])
    place = Window.partitionBy(*key).orderBy(F.col("chunk_index").asc_nulls_last(), "chunk_text")
    numbered = own.withColumn("_at", F.row_number().over(place)).where(F.col("_at") <= most)
    sizes = own.groupBy(*key).agg((F.count("*") >= most).alias("truncated"))
    return numbered.join(sizes, key).select(*key, F.col("form").alias("url"), "chunk_index", "chunk_text", "truncated")
