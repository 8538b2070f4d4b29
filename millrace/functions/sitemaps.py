"""Scans of robots files and sitemaps, and scores that a judge wrote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def robots_sitemaps(robots: Column) -> Column:
    """The addresses of the sitemap directives, comments left out, sorted, each once."""
    lines = F.transform(F.split(robots, r"\r?\n"), lambda x: F.regexp_extract(F.split_part(x, F.lit("#"), F.lit(1)), r"(?i)^\s*sitemap\s*:\s*(\S.*?)\s*$", 1))
    return F.array_sort(F.array_distinct(F.filter(lines, lambda x: x != "")))


def sitemap_entries(xml: Column) -> Column:
    """(loc, lastmod) of each url block with a loc, in file order; lastmod is null where the block has none."""
    tag = lambda block, name: F.trim(F.regexp_extract(block, f"(?is)<{name}>(.*?)</{name}>", 1))
    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)<url>(.*?)</url>"), F.lit(1))
    made = F.transform(blocks, lambda b: F.struct(F.replace(tag(b, "loc"), F.lit("&amp;"), F.lit("&")).alias("loc"), F.nullif(tag(b, "lastmod"), F.lit("")).alias("lastmod")))
    return F.filter(made, lambda e: e["loc"] != "")


def recent(lastmod: Column, today: Column, days: int) -> Column:
    """Whether the date in the first ten characters is at most `days` back; what is no date counts as recent."""
    return F.coalesce(F.try_to_date(F.left(lastmod, F.lit(10)), "yyyy-MM-dd") >= F.date_sub(today, days), F.lit(True))


def judged(analysis: Column) -> Column:
    """(rag, baseline): sums over the lines that state both scores; null without such a line."""
    score = lambda line, name: F.regexp_extract(line, name + r": (\d+(?:\.\d+)?)", 1)
    rows = F.transform(F.split(analysis, "\n"), lambda x: F.struct(score(x, "RAG").alias("r"), score(x, "Baseline").alias("b")))
    both = F.filter(rows, lambda x: (x["r"] != "") & (x["b"] != ""))
    total = lambda name: F.aggregate(both, F.lit(0.0), lambda s, x: s + x[name].cast("double"))
    return F.when(F.size(both) > 0, F.struct(total("r").alias("rag"), total("b").alias("baseline")))
