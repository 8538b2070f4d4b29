"""Event streams: windows, first-wins deduplication and per-key sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total): works on streams and tables; streams drop what comes later than `late`."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str = "1 hour") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): a session ends after `gap` without an event."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_wins(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key; a stream remembers keys for the watermark's span."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def sequenced(events: DataFrame) -> DataFrame:
    """A sequence from 1 for each user, in order of time and id."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))


def _per_key(events: DataFrame, key: list[str], out: S.StructType, state: str, fold: Callable) -> DataFrame:
    """fold(rows of a key as pandas, what is known of it or None) gives new rows and what is known then; kept between micro-batches."""

    def run(of: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        rows, known = fold(pd.concat(list(frames), ignore_index=True), kept.get if kept.exists else None)
        kept.update(known)
        yield rows[[f.name for f in out]]

    return events.groupBy(*key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def appended_stream(events: DataFrame, job: str, dedupe: str, order: list[str], remembered: int = 10_000) -> DataFrame:
    """ledger.appended() for a stream: events with their number within the job; one whose dedupe key the job has had is left out.

    Numbers go on from batch to batch, within one by order, so a late event gets the next number and no number changes; after a restart from the
    checkpoint they go on where they were. A job remembers its last `remembered` dedupe keys: what bounds its state is stated here."""
    out = S.StructType([*events.schema, S.StructField("sequence", S.LongType())])

    def fold(rows: pd.DataFrame, known: tuple | None) -> tuple[pd.DataFrame, tuple]:
        n, keys = known or (0, [])
        rows = rows.sort_values(order, kind="stable")
        had = set(keys)
        new = [k is None or not (k in had or had.add(k)) for k in rows[dedupe].where(rows[dedupe].notna(), None)]
        rows = rows[new].copy()
        rows["sequence"] = range(n + 1, n + len(rows) + 1)
        fresh = [k for k in rows[dedupe] if isinstance(k, str)]
        return rows, (n + len(rows), [*keys, *fresh][-remembered:])

    return _per_key(events, [job], out, "n long, keys array<string>", fold)


def counters_stream(reports: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """ledger.counters() for a stream of progress reports (done, total): done never falls, total is the first one known, done at most total."""
    out = reports.schema

    def fold(rows: pd.DataFrame, known: tuple | None) -> tuple[pd.DataFrame, tuple]:
        done, total = known or (None, None)
        rows = rows.sort_values(order, kind="stable")
        given: list[tuple] = []
        for d, t in zip(rows["done"], rows["total"], strict=True):
            total = total if total is not None or pd.isna(t) else int(t)
            done = done if pd.isna(d) else int(d) if done is None else max(done, int(d))
            given.append((done if total is None or done is None else min(done, total), total))
        return rows.assign(done=pd.array([g[0] for g in given], "Int64"), total=pd.array([g[1] for g in given], "Int64")), (done, total)

    return _per_key(reports, by, out, "done long, total long", fold)
