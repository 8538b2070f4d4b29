"""Reversible line dedup: cuckoo filters by shard, backed by exact reference counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import BROADCAST_ROWS, raw, stored, text_rows

SPACE = b" \t\n\x0b\x0c\r"
FILTER_SHARDS = 64


class CuckooFilter:
    """Set of 128-bit keys that may say yes for a key it lacks, never no for one it has; keys can be taken out."""

    SLOTS = 4

    def __init__(self, expected: int):
        n = 1
        while n * self.SLOTS * 0.84 < max(expected, 1):
            n *= 2
        self.table = np.zeros((n, self.SLOTS), np.uint16)

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        size = len(keys)
        while True:
            made = cls(size)
            if all(made.insert(k) for k in keys):
                return made
            size = made.table.size + 1  # full before its time: double it

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        made = cls(0)
        made.table = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        return made

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        here = int.from_bytes(key[:8], "little") & (len(self.table) - 1)
        return mark, here, self._other(here, mark)

    def _other(self, here: int, mark: int) -> int:
        return (here ^ (mark * 0x5BD1E995)) & (len(self.table) - 1)

    def insert(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        at = a
        moved = []
        for turn in range(500):
            slot = turn % self.SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            moved.append((at, slot, mark))
            at = self._other(at, mark)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        for at, slot, mark in reversed(moved):  # no room: leave it as it was
            self.table[at, slot] = mark
        return False

    def delete(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        for at in (a, b):
            held = np.flatnonzero(self.table[at] == mark)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def __contains__(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        return bool((self.table[a] == mark).any() or (self.table[b] == mark).any())


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct key in a batch with the number of its documents: summed before any shuffle."""
    for batch in batches:
        counts: dict[bytes, int] = {}
        for text in raw(batch.column("text")):
            for key in {k for line in text.split(b"\n") if (k := line_key(line))}:
                d = _digest(key)
                counts[d] = counts.get(d, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["key", "n_docs"]
        )


def _own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [list({_digest(k) for line in text.split(b"\n") if (k := line_key(line))}) for text in raw(batch.column("text"))]
        ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]), pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array([k for x in own for k in x], pa.binary())], names=["doc_id", "key"])


def reference_counts(docs: DataFrame) -> DataFrame:
    """(key, n_docs): the number of documents in docs that hold a line of this key, for each non-empty key.

    Rows that repeat a doc_id are one document: only these go by (doc_id, key), all others are summed where they are.
    A row of null doc_id is a document of its own.
    """
    rows = text_rows(docs)
    again = stored(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if not again.limit(1).count():
        return rows.select("text").mapInArrow(_occurrences, "key binary, n_docs long").groupBy("key").agg(F.sum("n_docs").alias("n_docs"))
    once = rows.join(again, "doc_id", "left_anti").select("text").mapInArrow(_occurrences, "key binary, n_docs long")
    more = rows.join(again, "doc_id", "left_semi").mapInArrow(_own_keys, "doc_id long, key binary").distinct().groupBy("key").agg(F.count("*").alias("n_docs"))
    return once.union(more).groupBy("key").agg(F.sum("n_docs").alias("n_docs"))


@dataclass
class LineIndex:
    """counts (key, n_docs) is exact; filters (shard, filter) hold the keys found in min_docs documents or more."""

    counts: DataFrame
    filters: DataFrame
    min_docs: int
    n_shards: int = FILTER_SHARDS

    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs).select("key")


def _shard(n: int):
    return F.pmod(F.crc32("key"), F.lit(n)).cast("int").alias("shard")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "filter": [CuckooFilter.of([bytes(k) for k in pdf["key"]]).dump()]})


def _with_filters(counts: DataFrame, min_docs: int, n_shards: int) -> LineIndex:
    frequent = counts.where(F.col("n_docs") >= min_docs).select(_shard(n_shards), "key")
    filters = frequent.groupBy("shard").applyInPandas(_build, "shard int, filter binary")
    return LineIndex(counts, stored(filters, "line-filters"), min_docs, n_shards)


def build_index(docs: DataFrame, min_docs: int = 10, n_shards: int = FILTER_SHARDS) -> LineIndex:
    """An index of all lines of docs. For more keys, give more shards: a shard's frequent keys are one task's."""
    return _with_filters(stored(reference_counts(docs), "line-counts"), min_docs, n_shards)


def _change(index: LineIndex, docs: DataFrame, sign: int) -> LineIndex:
    """Counts move by those of docs, which are other documents than those that stay; of the filters only the keys that
    cross min_docs are put in or taken out."""
    delta = reference_counts(docs).select("key", (F.col("n_docs") * sign).alias("change"))
    moved = stored(
        index.counts.join(delta, "key", "full")
        .select("key", F.coalesce("n_docs", F.lit(0)).alias("old"), (F.coalesce("n_docs", F.lit(0)) + F.coalesce("change", F.lit(0))).alias("n_docs"))
        .where("old > 0 or n_docs > 0"),
        "line-counts",
    )
    at, n_shards = index.min_docs, index.n_shards
    crossed = moved.where((F.col("old") >= at) != (F.col("n_docs") >= at)).select(_shard(n_shards), "key", (F.col("n_docs") >= at).alias("enters"))

    def update(key: tuple, changes: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        old = CuckooFilter.load(held["filter"].iloc[0]) if len(held) else CuckooFilter(64)
        for k in changes.loc[~changes["enters"].astype(bool), "key"]:
            old.delete(bytes(k))
        entering = [bytes(k) for k in changes.loc[changes["enters"].astype(bool), "key"]]
        full = not all(old.insert(k) for k in entering)
        return pd.DataFrame({"shard": [key[0]], "filter": [b"" if full else old.dump()]})

    filters = stored(crossed.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(update, "shard int, filter binary"), "line-filters")
    counts = moved.where("n_docs > 0").select("key", "n_docs")
    if filters.where(F.length("filter") == 0).limit(1).count():  # a filter ran full: make them anew from the exact table
        return _with_filters(counts, at, n_shards)
    return LineIndex(counts, filters, at, n_shards)


def insert_docs(index: LineIndex, docs: DataFrame) -> LineIndex:
    return _change(index, docs, 1)


def delete_docs(index: LineIndex, docs: DataFrame) -> LineIndex:
    """Undo insert_docs(index, docs): the same counts, and filters that answer for the same keys."""
    return _change(index, docs, -1)


def _drop(rows: list, batch: pa.RecordBatch, is_frequent) -> pa.RecordBatch:
    """The rows without frequent lines, beside the batch's columns other than text and keys."""
    texts, n_lines, n_dropped = [], [], []
    for text, own in rows:
        lines = text.split(b"\n")
        kept = [line for line in lines if not ((k := line_key(line)) and is_frequent(k, own))]
        texts.append(b"\n".join(kept))
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(kept))
    carried = [c for c in batch.schema.names if c not in ("doc_id", "text", "keys")]
    columns = [batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
    return pa.RecordBatch.from_arrays(columns + [batch.column(c) for c in carried], names=["doc_id", "text", "n_lines", "n_dropped", *carried])


def drop_frequent_lines(docs: DataFrame, index: LineIndex, broadcast_rows: int = BROADCAST_ROWS, carry: Sequence[str] = ()) -> DataFrame:
    """Each row of docs as (doc_id, text, n_lines, n_dropped), without the lines whose key is frequent in index.

    The cuckoo filter of a key's shard answers first; only keys that it lets through meet the exact table. That
    table is sent to the tasks if it has at most broadcast_rows rows, and is joined beyond. A null or empty text is one
    empty line; empty keys are never dropped. Repeated rows and rows of null doc_id are treated like others
    (beyond the broadcast, rows that repeat a doc_id share the join, which changes nothing: a key is frequent or
    is not). Columns named in carry are returned too; others play no part.
    """
    if set(carry) & {"doc_id", "text", "n_lines", "n_dropped", "keys", "own_id"}:
        raise ValueError(f"carry: {carry} would hide a column of the result")
    rows = text_rows(docs, carry=carry)
    out = f"doc_id long, text string, n_lines long, n_dropped long{''.join(f', `{c}` {docs.schema[c].dataType.simpleString()}' for c in carry)}"
    frequent = index.frequent()
    n = frequent.count()
    if n == 0:
        return rows.mapInArrow(lambda bs: (_drop([(t, None) for t in raw(b.column("text"))], b, lambda k, _: False) for b in bs), out)
    spark = docs.sparkSession
    filters = {r["shard"]: bytes(r["filter"]) for r in index.filters.collect()} if n <= 16 * broadcast_rows else None
    sent_filters = spark.sparkContext.broadcast(filters)
    n_shards = index.n_shards

    def loaded() -> dict:
        return {k: CuckooFilter.load(v) for k, v in (sent_filters.value or {}).items()}

    def maybe(held: dict, seen: dict, key: bytes) -> bytes | None:
        """The digest of a key that the filters let through."""
        if key in seen:
            return seen[key]
        d = _digest(key)
        f = held.get(zlib.crc32(d) % n_shards) if filters is not None else True
        out = d if f is True or f is not None and d in f else None
        if len(seen) > 100_000:
            seen.clear()
        seen[key] = out
        return out

    if n <= broadcast_rows:
        sent_keys = spark.sparkContext.broadcast({bytes(r[0]) for r in frequent.collect()})

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, seen, exact = loaded(), {}, sent_keys.value
            for b in batches:
                yield _drop([(t, None) for t in raw(b.column("text"))], b, lambda k, _: (d := maybe(held, seen, k)) is not None and d in exact)

        return rows.mapInArrow(drop, out)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = loaded(), {}
        for b in batches:
            ids, keys = [], []
            for i, t in zip(b.column("doc_id").to_pylist(), raw(b.column("text")), strict=True):
                own = {d for line in t.split(b"\n") if (k := line_key(line)) and (d := maybe(held, seen, k))}
                ids += [i] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    def drop_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [{bytes(x) for x in ks or ()} for ks in b.column("keys").to_pylist()]
            yield _drop(list(zip(raw(b.column("text")), own, strict=True)), b, lambda k, mine: _digest(k) in mine)

    by_doc = (
        rows.mapInArrow(candidates, "doc_id long, key binary")
        .join(frequent, "key", "left_semi")
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("keys"))
        .withColumnRenamed("doc_id", "own_id")
    )
    joined = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("own_id")), "left").drop("own_id")
    return joined.mapInArrow(drop_own, out)


def line_dedup(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """drop_frequent_lines of docs by an index of docs themselves."""
    return drop_frequent_lines(docs, build_index(docs, min_docs))
