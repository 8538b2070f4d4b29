"""Removal of passages that also stand in a document of a smaller id, by FM-indexes over shards of shared segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.fm_index import FMIndex
from millrace.llm.shared import raw, slices, stored, text_rows
from millrace.llm.words import hash_texts, run_hashes, words

WINDOW, GRAM = 50, 16
#: Words of the different segments in a shard, about: many small shards are dealt evenly.
SHARD_WORDS = 1_000_000
#: A minimizer with more different segments than this is settled by window hashes, which need no common task.
DENSE = 50_000

_A, _B = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


def _sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """min(x[i:i+k]) at i, from running minima of blocks of k."""
    n = len(x) - k + 1
    padded = np.full(-(-len(x) // k) * k, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, k)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[k - 1 : k - 1 + n])


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        both = [np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64)), dtype=np.uint64) for b in (base, inverse)]
    return both[0], both[1]


def _stretch_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of h[start:end], for many stretches at once, from one running sum."""
    up, down = _powers(base, len(h))
    with np.errstate(over="ignore"):
        total = np.append(np.uint64(0), np.cumsum(h * up[: len(h)], dtype=np.uint64))
        return (total[end] - total[start]) * down[start]


def spans(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Maximal runs of windows whose least gram hash (minimizer) is the same, with a hash of their words.

    Equal windows have equal minimizers, wherever they stand; so windows need comparing only within a minimizer.
    """
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            h, sizes = hash_texts(raw(part.column("text")))
            keep = np.flatnonzero(sizes >= window)
            if not len(keep):
                continue
            h = h[np.repeat(sizes >= window, sizes)]
            sizes = sizes[keep]
            first = np.cumsum(sizes) - sizes
            doc = np.repeat(np.arange(len(keep)), sizes)
            low = _sliding_min(run_hashes(h, gram), window - gram + 1)
            ok = doc[: len(low)] == doc[window - 1 :]
            start_of = np.flatnonzero(ok)
            new = np.append(True, (low[start_of[1:]] != low[start_of[:-1]]) | (start_of[1:] != start_of[:-1] + 1))
            at = np.flatnonzero(new)
            start = start_of[at]
            n = np.diff(np.append(at, len(start_of)))
            end = start + n + window - 1
            with np.errstate(over="ignore"):
                twin = (h ^ (h >> np.uint64(31))) * np.uint64(_B)
            owner = doc[start]
            ids = part.column("doc_id").take(pa.array(keep[owner]))
            marks = part.column("mark").take(pa.array(keep[owner]))
            columns = [ids, marks, pa.array(low[start].view(np.int64)), pa.array(_stretch_hash(h, start, end, _A).view(np.int64)), pa.array(_stretch_hash(twin, start, end, _B).view(np.int64)), pa.array((start - first[owner]).astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "value", "h1", "h2", "start", "n"])


SPAN = "doc_id long, mark long, value long, h1 long, h2 long, start int, n int"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the segments asked for, from whole texts."""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for i, text, asked in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text")), batch.column("asked").to_pylist(), strict=True):
            found = words(text)
            for s in asked:
                row = (i, s["value"], s["h1"], s["h2"], s["dense"], b" ".join(found[s["start"] : s["end"]]))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["owner", "value", "h1", "h2", "dense", "words"])


def index_shard(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """Stretches of each segment of a shard that occur in segments of smaller owners."""
    numbers: dict[bytes, int] = {}
    segments = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in bytes(t).split()], np.int64) for t in pdf["words"]]
    held = FMIndex(segments, pdf["owner"].to_numpy()).held_by_smaller(window)
    return pdf[["value", "h1", "h2"]].assign(held=[[{"s": s, "e": e} for s, e in own] for own in held])


def index_shards(frames: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """index_shard() of each shard of a partition, which holds one."""
    held = [f for f in frames if len(f)]
    if held:
        for _, shard in pd.concat(held, ignore_index=True).groupby("shard"):
            yield index_shard(shard.drop_duplicates(["value", "h1", "h2"]), window)


HELD = "value long, h1 long, h2 long, held array<struct<s: int, e: int>>"


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, dense: int = DENSE) -> DataFrame:
    """(doc_id, mark, cuts): stretches of words [s, e) that a document of a smaller doc_id also has; mark is a text's hash."""
    rows = text_rows(docs).where("doc_id is not null and text is not null").withColumn("mark", F.xxhash64("text"))
    every = stored(rows.mapInArrow(lambda b: spans(b, window, gram), SPAN), "spans")
    shared_values = every.groupBy("value").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("value")
    shared = stored(every.join(shared_values, "value", "left_semi"), "shared-spans")
    key = ["value", "h1", "h2"]
    distinct = shared.groupBy(*key).agg(F.min(F.struct("doc_id", "mark", "start", "n")).alias("first"))
    different = distinct.groupBy("value").agg(F.count("*").alias("segments")).where("segments > 1")
    asked = stored(
        distinct.join(different, "value").select(
            F.col("first.doc_id").alias("doc_id"), F.col("first.mark").alias("mark"), *key, F.col("first.start").alias("start"),
            (F.col("first.start") + F.col("first.n") + window - 1).alias("end"), (F.col("segments") > dense).alias("dense"),
        ),
        "asked-spans",
    )
    n_shards = 1 + (asked.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0) // SHARD_WORDS
    by_doc = asked.groupBy("doc_id", "mark").agg(F.collect_list(F.struct(*key, "start", "end", "dense")).alias("asked"))
    segments = rows.join(by_doc, ["doc_id", "mark"]).select("doc_id", "text", "asked").mapInArrow(
        _cut, "owner long, value long, h1 long, h2 long, dense boolean, words binary"
    )
    held = (
        segments.where("not dense")
        .withColumn("shard", F.pmod("value", F.lit(n_shards)).cast("int"))
        .repartitionById(int(n_shards), "shard")  # a task for each shard: a hash of the number would put several into one
        .mapInPandas(lambda frames: index_shards(frames, window), HELD)
    )
    if asked.where("dense").limit(1).count():
        held = held.unionByName(_dense(segments.where("dense").dropDuplicates(key), window))
    first = distinct.select(*key, F.col("first.doc_id").alias("owner")).join(held, key, "left")
    whole = F.array(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("n") + window - 1).alias("e")))
    moved = F.transform("held", lambda x: F.struct((x["s"] + F.col("start")).alias("s"), (x["e"] + F.col("start")).alias("e")))
    cuts = shared.join(first, key).select("doc_id", "mark", F.when(F.col("doc_id") > F.col("owner"), whole).otherwise(moved).alias("cuts"))
    return cuts.where(F.size("cuts") > 0).groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))


def _dense(segments: DataFrame, window: int) -> DataFrame:
    """The same answer for minimizers with very many segments: the least owner of each window's words, by hash."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            names = ["owner", "value", "h1", "h2"]
            for owner, value, h1, h2, text in zip(*(batch.column(c).to_pylist() for c in names), raw(batch.column("words")), strict=True):
                found = text.split()
                for s in range(len(found) - window + 1):
                    for column, x in zip(out, (owner, value, h1, h2, s, xxhash.xxh3_128_digest(b" ".join(found[s : s + window]))), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[*names, "s", "window"])

    each = stored(segments.select("owner", "value", "h1", "h2", "words").mapInArrow(windows, "owner long, value long, h1 long, h2 long, s int, window binary"), "windows")
    least = each.groupBy("window").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).where("least < most")
    late = each.join(least, "window").where("owner > least")
    return late.groupBy("value", "h1", "h2").agg(F.collect_list(F.struct("s", (F.col("s") + window).alias("e"))).alias("held"))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, texts = [], [], []
        for text, cuts in zip(raw(batch.column("text")), batch.column("cuts").to_pylist(), strict=True):
            found = words(text)
            n_words.append(len(found))
            if cuts:
                gone = np.zeros(len(found), bool)
                for c in cuts:
                    gone[c["s"] : c["e"]] = True
                found = [found[i] for i in np.flatnonzero(~gone)]
            n_removed.append(n_words[-1] - len(found))
            texts.append(b" ".join(found))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
            names=["doc_id", "key", "n_words", "n_removed", "kept"],
        )


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, n_words, n_removed, kept) for each row of docs: kept are the words that stay, joined by one space.

    A word goes if a window of `window` words around it starts, word for word, in a document with a smaller doc_id
    too; windows are judged on the input. Null, empty and blank texts have no words. Rows that repeat a doc_id
    are windows of one document and take nothing from each other; rows of null doc_id stay whole and take
    nothing from others. key is the text's hash. An empty table gives no rows; other columns play no part.
    """
    rows = text_rows(docs).withColumn("mark", F.xxhash64("text"))
    cuts = removals(docs, window)
    return rows.join(cuts, ["doc_id", "mark"], "left").select("doc_id", F.col("mark").alias("key"), "text", "cuts").mapInArrow(
        _keep, "doc_id long, key long, n_words long, n_removed long, kept string"
    )


def cut_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the texts that substring_dedup leaves; a text that loses no word stays as it is, null included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                if cuts:
                    found = words(text.encode())
                    gone = np.zeros(len(found), bool)
                    for c in cuts:
                        gone[c["s"] : c["e"]] = True
                    text = b" ".join([found[i] for i in np.flatnonzero(~gone)]).decode()
                texts.append(text)
            names = [c for c in batch.schema.names if c != "cuts"]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    cuts = removals(docs, window).select(F.col("doc_id").alias("cut_id"), F.col("mark").alias("cut_mark"), "cuts")
    on = (F.col("doc_id") == F.col("cut_id")) & (F.xxhash64("text") == F.col("cut_mark"))
    return docs.join(cuts, on, "left").drop("cut_id", "cut_mark").mapInArrow(run, docs.schema)
