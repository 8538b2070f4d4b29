"""Token ids in Simple-8b words: a table of blocks, each with its words, selectors' escapes and offsets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import raw, shards, slices, text_rows
from millrace.llm.tokens import default_path, encoder

#: Fixed values of the format, by selector (the top 4 bits of a word): ids in a word, bits of each.
COUNTS = np.array([0, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Selector 0 is an escape: the word's low 32 bits say how many raw 32-bit ids follow, two in a word. The encoder uses
#: it for a value that no other selector holds; selector 1 is a run: low 28 bits a count, the next 32 bits the id.
BLOCK_IDS = 1 << 16
BLOCKS = "part int, block int, first_id long, n_ids int, words binary, doc_ids array<long>, doc_starts array<long>"


def _bits(ids: np.ndarray) -> np.ndarray:
    return np.frexp(ids.astype(np.float64))[1]


def _all_of(flags: np.ndarray, k: int) -> np.ndarray:
    """Where k flags in a row are set, as the positions of the first."""
    done, out = 1, flags
    while done < k and out.any():
        step = min(done, k - done)
        out = out[:-step] & out[step:]
        done += step
    return np.flatnonzero(out) if done == k else np.empty(0, np.int64)


def encode_words(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of ids (unsigned, up to 32 bits): each word takes as many of the next ids as fit."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    bits = _bits(ids)
    takes = np.ones(n, np.int32)
    selectors = np.full(n, 15, np.uint64)
    for s in range(14, 1, -1):
        fits = _all_of(bits <= WIDTHS[s], int(COUNTS[s])) if n >= COUNTS[s] else ()
        if len(fits):
            takes[fits], selectors[fits] = COUNTS[s], s
    same = ids[1:] == ids[:-1]
    if len(_all_of(same, 60)) if n > 60 else False:
        at = np.arange(n, dtype=np.int32)
        runs = np.minimum.accumulate(np.where(np.append(~same, True), at, n)[::-1])[::-1] - at + 1
        long_run = np.minimum(runs, (1 << 28) - 1) > np.maximum(takes, 60)
        takes[long_run], selectors[long_run] = np.minimum(runs, (1 << 28) - 1)[long_run], 1
    starts, at, step = [], 0, takes.tolist()
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts)
    chosen, count = selectors[starts], takes[starts]
    words = chosen << np.uint64(60)
    wide = ids.astype(np.uint64)
    for s in range(2, 16):
        own = np.flatnonzero(chosen == s)
        for k in range(int(COUNTS[s])):
            words[own] |= wide[starts[own] + k] << np.uint64(k * WIDTHS[s])
    own = chosen == 1
    words[own] |= (wide[starts[own]] << np.uint64(28)) | count[own].astype(np.uint64)
    return words


def decode_words(words: np.ndarray) -> np.ndarray:
    """The ids of encode_words, all words of a selector at once."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    escaped = np.flatnonzero(chosen == 0)
    raw_words = np.zeros(len(words), bool)
    for at in escaped:  # rare: raw words are no selectors
        if not raw_words[at]:
            raw_words[at + 1 : at + 1 + (int(words[at] & np.uint64(0xFFFFFFFF)) + 1) // 2] = True
    chosen[raw_words] = -1
    count = np.where(chosen >= 2, COUNTS[np.maximum(chosen, 0)], 0)
    count[chosen == 1] = (words[chosen == 1] & np.uint64((1 << 28) - 1)).astype(np.int64)
    count[chosen == 0] = (words[chosen == 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint32)
    for s in range(2, 16):
        own = np.flatnonzero(chosen == s)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(int(COUNTS[s])):
            out[starts[own] + k] = (words[own] >> np.uint64(k * WIDTHS[s])) & mask
    for at in np.flatnonzero(chosen == 1):
        out[starts[at] : starts[at] + count[at]] = (words[at] >> np.uint64(28)) & np.uint64(0xFFFFFFFF)
    for at in np.flatnonzero(chosen == 0):
        n = int(count[at])
        out[starts[at] : starts[at] + n] = words[at + 1 : at + 1 + (n + 1) // 2].view(np.uint32)[:n]
    return out


def escape(ids: np.ndarray) -> np.ndarray:
    """ids as raw 32-bit values behind an escape word: shorter than coding where most take over 30 bits."""
    padded = np.append(ids.astype("<u4"), np.zeros(len(ids) % 2, "<u4"))
    return np.append(np.array([len(ids)], np.uint64), padded.view(np.uint64))


def encode_block(ids: np.ndarray) -> bytes:
    words = encode_words(ids)
    if len(words) > len(ids) // 2 + 2:
        words = escape(ids)
    return words.astype("<u8").tobytes()


def decode_block(data: bytes) -> np.ndarray:
    return decode_words(np.frombuffer(data, "<u8"))


def write_tokens(docs: DataFrame, to: str, path: str | None = None, end_id: int = 2, partitions: int | None = None) -> None:
    """Encode every text, append end_id, and write the ids in ascending doc_id order at `to`, in blocks.

    Rows are dealt by ranges of doc_id before they are encoded, so a task holds a block of its range at a time. A
    block ends with the first document that brings it to BLOCK_IDS ids. Order: part, block, then doc_starts,
    the offsets in the block of doc_ids; first_id counts from the part's start. A null or empty text is the end id
    alone; rows that repeat a doc_id stand next to each other; null doc_ids come first; no rows, no blocks.
    """
    path = path or default_path()
    n = partitions or shards(docs.sparkSession)
    ranged = text_rows(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first, held = TaskContext.get().partitionId(), 0, 0, 0
        stream: list[np.ndarray] = []
        ids: list[int | None] = []
        starts: list[int] = []

        def cut() -> pa.RecordBatch:
            nonlocal block, first, stream, held, ids, starts
            row = (part, block, first, held, encode_block(np.concatenate(stream)), ids, starts)
            block, first, stream, held, ids, starts = block + 1, first + held, [], 0, [], []
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        end = np.array([end_id], "<u4")
        for batch in batches:
            for some in slices(batch, "text"):
                found = encoder(path).encode([t.decode() for t in raw(some.column("text"))])
                for i, t in zip(some.column("doc_id").to_pylist(), found, strict=True):
                    ids.append(i)
                    starts.append(held)
                    stream += [t, end]
                    held += len(t) + 1
                    if held >= BLOCK_IDS:
                        yield cut()
        if held:
            yield cut()

    ranged.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(to)


def part_offsets(spark: SparkSession, to: str) -> list[int]:
    """Ids before each part: one number for each part, not for each document."""
    totals = {r["part"]: r["n"] for r in spark.read.schema(BLOCKS).parquet(to).groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    out, total = [], 0
    for part in range(max(totals, default=-1) + 1):
        out.append(total)
        total += totals.get(part, 0)
    return out


def read_tokens(spark: SparkSession, to: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) and, with_ids, the ids of each document in the files at `to`."""
    offsets = part_offsets(spark, to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["words"])
                starts = row["doc_starts"]
                parts = [ids[s:e] for s, e in zip(starts, [*starts[1:], len(ids)], strict=True)]
                first = offsets[row["part"]] + row["first_id"]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array([first + s for s in starts], pa.int64()), pa.array([len(x) for x in parts], pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return spark.read.schema(BLOCKS).parquet(to).mapInArrow(run, schema)
