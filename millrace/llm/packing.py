"""Cost-balanced packing of token sequences for training."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import raw, slices, text_rows
from millrace.llm.tokens import default_path, encoder

CAPACITY = 1024
#: Documents are packed in windows of about so many tokens as they stream by: bounded memory, no shuffle.
WINDOW_TOKENS = 2_000_000
LINEAR, QUADRATIC = 1.0, 1.0 / 512
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(length: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    """Estimated cost of a piece: each token once, and attention within the piece."""
    return linear * length + quadratic * length * length


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(document, start, length, sequence) of each piece, for documents of these lengths; the offsets in a sequence
    follow the order of the list.

    The sequences' capacities add up to the tokens exactly: all have the full one but the last few, which have
    powers of two, so no sequence needs padding. Full stretches of a document longer than the capacity are
    sequences of their own. The rest go, longest first, to the sequence of the lowest cost that has room; what
    does not fit there is cut off and goes on as a shorter document.
    """
    total = sum(lengths)
    rooms = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if (total % capacity) >> b & 1]
    pieces, waiting, used = [], [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((doc, start, capacity, used))
            used += 1
        if n % capacity:
            waiting.append((-(n % capacity), doc, n - n % capacity))
    heapq.heapify(waiting)
    open_ = [(0.0, seq) for seq in range(used, len(rooms))]
    room = dict(zip(range(used, len(rooms)), rooms[used:], strict=True))
    while waiting:
        n, doc, start = heapq.heappop(waiting)
        now, seq = heapq.heappop(open_)
        put = min(-n, room[seq])
        pieces.append((doc, start, put, seq))
        room[seq] -= put
        if room[seq]:
            heapq.heappush(open_, (now + cost(put), seq))
        if put < -n:
            heapq.heappush(waiting, (n + put, doc, start + put))
    return pieces


def pack_documents(
    docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False, window_tokens: int = WINDOW_TOKENS
) -> DataFrame:
    """A row for each piece of each row of docs: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Each text is encoded whole, end_id is appended, and every id lies in exactly one piece. Within a sequence the
    offsets are gapless from 0. Sequences hold capacity ids, or a power of two below it at the end of a window
    of about window_tokens. A null or empty text is the end id alone. Rows that repeat a doc_id, or whose
    doc_id is null, are packed one by one like others; an empty table gives no rows. with_ids adds the ids.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        ids: list = []
        tokens: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, ids, tokens, held
            at: dict[int, int] = {}
            out: list[list] = [[] for _ in range(8)]
            last = -1
            for doc, start, n, seq in pack([len(t) for t in tokens], capacity):
                part = tokens[doc][start : start + n]
                offset = at.get(seq, 0)
                at[seq] = offset + n
                last = max(last, seq)
                for column, value in zip(out, (ids[doc], start, n, zlib.crc32(part), len(tokens[doc]), sequence + seq, offset, part), strict=True):
                    column.append(value)
            sequence += last + 1
            ids, tokens, held = [], [], 0
            arrays = [pa.array(c, pa.int64()) for c in out[:7]]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            if with_ids:
                arrays.append(pa.array(out[7], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        end = np.array([end_id], "<u4")
        for batch in batches:
            for part in slices(batch, "text"):
                for i, found in zip(part.column("doc_id").to_pylist(), encoder(path).encode([t.decode() for t in raw(part.column("text"))]), strict=True):
                    ids.append(i)
                    tokens.append(np.concatenate((found, end)))
                    held += len(found) + 1
                    if held >= window_tokens:
                        yield flush()
        if tokens:
            yield flush()

    return text_rows(docs).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def sequences(pieces: DataFrame) -> DataFrame:
    """The training sequences (sequence_id, ids, n_docs) of pieces made with_ids."""
    return (
        pieces.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"), F.size("parts").alias("n_docs"))
    )
