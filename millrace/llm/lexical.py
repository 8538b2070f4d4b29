"""Ranked lexical search: impacts of matched item and document are sorted by packed keys and summed by runs."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import raw, slices, stored, text_rows

#: Bytes of item text that one pass over the postings answers; items beyond are answered in further blocks.
BLOCK_BYTES = 32 << 20
#: Impacts that are sorted at once: documents are taken in ranges of at most so many, one document at least.
MOST_IMPACTS = 1 << 21
#: All bytes that belong to no term become spaces, A-Z become a-z; other bytes stay, those of characters beyond ASCII too.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Term numbers, their counts and length of a document are kept for each document that has a term at all.
POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
HITS = "item int, doc_id long, score long"


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case."""
    return text.translate(_FOLD).split()


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts unsigned keys: stable passes over 16 bits each, from the lowest that differ to the highest."""
    order = np.arange(len(keys))
    most = int(keys.max()) if len(keys) else 0
    for shift in range(0, most.bit_length(), 16):
        order = order[np.argsort((keys[order] >> np.uint64(shift)).astype(np.uint16), kind="stable")]
    return order


def summed(items: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, sum of impacts) of each pair, by packed keys in ascending order."""
    if not len(items):
        return items, docs, impacts
    wide = int(docs.max()) + 1
    keys = items.astype(np.uint64) * np.uint64(wide) + docs.astype(np.uint64)
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[first] // np.uint64(wide)).astype(np.int64), (keys[first] % np.uint64(wide)).astype(np.int64), np.add.reduceat(impacts[order], first)


class Best:
    """The k best (score, document) of each item: a heap for each; the worst of a full heap keeps others out."""

    def __init__(self, n_items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n_items)]
        self.bar = np.zeros(n_items, np.int64)

    def offer(self, items: np.ndarray, ids: list[int | None], docs: np.ndarray, scores: np.ndarray) -> None:
        for at in np.flatnonzero((scores > 0) & (scores >= self.bar[items])):
            item, doc = int(items[at]), ids[docs[at]]
            heap, entry = self.heaps[item], (int(scores[at]), math.inf if doc is None else -doc)  # null before all others
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.bar[item] = heap[0][0]

    def batch(self) -> pa.RecordBatch:
        rows = [(item, None if doc == math.inf else -int(doc), score) for item, heap in enumerate(self.heaps) for score, doc in heap]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """POSTINGS of each row of docs: of terms in `numbers` alone, while n counts all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.get
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                rows, lengths, found = [], [], []
                for row, text in enumerate(raw(part.column("text"))):
                    terms = terms_of(text)
                    if terms:
                        rows.append(row)
                        lengths.append(len(terms))
                        found.append(np.fromiter((x for x in map(number, terms) if x is not None), np.int64))
                size = np.array([len(x) for x in found], np.int64)
                # of each (document, term) the number of times, by sorting packed keys once for all documents of the part
                keys = np.concatenate([np.empty(0, np.int64), *found]) + np.repeat(np.arange(len(rows)), size) * len(numbers)
                keys, counts = np.unique(keys, return_counts=True)
                ends = np.searchsorted(keys, np.arange(len(rows) + 1) * len(numbers)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(rows, pa.int64())),
                        pa.array(lengths, pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(keys % max(len(numbers), 1), pa.int32())),
                        pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32())),
                    ],
                    names=["doc_id", "n", "terms", "counts"],
                )

    return text_rows(docs).mapInArrow(run, POSTINGS)


def hits(kept: DataFrame, weights: np.ndarray, starts: np.ndarray, items: np.ndarray, n_items: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """HITS: the k best documents that each task has seen of each item. items[starts[t]:starts[t + 1]] are those that hold term t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, fan = Best(n_items, k), np.diff(starts)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            lists, counts = batch.column("terms"), batch.column("counts").flatten().to_numpy().astype(np.int64)
            terms = lists.flatten().to_numpy()
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            n = batch.column("n").to_numpy()
            m = np.array([10 + 90 * x * n_docs // n_terms for x in n.tolist()], np.int64)
            docs = np.repeat(np.arange(len(ids)), size)
            impacts = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[docs]))
            matched = fan[terms]
            upto = np.concatenate(([0], np.cumsum(matched)))[np.concatenate(([0], np.cumsum(size)))]  # impacts before each document
            row, edge = 0, np.concatenate(([0], np.cumsum(size)))
            while row < len(ids):
                to = max(row + 1, int(np.searchsorted(upto, upto[row] + MOST_IMPACTS, side="right")) - 1)
                part = slice(int(edge[row]), int(edge[to]))
                each = matched[part]
                begin = np.repeat(starts[terms[part]] - np.concatenate(([0], np.cumsum(each)[:-1])), each) if len(each) else each
                target = items[begin + np.arange(len(begin))]
                found = summed(target, np.repeat(docs[part] - row, each), np.repeat(impacts[part], each))
                best.offer(found[0], ids[row:to], found[1], found[2])
                row = to
        yield best.batch()

    return kept.mapInArrow(run, HITS)


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of about BLOCK_BYTES of text, dealt by a hash of the id."""
    own = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // BLOCK_BYTES
    for block in range(n):
        rows = own if n == 1 else own.where(F.pmod(F.hash("item_id"), F.lit(n)) == block)
        # null and empty texts hold no term: no document is found for them
        yield [(r["item_id"], bytes(r["data"])) for r in rows.where("text <> ''").select("item_id", F.encode("text", "UTF-8").alias("data")).collect()]


def _ranked(docs: DataFrame, block: list[tuple[int, bytes]], k: int) -> DataFrame:
    spark = docs.sparkSession
    sets = [sorted(set(terms_of(text))) for _, text in block]
    numbers: dict[bytes, int] = {}
    for term in (t for s in sets for t in s):
        numbers.setdefault(term, len(numbers))
    kept = stored(postings(docs, numbers), "postings")
    n_docs, n_terms = kept.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(len(numbers), np.int64)
    for r in kept.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term of the block
        frequency[r["t"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)
    pairs = sorted((numbers[t], i) for i, s in enumerate(sets) for t in s)
    items = np.array([i for _, i in pairs], np.int64)
    starts = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(numbers) + 1))
    found = hits(kept, weights, starts, items, len(block), n_docs, max(n_terms, 1), k)
    first = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    best = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id long")
    return best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of each item with the highest scores above 0, equal ones by ascending doc_id.

    Documents are read once for each block of items (BLOCK_BYTES); their postings of the block's terms are stored in the shared folder.
    Each task works on its own range of documents: it concatenates the arrays of item, document and impact, sorts them by packed key
    with a radix sort, sums the runs and keeps the k best of each item in a heap; a window then ranks what the tasks have kept.
    Weights are floor(1000 ln((2N + 2) / (2 df + 1))) with all documents counted; all else is 64-bit integer.

    Null and empty texts hold no term: such documents are not found and not counted, such items find nothing. Rows that repeat a doc_id
    are documents of their own; so are items that repeat an item_id, each with ranks from 1. A null doc_id comes first among equals.
    Other columns of any name make no difference; an empty table on either side gives no rows.
    """
    out = None
    for block in _blocks(items, item_col, text_col):
        found = _ranked(docs, block, k)
        out = found if out is None else out.unionByName(found)
    return out
