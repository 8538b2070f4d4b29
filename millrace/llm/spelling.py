"""Spelling variants: words one edit apart, found in blocks of a dictionary sorted forward and reversed."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import BROADCAST_ROWS, raw, shards, slices, stored, text_rows

#: Blocks of more words are subdivided, as long as more than one place is open.
MOST_WORDS = 256
#: Distinct words that a task counts before it hands its sums on, and cells of letters compared at once.
HELD_WORDS, MOST_CELLS = 200_000, 1 << 22
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RUNS = re.compile("[a-zÀ-ÿ]+")
NEAR = "word string, n_near long, rank struct<less: long, form: string>"
BLOCK = ["m", "a", "b", "head", "tail"]


def dictionary(docs: DataFrame, divisor: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): lower-cased runs of letters of all texts, of at least `shortest` code points and `least` occurrences in all.

    Where the unsigned crc32 h of `<doc_id>:<run>` is a multiple of divisor, the run loses its code point h % length. Tasks sum what they
    read before anything is shuffled. Null texts have no words; a null doc_id is written as nothing before the colon; bytes that are no
    UTF-8 end a run. Repeated rows count each, other columns of any name make no difference, an empty table gives no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        crc, runs = zlib.crc32, _RUNS.findall

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), raw(part.column("text")), strict=True):
                    start = crc(b":" if doc_id is None else b"%d:" % doc_id)
                    for word, n in Counter(runs(text.translate(_LOWER).decode("utf-8", "replace"))).items():
                        h = crc(word.encode(), start)
                        if not h % divisor:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= shortest:
                            total[word] += n
                    if len(total) >= HELD_WORDS:
                        yield given()
        yield given()

    return text_rows(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _places(m: Column, a: Column, b: Column) -> Column:
    """The two halves of a block: of the m - a - b open places of the shorter word, those before the middle or those after it hold no edit."""
    half = F.floor((m - a - b) / 2).cast("int")
    return F.array(F.struct(m.alias("m"), (a + half).alias("a"), b.alias("b")), F.struct(m.alias("m"), a.alias("a"), (m - a - half).alias("b")))


def _keyed(words: DataFrame, places: Column) -> DataFrame:
    each = words.select("word", "n", F.explode(places).alias("p")).select("word", "n", "p.m", "p.a", "p.b")
    return each.withColumn("head", F.substring("word", F.lit(1), F.col("a"))).withColumn("tail", F.reverse(F.right("word", F.col("b"))))


def blocks(words: DataFrame) -> DataFrame:
    """(m, a, b, head, tail, word, n): words of m or m + 1 code points that share their first a (head) and last b (tail, reversed).

    Two words one edit apart, the shorter of m code points, share the first half or the last: one edit leaves a half intact. So each word
    stands in blocks of shared prefixes (forward dictionary) and of shared suffixes (reversed dictionary), for m its own length and
    one less. Blocks of more than MOST_WORDS are halved the same way within their open places, until one place is open."""
    size = F.length("word")
    whole = lambda m: F.when(m > 1, _places(m, F.lit(0), F.lit(0))).otherwise(F.array(F.struct(m.alias("m"), F.lit(0).alias("a"), F.lit(0).alias("b"))))
    level = _keyed(words.where("word is not null"), F.concat(whole(size), F.when(size > 0, whole(size - 1)).otherwise(F.array().cast("array<struct<m:int,a:int,b:int>>"))))
    done = None
    while True:
        crowded = stored(level.where("m - a - b > 1").groupBy(*BLOCK).count().where(F.col("count") > MOST_WORDS).select(*BLOCK), "crowded")
        n = crowded.count()
        small = F.broadcast(crowded) if n <= BROADCAST_ROWS else crowded
        settled = level.join(small, BLOCK, "left_anti") if n else level
        done = settled if done is None else done.unionByName(settled)
        if not n:
            return done
        level = _keyed(level.join(small, BLOCK, "left_semi"), _places(F.col("m"), F.col("a"), F.col("b")))


def _letters(words: list[str], begin: int, end: int) -> np.ndarray:
    """Code points of the places begin to end of words of one length."""
    wide = len(words[0])
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), wide)[:, begin : wide - end]


def verified(m: int, a: int, b: int, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of places in words, i < j or the shorter first, of the block's words one edit apart, the shorter of m code points.

    A pair that shares both halves of a block above belongs to that of the prefix: a block of a suffix (b > 0) leaves out the pairs of which
    all open places of the shorter word agree from the front, so each pair comes from one block."""
    by_size = [np.array([i for i, w in enumerate(words) if len(w) == n], np.int64) for n in (m, m + 1)]
    short, long = by_size
    if not len(short):
        return
    x = _letters([words[i] for i in short], a, b)
    places = x.shape[1]
    step = max(1, MOST_CELLS // (max(len(short), len(long)) * max(places, 1)))
    for at in range(0, len(short), step):
        part = x[at : at + step]
        if len(short) > 1:
            i, j = np.nonzero((part[:, None, :] != x[None, :, :]).sum(2) == 1)
            once = i + at < j
            yield short[i[once] + at], short[j[once]]
        if len(long):
            y = _letters([words[i] for i in long], a, b)
            front = np.logical_and.accumulate(part[:, None, :] == y[None, :, :-1], axis=2).sum(2)
            back = np.logical_and.accumulate((part[:, None, :] == y[None, :, 1:])[:, :, ::-1], axis=2).sum(2)
            i, j = np.nonzero((front + back >= places) & ((front < places) if b else True))
            yield short[i + at], long[j]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """NEAR of each block, blocks in their sorted order: how many near words a word has in the block, and the one of largest n."""
    key, words, sizes = None, [], []
    out: list[tuple] = []

    def close() -> None:
        found: dict[int, list] = {}
        for left, right in verified(key[0], key[1], key[2], words):
            for one, other in (*zip(left.tolist(), right.tolist(), strict=True), *zip(right.tolist(), left.tolist(), strict=True)):
                entry, rank = found.setdefault(one, [0, None]), (-sizes[other], words[other])
                entry[0] += 1
                if entry[1] is None or rank < entry[1]:
                    entry[1] = rank
        out.extend((words[i], n, {"less": rank[0], "form": rank[1]}) for i, (n, rank) in found.items())

    def given() -> pa.RecordBatch:
        rows = list(zip(*out, strict=True)) or [(), (), ()]
        out.clear()
        kinds = (pa.string(), pa.int64(), pa.struct([("less", pa.int64()), ("form", pa.string())]))
        return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], names=["word", "n_near", "rank"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*BLOCK, "word", "n")]
        for *at, word, n in zip(*columns, strict=True):
            if at != key:
                if len(words) > 1:
                    close()
                key, words, sizes = at, [], []
            words.append(word)
            sizes.append(n)
        if out:
            yield given()
    if len(words) > 1:
        close()
    yield given()


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of each word that has one at one edit: how many, and the one of largest n, the smallest of equal ones."""
    kept = blocks(words)
    dealt = kept.repartitionByRange(shards(kept.sparkSession), *BLOCK).sortWithinPartitions(*BLOCK)
    sums = dealt.mapInArrow(_scan, NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("rank").alias("rank"))
    return sums.select("word", "n_near", F.col("rank.form").alias("form"), (-F.col("rank.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each row (word, form): the last word that forms lead to. Each round doubles the steps that a row has made."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    n = now.count()
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = F.broadcast(ahead) if n <= BROADCAST_ROWS else ahead
        moved = stored(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return now


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of (word, n).

    Near words differ by one inserted, deleted or replaced code point. form is the near word of largest n (ties: the smallest in code-point
    order) if its n is at least times that of the word; root is where forms lead, the word itself without one. n grows along forms, so they
    lead round no circle. Rows that repeat a word add up, null words are left out, other columns make no difference, no words give no rows.
    """
    own = stored(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    found = near(own)
    led = F.col("form_n") >= times * F.col("n")
    placed = stored(
        own.join(found, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("form")).alias("form"), F.when(led, F.col("form_n")).alias("form_n")
        ),
        "forms",
    )
    ends = roots(placed.where("form is not null"))
    return placed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
