"""Approximate nearest neighbours by inner product over balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import shards, stored

#: Centroids, and the ratio by which lists are pruned, are fitted on a sample of at most so many distinct vectors; every
#: vector is indexed. There are LISTS * sqrt(n) lists, and at least MEMBERS sampled vectors for each.
SAMPLE, LISTS, MEMBERS = 50_000, 4, 8
#: A boundary vector goes to further lists whose centroid is at most CLOSURE times as far as the nearest and is not
#: nearer to a list it already has: to REPLICAS lists in all, of the ASSIGN_WIDTH nearest.
CLOSURE, REPLICAS, ASSIGN_WIDTH = 1.05, 4, 16
#: The share of the neighbours in the sample that the fitted ratio must reach, with so many sampled queries.
TARGET, TRIALS = 0.93, 256
#: Lists that lie together make a shard of about so many vectors, longer lists several; queries come in blocks.
SHARD_VECTORS, QUERY_BLOCK = 20_000, 5_000
#: So many queries meet the vectors of a shard that they read as one matrix: a task holds its scores, never those of a whole block.
SCAN_BLOCK = 128


def balanced_centroids(x: np.ndarray, n_lists: int, seed: int = 1) -> np.ndarray:
    """Means of leaves of about equal size, neighbours next to each other: a part is halved at the median along the
    direction of a 2-means split, and its halves share the leaves."""
    rng = np.random.default_rng(seed)

    def halves(own: np.ndarray, leaves: int) -> list[np.ndarray]:
        if leaves <= 1 or len(own) < 2:
            return [x[own].mean(0)]
        a, b = x[rng.choice(own, 2, replace=False)]
        for _ in range(6):
            side = x[own] @ (a - b) > (a @ a - b @ b) / 2
            if side.all() or not side.any():
                break
            a, b = x[own[side]].mean(0), x[own[~side]].mean(0)
        order = np.argsort(x[own] @ (a - b), kind="stable")
        left = leaves // 2
        half = max(1, len(own) * left // leaves)
        return halves(own[order[:half]], left) + halves(own[order[half:]], leaves - left)

    return np.array(halves(np.arange(len(x)), n_lists))


@dataclass
class CentroidGraph:
    """Centroids with links to near ones, searched best first from fixed entries."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray, degree: int = 48, n_entries: int = 128) -> CentroidGraph:
        n = len(centroids)
        near = [np.argsort(_squared(centroids[i : i + 1024], centroids), axis=1, kind="stable")[:, 1 : degree * 2 // 3 + 1] for i in range(0, n, 1024)]
        rng = np.random.default_rng(2)
        far = rng.integers(0, n, (n, degree // 3)) if n else np.zeros((0, degree // 3), int)  # long links keep it in one piece
        return cls(centroids, np.concatenate((np.concatenate(near), far), axis=1) if n else far, np.arange(0, n, max(1, n // n_entries)))

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest centroids found for each row of x, nearest first, with squared distances.

        Every round opens the nearest centroids of each row that are not open yet, meets those they link to, and keeps the
        nearest; it ends where no unopened one is among the nearest `width`.
        """
        n_lists, n = len(self.centroids), len(x)
        width = min(width, n_lists)
        norms, rows = (self.centroids**2).sum(1), np.arange(n)[:, None]
        seen = np.zeros((n, n_lists), bool)
        seen[:, self.entries] = True
        ids = np.broadcast_to(self.entries, (n, len(self.entries))).copy()
        d = norms[self.entries] - 2 * x @ self.centroids[self.entries].T
        opened = np.zeros(ids.shape, bool)
        step = min(max(4, width // 8), ids.shape[1])
        while True:
            front = np.where(opened, np.inf, d)
            pick = np.argpartition(front, step - 1, axis=1)[:, :step] if step < front.shape[1] else np.broadcast_to(np.arange(front.shape[1]), front.shape)
            worth = np.isfinite(np.take_along_axis(front, pick, 1))
            if d.shape[1] >= width:
                worth &= np.take_along_axis(front, pick, 1) <= np.partition(d, width - 1, axis=1)[:, width - 1 : width]
            if not worth.any():
                break
            np.put_along_axis(opened, pick, np.take_along_axis(opened, pick, 1) | worth, 1)
            fresh = self.links[np.take_along_axis(ids, pick, 1)].reshape(n, -1)
            new = np.repeat(worth, self.links.shape[1], axis=1) & ~seen[rows, fresh]
            order = np.argsort(np.where(new, fresh, -1), axis=1)  # equal ones stand together: keep one of each
            fresh, new = np.take_along_axis(fresh, order, 1), np.take_along_axis(new, order, 1)
            new[:, 1:] &= (fresh[:, 1:] != fresh[:, :-1]) | ~new[:, :-1]
            r, c = np.nonzero(new)
            seen[r, fresh[r, c]] = True
            more = np.full(fresh.shape, np.inf)
            more[r, c] = norms[fresh[r, c]] - 2 * np.einsum("ij,ij->i", x[r], self.centroids[fresh[r, c]])
            ids, d, opened = np.concatenate((ids, fresh), 1), np.concatenate((d, more), 1), np.concatenate((opened, ~new), 1)
            if d.shape[1] > width:
                best = np.argpartition(d, width - 1, axis=1)[:, :width]
                ids, d, opened = (np.take_along_axis(v, best, 1) for v in (ids, d, opened))
        order = np.argsort(d, axis=1, kind="stable")[:, :width]
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        return ids, np.maximum(d + (x**2).sum(1)[:, None], 0)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v double[]) of the rows that take part: no nulls, no non-finite components, not zero."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return v.where("vec_id is not null and v is not null").where(~bad & F.exists("v", lambda e: e != 0))


@dataclass
class PostingIndex:
    """items (rep, v, ids): each distinct vector with the smallest ids that have it; graph over centroids; reach: the
    largest norm; ratio: a query reads the lists whose centroid is at most so many times as far as the nearest."""

    items: DataFrame
    graph: CentroidGraph
    reach: float
    n_items: int
    keep: int
    ratio: float


def _lifted(x: np.ndarray, reach: float) -> np.ndarray:
    """Vectors with a component that gives all the same norm: the largest inner product is then the least distance."""
    return np.concatenate((x, np.sqrt(np.maximum(reach * reach - (x**2).sum(1), 0))[:, None]), axis=1)


def _level(q: np.ndarray, reach: float) -> np.ndarray:
    """Queries beside lifted vectors: the extra component is zero, the norm is `reach`, as a query's own norm orders nothing."""
    return np.concatenate((q * (reach / np.sqrt((q**2).sum(1)))[:, None], np.zeros((len(q), 1))), axis=1)


def _lists(graph: CentroidGraph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of each lifted vector, nearest first, and which of them it has."""
    found, d = graph.search(x, ASSIGN_WIDTH)
    d = np.sqrt(d)
    has = np.zeros(found.shape, bool)
    has[:, 0] = True
    for j in range(1, found.shape[1]):
        apart = np.sqrt(((graph.centroids[found[:, :j]] - graph.centroids[found[:, j]][:, None]) ** 2).sum(2))
        has[:, j] = (d[:, j] <= CLOSURE * d[:, 0] + 1e-12) & (has.sum(1) < REPLICAS) & ~(has[:, :j] & (apart < d[:, j][:, None])).any(1)
    return found, has


def _near_lists(graph: CentroidGraph, q: np.ndarray, sizes: np.ndarray, keep: int, ratio: float) -> list[np.ndarray]:
    """The lists that each query reads: those within the ratio, and more until they hold `keep` items. A search that ends
    within the ratio is done again with four times the width, so no number of lists is the most; one of a quarter of the lists and more
    takes the distances to all."""
    out: list[np.ndarray] = [np.empty(0, int)] * len(q)
    rows, width, n_lists = np.arange(len(q)), 64, len(sizes)
    while len(rows):
        if 4 * width < n_lists:
            found, d = graph.search(q[rows], width)
        else:
            d = _squared(q[rows], graph.centroids)
            found = np.argsort(d, axis=1, kind="stable")
            d = np.take_along_axis(d, found, 1)
        near = np.sqrt(d) <= ratio * np.sqrt(d[:, :1]) + 1e-12
        held = np.cumsum(sizes[found], axis=1)
        near |= held - sizes[found] < keep
        done = ~near[:, -1] | (found.shape[1] == n_lists)
        for i in np.flatnonzero(done):
            out[rows[i]] = found[i][near[i]]
        rows, width = rows[~done], width * 4
    return out


def fitted_ratio(graph: CentroidGraph, x: np.ndarray, reach: float, k: int) -> float:
    """The smallest ratio by which TARGET of the k nearest in the sample x are read, for TRIALS of its vectors as queries.

    Neighbours in a sample are further off than those among all vectors, so the ratio rather reads too much.
    """
    trials = np.random.default_rng(3).permutation(len(x))[:TRIALS]
    q = _level(x[trials], reach)
    d = np.sqrt(_squared(q, graph.centroids))
    k = min(k, len(x) - 1)
    top = np.empty((len(trials), k), int)
    for at in range(0, len(trials) if k else 0, 32):
        scores = -x[trials[at : at + 32]] @ x.T
        scores[np.arange(len(scores)), trials[at : at + 32]] = np.inf
        top[at : at + 32] = np.argpartition(scores, k - 1, axis=1)[:, :k]
    near, top = np.unique(top, return_inverse=True)
    top = top.reshape(len(trials), k)
    parts = [_lists(graph, _lifted(x[near[i : i + 256]], reach)) for i in range(0, len(near), 256)]
    found, has = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty((0, 1), int), np.empty((0, 1), bool))
    need = np.where(has[top], d[np.arange(len(trials))[:, None, None], found[top]], np.inf).min(2) / d.min(1, keepdims=True)
    margin = 3 * np.sqrt(TARGET * (1 - TARGET) / max(1, need.size / 4))  # few trials tell less
    return float(np.quantile(need, min(1.0, TARGET + margin))) if need.size else 1.0


@dataclass
class _Dealt:
    """Lists dealt to places: neighbours share one, a list too long for one is dealt by hash to several of its own."""

    first: list[int]
    parts: list[int]

    def of(self, part: int, rep: int) -> int:
        return self.first[part] + ((rep * 0x9E3779B97F4A7C15) % (1 << 64) >> 33) % self.parts[part]

    def all_of(self, part: int) -> range:
        return range(self.first[part], self.first[part] + self.parts[part])


def _dealt(sizes: np.ndarray, room: int) -> _Dealt:
    first, parts, at, held = [], np.maximum(1, -(-sizes // room)).tolist(), -1, room + 1
    for n, p in zip(sizes.tolist(), parts, strict=True):
        if p > 1 or held + n > room:
            at, held = at + 1, 0
        first.append(at)
        at, held = at + p - 1, held + n if p == 1 else room + 1
    return _Dealt(first, parts)


def _members(lists: pd.Series) -> dict[int, np.ndarray]:
    """The rows that have each list."""
    flat = np.concatenate([np.asarray(x, np.int64) for x in lists])
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(flat, kind="stable")
    names, starts = np.unique(flat[order], return_index=True)
    return dict(zip(names.tolist(), np.split(rows[order], starts[1:]), strict=True))


def scan(posted: pd.DataFrame, ask: pd.DataFrame, keep: int) -> pd.DataFrame:
    """(q, rep, score) of the `keep` best vectors of a shard (rep, v, lists) for each of the queries (rep, v, lists), of those in lists that the query reads.
    It holds the scores of SCAN_BLOCK queries at a time."""
    q_, r_, s_ = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    if len(posted) and len(ask):
        x, reps, of = np.stack(posted["v"].to_numpy()).astype(float), posted["rep"].to_numpy(), ask["rep"].to_numpy()
        held, first = _members(posted["lists"]), np.array([own[0] for own in ask["lists"]])
        order = np.argsort(first, kind="stable")  # queries of one neighbourhood read much the same
        for at in range(0, len(order), SCAN_BLOCK):
            asks = order[at : at + SCAN_BLOCK]
            wanted = _members(ask["lists"].iloc[asks])
            both = [part for part in wanted if part in held]
            if not both:
                continue
            met = np.unique(np.concatenate([held[part] for part in both]))
            unread = np.ones((len(asks), len(met)), bool)
            for part in both:
                unread[wanted[part][:, None], np.searchsorted(met, held[part])] = False
            scores = np.stack(ask["v"].iloc[asks].to_numpy()).astype(float) @ (x if len(met) == len(x) else x[met]).T
            scores[unread] = -np.inf
            m = min(keep, len(met))
            i, j = np.nonzero((scores >= np.partition(scores, len(met) - m, axis=1)[:, len(met) - m, None]) & ~unread)
            near, rep = scores[i, j], reps[met[j]]
            order_ = np.lexsort((rep, -near, i))
            i, rep, near = i[order_], rep[order_], near[order_]
            top = np.arange(len(i)) - np.searchsorted(i, i) < keep
            q_.append(of[asks[i[top]]])
            r_.append(rep[top])
            s_.append(near[top])
    return pd.DataFrame({"q": np.concatenate(q_), "rep": np.concatenate(r_), "score": np.concatenate(s_)})


def build(vectors: DataFrame, k: int, sample: int = SAMPLE) -> PostingIndex:
    """An index for searches of up to k neighbours among vectors, a result of usable().

    Equal vectors are one item. Of its ids the k + 1 smallest are enough for any result, and the window's group limit
    finds them before the shuffle, so a vector held by a third of all rows sends k + 1 rows from each task.
    """
    by = Window.partitionBy("v").orderBy("vec_id")
    first = vectors.distinct().withColumn("at", F.row_number().over(by)).where(F.col("at") <= k + 1)
    items = first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "v", "ids")
    items = stored(items, "ann-items")
    n, reach2 = items.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))).first()
    reach = float(np.sqrt(reach2 or 0.0))
    drawn = items.select("rep", "v").where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.0 * sample / max(n, 1)))).orderBy("rep").limit(sample)
    held = drawn.select("v").toArrow()["v"].combine_chunks()
    x = held.flatten().to_numpy().reshape(len(held), -1) if len(held) else np.zeros((0, 1))
    if not len(x):
        return PostingIndex(items, CentroidGraph.of(np.zeros((0, 1))), reach, n, k + 1, 1.0)
    graph = CentroidGraph.of(balanced_centroids(_lifted(x, reach), int(max(1, min(LISTS * n**0.5, len(x) / MEMBERS)))))
    return PostingIndex(items, graph, reach, n, k + 1, fitted_ratio(graph, x, reach, k))


def search(index: PostingIndex, queries: DataFrame, k: int, ratio: float | None = None, read: list | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row of queries, a result of usable().

    Nearest by inner product of the original vectors in double precision, ties to the smaller vec_id; a query's
    own id is left out. Equal query vectors are searched once. A vector is met by a query only in a list that this
    query reads: neighbouring lists make shards, queries of one neighbourhood blocks, and a shard goes to the blocks
    that read of it. A list longer than a shard is dealt by hash to several. ratio overrides the fitted one; read, if
    given, gets the number of postings read by all queries.
    """
    spark = queries.sparkSession
    if index.n_items == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    graph, reach, keep = index.graph, index.reach, index.keep
    ratio = index.ratio if ratio is None else ratio

    def placed(lists_of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    lists = lists_of(np.array(part.column("v").to_pylist(), float))
                    yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("v"), pa.array([own.tolist() for own in lists], pa.list_(pa.int32()))], names=["rep", "v", "lists"])

        return run

    def assigned(x: np.ndarray) -> list[np.ndarray]:
        found, has = _lists(graph, _lifted(x, reach))
        return [f[h] for f, h in zip(found, has, strict=True)]

    shape = "rep long, v array<double>, lists array<int>"
    posted = stored(index.items.mapInArrow(placed(assigned), shape), "ann-postings")

    def count(df: DataFrame, of) -> np.ndarray:
        out = np.zeros(len(graph.centroids), np.int64)
        for r in df.groupBy(of.alias("list")).count().collect():  # a row for each list
            out[r["list"]] = r["count"]
        return out

    sizes = count(posted.select(F.explode("lists").alias("l")), F.col("l"))
    nearest_sizes = count(posted, F.col("lists")[0])  # an item counts in its nearest list alone, so lists together hold no fewer
    by_vector = queries.select(F.col("vec_id").alias("query_id"), "v")
    asked = stored(by_vector.groupBy("v").agg(F.min("query_id").alias("rep")), "ann-queries")
    sent = stored(asked.select("rep", "v").repartition(shards(spark), "rep").mapInArrow(placed(lambda q: _near_lists(graph, _level(q, reach), nearest_sizes, keep, ratio)), shape), "ann-probes")
    asks = count(sent, F.col("lists")[0])
    if read is not None:
        read.append(sent.select(F.explode("lists").alias("l")).groupBy("l").count().toPandas().pipe(lambda t: int((sizes[t["l"]] * t["count"]).sum())))

    places, blocks = _dealt(sizes, SHARD_VECTORS), _dealt(asks, QUERY_BLOCK)

    def rows_of(batch: pa.RecordBatch, own: list[list], names: list[str]) -> pa.RecordBatch:
        at = np.repeat(np.arange(batch.num_rows), [len(o) for o in own])
        flat = [row for o in own for row in o]
        columns = [pa.array([r[i] for r in flat], pa.int64()) for i in range(len(names))]
        taken = batch.select(["rep", "v"]).take(pa.array(at, pa.int64()))
        lists = pa.array([r[-1] for r in flat], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*columns, taken.column("rep"), taken.column("v"), lists], names=[*names, "rep", "v", "lists"])

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for rep, lists in zip(batch.column("rep").to_pylist(), batch.column("lists").to_pylist(), strict=True):
                by: dict[int, list[int]] = {}
                for part in lists:
                    by.setdefault(places.of(part, rep), []).append(part)
                own.append([(shard, held) for shard, held in by.items()])
            yield rows_of(batch, own, ["shard"])

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for rep, lists in zip(batch.column("rep").to_pylist(), batch.column("lists").to_pylist(), strict=True):
                by = {}
                for part in lists:
                    for shard in places.all_of(part):
                        by.setdefault(shard, []).append(part)
                block = blocks.of(lists[0], rep)
                own.append([(shard, block, held) for shard, held in by.items()])
            yield rows_of(batch, own, ["shard", "block"])

    right = stored(sent.mapInArrow(to_blocks, "shard long, block long, " + shape), "ann-asks")
    left = posted.mapInArrow(to_shards, "shard long, " + shape).join(right.select("shard", F.col("block").alias("to")).distinct(), "shard")

    found = left.groupBy("shard", "to").cogroup(right.groupBy("shard", "block")).applyInPandas(lambda posted, ask: scan(posted, ask, keep), "q long, rep long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    once = found.groupBy("q", "rep").agg(F.max("score").alias("score"))
    top = once.withColumn("at", F.row_number().over(best)).where(F.col("at") <= keep).join(index.items.select("rep", "ids"), "rep")
    ids = top.select("q", "score", F.explode("ids").alias("vec_id"))
    each = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    listed = ids.withColumn("at", F.row_number().over(each)).where(F.col("at") <= keep)
    answers = listed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("near"))
    of_query = by_vector.join(asked, "v").select("query_id", F.col("rep").alias("q")).join(answers, "q")
    own_out = F.slice(F.filter("near", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    return of_query.select("query_id", F.posexplode(own_out).alias("p", "e")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score")
    )


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """search() of the rows whose vec_id is divisible by `every` against all others of the same length.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows of null vec_id; rows that repeat both
    id and vector count once. There is no inner product of vectors of different lengths, so each length has an index and a search of
    its own. No usable rows, no result.
    """
    rows = usable(vectors).distinct()
    lengths = [r["d"] for r in rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").collect()] or [0]
    found = []
    for d in lengths:
        own = rows.where(F.size("v") == d)
        found.append(search(build(own, k), own.where(F.col("vec_id") % every == 0), k))
    return reduce(DataFrame.unionByName, found)
