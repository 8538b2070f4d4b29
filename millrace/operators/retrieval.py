"""Filtered dense, sparse and hybrid retrieval, facets and bounded contexts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from millrace.sources.tables import written

#: Points and queries of one task of a search, on average; cells of a matrix that it holds at a time.
POINT_SHARD, LEAST_SHARDS, QUERY_BLOCK, CELLS = 20_000, 12, 5_000, 4_000_000
#: So many of a shard's most frequent buckets are multiplied as a matrix, the others by their lists; an entry of a list costs so many products of a matrix.
COMMON, LIST_COST = 256, 160
#: What one shard of a sparse search holds at most: a bucket of a point is one unit, a point as many more. Queries of one task; tasks at least.
SHARD_UNITS, POINT_UNITS, SPARSE_BLOCK, TASKS = 4_000_000, 100, 40_000, 24
#: The other buckets are in so many groups, whose norms bound what the lists can add; an entry summed again costs so many entries of a list.
GROUPS, EXACT_COST = 32, 8
#: More than sums in single precision can err by, as a share of them.
SLACK = 1e-4


def matches(column: Column, value: object) -> Column:
    """Equality, or membership for a list: an empty list matches nothing. Null matches nothing."""
    if isinstance(value, (list, tuple, set)):
        return F.coalesce(column.isin(list(value)), F.lit(False)) if value else F.lit(False)
    if isinstance(value, (float, dict)):
        raise ValueError(f"filters take text, whole numbers, booleans or lists of them, not {type(value).__name__}")
    return F.coalesce(column == value, F.lit(False))


def matching(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows that match every field of wanted."""
    for name in {"must", "should", "must_not", "filter"} & set(wanted):
        raise ValueError(f"boolean operator {name} is not supported")
    for name, value in wanted.items():
        df = df.where(matches(F.col(name), value))
    return df


def in_range(column: Column, low=None, high=None, low_open: bool = False, high_open: bool = False) -> Column:
    """Bounds on a time; a value that cannot be read as one is outside."""
    at, out = F.try_to_timestamp(column.cast("string")), F.lit(True)
    if low is not None:
        out &= at > F.lit(low).cast("timestamp") if low_open else at >= F.lit(low).cast("timestamp")
    if high is not None:
        out &= at < F.lit(high).cast("timestamp") if high_open else at <= F.lit(high).cast("timestamp")
    return F.coalesce(out, F.lit(False))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two vectors of the same length, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def _topk(points: DataFrame, queries: DataFrame, k: int, best: Callable, sizes: tuple[int, int]) -> DataFrame:
    """(query_id, id, score, rank): every block of queries meets every shard of points in a task, which sends on k rows a query.

    best(points, queries, place) gives (row of queries, rows of points, scores) of each query's k best; place is the order of ids.
    """
    shards, blocks = max(LEAST_SHARDS, -(-sizes[0] // POINT_SHARD)), -(-sizes[1] // QUERY_BLOCK) or 1
    left = points.withColumn("shard", F.pmod(F.xxhash64(*points.columns), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    shape = S.StructType([S.StructField("query_id", queries.schema["query_id"].dataType), S.StructField("id", points.schema["id"].dataType), S.StructField("score", S.DoubleType())])

    def scan(p: pa.Table, q: pa.Table) -> pa.Table:
        place = np.empty(p.num_rows, np.int64)
        place[pc.array_sort_indices(p["id"].combine_chunks(), null_placement="at_start").to_numpy()] = np.arange(p.num_rows)
        found = list(best(p, q, place)) if p.num_rows and q.num_rows else []
        asked = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
        rows = np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])
        scores = pa.array([x for f in found for x in f[2]], pa.float64())
        return pa.table([q["query_id"].take(pa.array(asked)), p["id"].take(pa.array(rows)), scores], names=["query_id", "id", "score"])

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(scan, shape)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lengths (-1 for null), first positions and values of a column of lists."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy().astype(np.int64)
    held = np.maximum(lengths, 0)
    return lengths, np.cumsum(held) - held, pc.list_flatten(column).combine_chunks()


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length; a vector that is null or holds a null is in none."""
    lengths, starts, values = _flat(column)
    null = values.is_null().to_numpy(zero_copy_only=False)
    numbers, out = pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False), {}
    for n in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == n)
        at = starts[rows][:, None] + np.arange(n)
        whole = ~null[at].any(1)
        out[int(n)] = rows[whole], numbers[at[whole]]
    return out


def dense_topk(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the k points (id, v) of the greatest inner product with each of queries (query_id, q).

    Scores are sums in order of the components, as in dot(), so equal vectors tie. Null scores come last.
    """

    def best(p: pa.Table, q: pa.Table, place: np.ndarray) -> Iterator[tuple]:
        points, left = _by_length(p["v"]), set(range(q.num_rows))
        asked = _by_length(q["q"])
        for n, (rows, y) in asked.items():
            own, x = points.get(n, (np.zeros(0, np.int64), np.zeros((0, n))))
            rest = np.setdiff1d(np.arange(len(place)), own, assume_unique=True)
            rest = rest[np.argsort(place[rest])][:k]
            left -= set(rows.tolist())
            step, longest = max(1, CELLS // max(len(own), 1)), np.sqrt((x**2).sum(1)).max(initial=0.0)
            for at in range(0, len(rows), step):
                part = y[at : at + step]
                near = part @ x.T
                near[np.isnan(near)] = np.inf
                for row, v, s in zip(rows[at : at + step], part, near, strict=True):
                    hits, exact = np.zeros(0, np.int64), np.zeros(0)
                    if m := min(k, len(s)):
                        slack = 1e-14 * n * longest * np.sqrt(v @ v)
                        least = np.partition(s, len(s) - m)[len(s) - m]
                        hits = np.flatnonzero(s >= (least - slack if np.isfinite(least) and np.isfinite(slack) else least if np.isfinite(slack) else -np.inf))
                        exact = np.cumsum(x[hits] * v, axis=1)[:, -1] if n else np.zeros(len(hits))
                        order = np.lexsort((place[own[hits]], -exact, ~np.isnan(exact)))[:k]
                        hits, exact = own[hits[order]], exact[order]
                    more = rest[: k - len(hits)]
                    yield row, np.concatenate((hits, more)), [*exact.tolist(), *[None] * len(more)]
        every = np.argsort(place)[:k]
        for row in sorted(left):
            yield row, every, [None] * len(every)

    return _topk(points.select("id", "v"), queries.select("query_id", "q"), k, best, (points.count(), queries.count()))


def listed(weights: DataFrame, key: str) -> DataFrame:
    """(key, buckets, weights) of rows (key, bucket, weight)."""
    return weights.groupBy(key).agg(F.collect_list(F.struct("bucket", "weight")).alias("e")).select(key, F.col("e.bucket").alias("buckets"), F.col("e.weight").alias("weights"))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions of ranges, one range after the other."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def _normed(rows: DataFrame, key: str) -> DataFrame:
    """(key, buckets, weights, norm) of rows that have buckets."""
    rows = rows.where(F.size("buckets") > 0).select(key, "buckets", "weights")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lengths, starts, w = _flat(pa.chunked_array([batch.column("weights")]))
                norm = np.sqrt(np.add.reduceat(w.to_numpy() ** 2, starts))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm)], names=[*batch.schema.names, "norm"])

    return rows.mapInArrow(run, S.StructType([*rows.schema.fields, S.StructField("norm", S.DoubleType())]))


def _shards(points: DataFrame, k: int) -> tuple[list[tuple[int, int, int]], list[float], int]:
    """How points (id, buckets, weights, norm) are dealt, the greatest norms first: (band, first shard, shards) of every band of norms, the greatest
    norm of every shard, and how many shards hold the head, whose hits tell each query what may still count."""
    per_band = points.groupBy(_band("norm").alias("band")).agg(F.count("*"), F.sum(F.size("buckets") + POINT_UNITS), F.max("norm")).collect()
    per_band.sort(key=lambda r: -r[0])
    count, total = sum(r[1] for r in per_band), sum(r[2] for r in per_band)
    each, least_head = max(1, min(SHARD_UNITS, total // LEAST_SHARDS)), max(20 * k, count // 256)
    dealt, tops, room, before, head = [], [], 0, 0, None
    for band, n, units, top in per_band:
        if head is None and before >= least_head:
            head, room = len(tops), 0
        if units > room:
            parts = -(-units // each)
            dealt.append((band, len(tops), parts))
            tops += [top] * parts
            room = each - units if parts == 1 else 0
        else:
            dealt.append((band, len(tops) - 1, 1))
            room -= units
        before += n
    return dealt, tops, len(tops) if head is None else head


def _band(norm: str) -> Column:
    return F.floor(F.log2(norm) * 16).cast("int")


def _best_sparse(p: pa.Table, q: pa.Table, k: int, digits: int, common: int, lists: int, cells: int, groups: int, exact_cost: int) -> Iterator[tuple]:
    """(row of q, rows of p, scores) of the k best points (id, buckets, weights) of each query (buckets, weights, least) that reach its least score.

    Sums are taken in single precision first: the `common` most frequent buckets as a matrix, the others by their lists. What can be among the best by
    these is summed again in double precision and rounded. Where there is a least score, the sums of the matrix and the products of the norms of `groups`
    groups of the other buckets tell whether the lists are needed at all."""
    half = 10.0**-digits
    n, (lengths, ends, b), w = p.num_rows, _flat(p["buckets"]), _flat(p["weights"])[2].to_numpy()
    place = np.empty(n, np.int64)
    place[pc.array_sort_indices(p["id"].combine_chunks(), null_placement="at_start").to_numpy()] = np.arange(n)
    known, code, count = np.unique(b.to_numpy(), return_inverse=True, return_counts=True)
    by_count = np.empty(len(known), np.int32)
    by_count[np.argsort(-count, kind="stable")] = np.arange(len(known))
    code, count, width = by_count[code], np.sort(count)[::-1], min(common, len(known))
    row, frequent = np.repeat(np.arange(n, dtype=np.int32), lengths), code < width
    matrix = np.zeros((n, width), np.float32)
    matrix[row[frequent], code[frequent]] = w[frequent]
    bounds = np.sqrt(np.bincount((row * groups + code % groups)[~frequent], w[~frequent] ** 2, n * groups)).astype(np.float32).reshape(n, groups)
    order = np.argsort(code.astype(np.uint16) if len(known) <= 1 << 16 else code, kind="stable")
    entries = np.stack((row[order], w[order].astype(np.float32).view(np.int32)), axis=1).view(np.int64).ravel()
    starts = np.concatenate(([0], np.cumsum(count)))
    del row, frequent, order
    step, dense = max(1, cells // n), np.zeros(len(known))
    for at in range(0, q.num_rows, step):
        part = q.slice(at, step)
        size, least = part.num_rows, part["least"].to_numpy()
        q_lengths, _, q_b = _flat(part["buckets"])
        r, x, c = np.repeat(np.arange(size), q_lengths), _flat(part["weights"])[2].to_numpy(), np.searchsorted(known, q_b.to_numpy())
        met = known[np.minimum(c, len(known) - 1)] == q_b.to_numpy()
        r, x, c = r[met], x[met], by_count[c[met]]
        wanted = np.zeros((size, width), np.float32)
        wanted[r[c < width], c[c < width]] = x[c < width]
        by_matrix = (wanted > 0) @ count[:width] * lists > n * width
        others = c >= width
        most = np.sqrt(np.bincount((r * groups + c % groups)[others], x[others] ** 2, size * groups)).astype(np.float32).reshape(size, groups)
        products, above = iter(wanted[by_matrix] @ matrix.T), iter(most[by_matrix] @ bounds.T)
        cut = np.searchsorted(r, np.arange(size + 1))
        for i in range(size):
            own, factors = c[cut[i] : cut[i + 1]], x[cut[i] : cut[i + 1]]
            rest = own >= width if by_matrix[i] else slice(None)
            from_, to = starts[own[rest]], starts[own[rest] + 1]
            floor, scores, hits = (least[i] - half) * (1 - SLACK) if least[i] > half else 0.0, np.zeros(n), None
            if by_matrix[i]:
                scores, bound = next(products), next(above)
                if floor:
                    hits = np.flatnonzero(scores + bound >= floor)
            if hits is None or lengths[hits].sum() > max((to - from_).sum(), n) // exact_cost:
                if len(from_):
                    of = np.concatenate([entries[s:e] for s, e in zip(from_.tolist(), to.tolist(), strict=True)])
                    scores = scores + np.bincount(of.view(np.int32)[::2], of.view(np.float32)[1::2] * np.repeat(factors[rest], to - from_), n)
                hits = np.flatnonzero(scores >= floor if floor else scores > 0)
                if len(hits) > k:
                    near = scores[hits]
                    hits = hits[near >= np.partition(near, len(near) - k)[len(near) - k] * (1 - SLACK) - half]
            if len(hits):
                dense[own] = factors
                sums = np.concatenate(([0], np.cumsum(lengths[hits])[:-1]))
                of = _ranges(ends[hits], lengths[hits])
                exact = np.round(np.add.reduceat(dense[code[of]] * w[of], sums), digits)
                dense[own] = 0
                kept = np.flatnonzero(~(exact < least[i]))
                hits, exact = hits[kept], exact[kept]
                ranked = np.lexsort((place[hits], -exact))[:k]
                if len(ranked):
                    yield at + i, hits[ranked], exact[ranked]


def sparse_topk(points: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): sums of products of the weights of points (id, buckets, weights) and queries (query_id, buckets, weights).

    Weights are from 1e-15 to 1e15; each id has a bucket once. The sums are taken in any order, so they are rounded before they
    are ranked.

    Points are dealt by norm. The head, the few of the greatest norms, meets all queries first; a query's k-th best there is its least score, and
    it goes on only to shards that can reach it, as a score is at most the product of the norms.
    """
    points, queries = written(_normed(points, "id")), written(_normed(queries, "query_id"))
    (dealt, tops, head), asked, half = _shards(points, k), queries.count(), 10.0**-digits
    spark, costs = points.sparkSession, (COMMON, LIST_COST, CELLS, GROUPS, EXACT_COST)
    shape = S.StructType([S.StructField("query_id", queries.schema["query_id"].dataType), S.StructField("id", points.schema["id"].dataType), S.StructField("score", S.DoubleType())])

    def scan(p: pa.Table, q: pa.Table) -> pa.Table:
        found = list(_best_sparse(p, q, k, digits, *costs)) if p.num_rows and q.num_rows else []
        rows_of = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
        rows = np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])
        scores = np.concatenate([f[2] for f in found] or [np.zeros(0)])
        return pa.table([q["query_id"].take(pa.array(rows_of)), p["id"].take(pa.array(rows)), pa.array(scores)], names=["query_id", "id", "score"])

    def meet(first: int, end: int, queries: DataFrame) -> DataFrame:
        """What the shards from first to end hold of queries (query_id, buckets, weights, norm, least)."""
        blocks = max(-(-asked // SPARSE_BLOCK), -(-TASKS // (end - first)))
        held = [F.struct(*[F.lit(x).cast("int").alias(name) for x, name in zip(d, ("band", "first", "parts"), strict=True)]) for d in dealt if first <= d[1] < end]
        bands = spark.range(1).select(F.inline(F.array(*held)))
        left = points.withColumn("band", _band("norm")).join(F.broadcast(bands), "band").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("id", "buckets", "weights", "shard", "block")
        reached = F.size(F.filter(F.array(*[F.lit(t) for t in tops[first:end]]), lambda t: F.col("least").isNull() | (t * F.col("norm") * (1 + SLACK) >= F.col("least") - half)))
        right = queries.withColumn("reached", reached).where("reached > 0").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        right = right.withColumn("shard", F.explode(F.sequence(F.lit(first), F.col("reached") + (first - 1)))).select("query_id", "buckets", "weights", "least", "shard", "block")
        parts = min(2000, 3 * blocks * (end - first))
        pair = [df.repartition(parts, "shard", "block").groupBy("shard", "block") for df in (left, right)]
        return pair[0].cogroup(pair[1]).applyInArrow(scan, shape)

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best_of = lambda df: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if not tops:
        return spark.createDataFrame([], S.StructType([*shape.fields, S.StructField("rank", S.IntegerType())]))
    found = meet(0, head, queries.withColumn("least", F.lit(None).cast("double")))
    if head == len(tops):
        return best_of(found)
    found = written(best_of(found).select("query_id", "id", "score"))
    least = found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    return best_of(found.union(meet(head, len(tops), queries.join(least, "query_id", "left"))))


def fuse(first: DataFrame, second: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, id, rank): (query_id, id, score, rank)."""
    both = first.select("query_id", "id", "rank").union(second.select("query_id", "id", "rank"))
    scored = both.groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def context(hits: DataFrame, most_bytes: int, most_tokens: int, gap: int = 2) -> DataFrame:
    """The longest prefix of hits (query_id, rank, bytes), ranked from 1, that fits both budgets; a token is four bytes of the whole, rounded up.
    Null counts as no bytes.

    Every hit after the first costs the gap at least, so hits of a rank that cannot fit go before the running sums."""
    if gap > 0:
        hits = hits.where(F.col("rank") <= most_bytes // gap + 1)
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    size = F.sum(F.coalesce("bytes", F.lit(0))).over(w) + gap * (F.col("rank") - 1)
    return hits.withColumn("bytes_so_far", size).withColumn("tokens_so_far", F.ceil(F.col("bytes_so_far") / 4)).where((F.col("bytes_so_far") <= most_bytes) & (F.col("tokens_so_far") <= most_tokens))


#: Ids of one span, of which leading() takes the sums first.
SPAN = 1000


def leading(hits: DataFrame, order: str, most_bytes: int, most_tokens: int, gap: int = 2) -> DataFrame:
    """context() of hits (query_id, order, bytes) that come in the order of a whole number, one row each, with rank.

    Sums of spans of SPAN numbers, taken where the rows are, tell which spans can be reached within the budget; the rows of the others
    never move. A query's reachable rows are at most one span more than the budget holds gaps."""
    span = F.floor(F.col(order) / SPAN).alias("span")
    cost = F.sum(F.coalesce("bytes", F.lit(0)) + gap)
    sums = hits.groupBy("query_id", span).agg(cost.alias("cost"))
    before = Window.partitionBy("query_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    reached = sums.withColumn("before", F.coalesce(F.sum("cost").over(before), F.lit(0))).where(F.col("before") <= most_bytes + gap).select("query_id", "span")
    near = reached.select(F.col("query_id").alias("q"), F.col("span").alias("s"))
    kept = hits.join(near, F.col("query_id").eqNullSafe(F.col("q")) & (F.floor(F.col(order) / SPAN) == F.col("s")), "left_semi")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order)))
    return context(ranked, most_bytes, most_tokens, gap)


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """df with the place of each row in the order of all, from 1. Rows are dealt by ranges and written; a task numbers its own, and the sizes of the
    ranges before it, one number a range, are added."""
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    sizes, total = {}, 0
    for r in sorted(dealt.groupBy("_range").count().collect()):
        sizes[r["_range"]], total = total, total + r["count"]
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    if not sizes:
        return dealt.withColumn(name, within).drop("_range")
    known = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    return dealt.withColumn(name, (F.element_at(known, F.col("_range")) + within).cast("long")).drop("_range")


def facet(df: DataFrame, key: Column, limit: int | None = None) -> DataFrame:
    """(value, n): null counts as `unknown`, empty values are left out; with a limit the most frequent, ties by value."""
    counted = df.select(F.coalesce(key.cast("string"), F.lit("unknown")).alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "value").limit(limit) if limit else counted


def keep_best(candidates: DataFrame, key: Sequence[str], score: str, tie: str) -> DataFrame:
    """One row of each key: the highest score, ties to the smallest `tie`. Found by aggregation, so a hot key costs a row a task."""
    rest = [c for c in candidates.columns if c not in key]
    best = candidates.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(tie))).alias("best"))
    return best.select(*key, "best.*").select(*candidates.columns)


def page_after(df: DataFrame, key: str, cursor: object, limit: int = 50) -> DataFrame:
    """The next rows in order of a unique key, strictly after the cursor."""
    if not 1 <= limit <= 500:
        raise ValueError("limit is from 1 to 500")
    return (df if cursor is None else df.where(F.col(key) > F.lit(cursor))).orderBy(key).limit(limit)
