import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieval as R
from millrace.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, source, key", [("retrieval_dense_topk", "embeddings", "vec_id"), ("retrieval_sparse_topk", "documents", "doc_id"), ("retrieval_hybrid_rrf", "embeddings", "vec_id")])
def test_every_twentieth_row_asks(spark, name, source, key):
    ids = {r[0] for r in spark.read.parquet(f"{DATA}/{source}.parquet").where(f"{key} % 20 = 0").select(key).collect()}
    got = {r[0] for r in registry.queries()[name](spark, DATA).select("query_id").distinct().collect()}
    assert len(ids) > 5 and got == ids


def test_dense_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "POINT_SHARD", 3)
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    v = [[1.0, 2.0], [0.1, 0.3], [1.0, 2.0], None, [1.0, None], [1.0], [math.nan, 1.0], [-3.0, 0.5], [1.0, 2.0]]
    points = spark.createDataFrame(list(enumerate(v)), "id long, v array<double>")
    queries = points.where("id in (0, 1, 3, 7, 8)").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    w = R.Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    plain = points.crossJoin(queries).select("query_id", "id", R.dot("v", "q").alias("score")).withColumn("rank", F.row_number().over(w))
    for k in (1, 4, 9):
        rows = lambda df: sorted(map(str, df.select("query_id", "id", "score", "rank").collect()))
        assert rows(R.dense_topk(points, queries, k)) == rows(plain.where(f"rank <= {k}"))


def test_sparse_blocks(spark, monkeypatch):
    import random

    draw = random.Random(5)
    rows = [(i, b, float(draw.randint(1, 9))) for i in range(60) for b in draw.sample(range(40), draw.randint(1, 6))]
    weights = spark.createDataFrame(rows, "id long, bucket int, weight double")
    query = weights.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    w = R.Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    joined = weights.join(query.withColumnRenamed("weight", "x"), "bucket").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("x")).alias("score"))
    want = sorted(map(str, joined.withColumn("rank", F.row_number().over(w)).where("rank <= 7").select("query_id", "id", "score", "rank").collect()))
    for common, cells in ((1024, 4_000_000), (5, 20), (0, 7)):
        for name, value in (("POINT_SHARD", 4), ("QUERY_BLOCK", 6), ("COMMON", common), ("CELLS", cells)):
            monkeypatch.setattr(R, name, value)
        assert sorted(map(str, R.sparse_topk(R.listed(weights, "id"), R.listed(query, "query_id"), 7).select("query_id", "id", "score", "rank").collect())) == want


def _brute(rows, asked, k):
    """(query_id, id, score, rank) of the k best by sums of products, from rows (id, {bucket: weight})."""
    out = []
    for q, x in asked:
        scored = [(i, round(sum(w * y[b] for b, w in x.items() if b in y), 6)) for i, y in rows if x.keys() & y.keys()]
        out += [(q, i, s, rank + 1) for rank, (i, s) in enumerate(sorted(scored, key=lambda h: (-h[1], h[0]))[:k])]
    return out


@pytest.mark.parametrize("k, units, common, groups, exact", [(2, 900, 3, 2, 1), (3, 400, 0, 1, 8), (1, 10**6, 8, 4, 100)])
def test_sparse_by_norm(spark, monkeypatch, k, units, common, groups, exact):
    """Points of very different norms, with copies: shards by norm, a head, least scores and bounds lose and add nothing."""
    import random

    draw = random.Random(9)
    rows = [(i, {b: float(draw.randint(1, 4)) * draw.choice([0.3, 1.0, 5.0]) for b in draw.sample(range(40), draw.randint(1, 1 + i % 17))}) for i in range(150)]
    rows += [(i + 150, rows[i * 7][1]) for i in range(20)] + [(900, {}), (901, {77: 2.0})]
    for name, value in (("SHARD_UNITS", units), ("LEAST_SHARDS", 5), ("SPARSE_BLOCK", 6), ("TASKS", 3), ("COMMON", common), ("GROUPS", groups), ("EXACT_COST", exact)):
        monkeypatch.setattr(R, name, value)
    points = spark.createDataFrame([(i, list(x), list(x.values())) for i, x in rows], "id long, buckets array<int>, weights array<double>")
    queries = points.where("id % 5 = 0 or id = 901").withColumnRenamed("id", "query_id")
    want = _brute(rows, [r for r in rows if r[0] % 5 == 0 or r[0] == 901], k)
    got = [tuple(r) for r in R.sparse_topk(points, queries, k).select("query_id", "id", "score", "rank").collect()]
    assert sorted(got) == sorted(want)
    assert R.sparse_topk(points.where("id = 900"), queries, k).count() == 0


def test_sparse_sends_only_what_reaches_the_least_score():
    """A shard sent its k best of every query before, however small."""
    import pyarrow as pa

    p = pa.table({"id": [4, 3, 2, 1], "buckets": [[1], [1, 2], [2], [1, 2]], "weights": [[1.0], [2.0, 2.0], [9.0], [2.0, 2.0]]})
    q = pa.table({"buckets": [[1, 2]] * 3, "weights": [[1.0, 1.0]] * 3, "least": [None, 4.0, 9.5]})
    for common in (0, 1, 2):
        found = {row: list(zip(rows.tolist(), scores.tolist(), strict=True)) for row, rows, scores in R._best_sparse(p, q, 3, 6, common, 160, 8, 2, 1)}
        assert found == {0: [(2, 9.0), (3, 4.0), (1, 4.0)], 1: [(2, 9.0), (3, 4.0), (1, 4.0)]}


def test_leading_equals_running_sums(spark, monkeypatch):
    import random

    monkeypatch.setattr(R, "SPAN", 7)
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 0, 1, 5, 30])) for i in rng.sample(range(300), 200)] + [("big", 5, 99), ("big", 6, 1)]
    want = []
    for group in {r[0] for r in rows}:
        total = 0
        for rank, (_, _, n) in enumerate(sorted((r for r in rows if r[0] == group), key=lambda r: r[1])):
            total += (n or 0) + (2 if rank else 0)
            if total > 90 or -(-total // 4) > 20:
                break
            want.append((group, rank + 1, total, -(-total // 4)))
    hits = spark.createDataFrame(rows, "query_id string, doc_id long, bytes int").repartition(3)
    got = [tuple(r) for r in R.leading(hits, "doc_id", 90, 20).select("query_id", "rank", "bytes_so_far", "tokens_so_far").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_numbered(spark):
    rows = spark.range(0, 200, 1, 5).select((F.col("id") * 37 % 50).alias("a"), "id")
    got = {r["id"]: r["place"] for r in R.numbered(rows, ["a", F.desc("id")], "place").collect()}
    order = sorted(got, key=lambda i: (i * 37 % 50, -i))
    assert [got[i] for i in order] == list(range(1, 201))
    assert R.numbered(rows.limit(0), ["a"], "place").count() == 0
