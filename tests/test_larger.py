"""Cases that only larger tables hold."""

from __future__ import annotations

import time
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.functions.text import pieces
from millrace.operators import payloads
from millrace.sources import dumps


def folder_of(spark, tmp_path, **tables) -> str:
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_pages_of_one_address_are_read_apart(spark, tmp_path):
    pages = spark.createDataFrame([(20, "http://h/a"), (21, "http://h/a/"), (40, "http://h/a"), (41, "http://h/b")], "page_id long, url string")
    found = entry.queries()["read_by_url"](spark, folder_of(spark, tmp_path, pages=pages))
    assert sorted(map(tuple, found.collect())) == [(p, "http://h/a", "http://h/a/", i) for p in (20, 40) for i in range(4) if (p + i) % 7]


def test_a_shard_of_many_lists_is_searched_in_bounded_memory():
    ann = pytest.importorskip("millrace.llm.ann")
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((4000, 8)), rng.standard_normal((1500, 8))
    lists = rng.integers(0, 160, (4000, 2))
    posted = pd.DataFrame({"rep": np.arange(4000) * 3, "v": list(x), "lists": list(lists)})
    wanted = [rng.permutation(160)[:120] for _ in q]
    ask = pd.DataFrame({"rep": np.arange(1500) * 7, "v": list(q), "lists": wanted})
    tracemalloc.start()
    found = ann.scan(posted, ask, 21)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1500 * 21 and peak < 60e6  # each list's best of each query, as before, take more than 200 MB
    for i in (0, 700, 1499):
        read = np.flatnonzero(np.isin(lists, wanted[i]).any(1))
        best = read[np.argsort(-(x[read] @ q[i]), kind="stable")][:21]
        assert found[found.q == i * 7].rep.tolist() == (best * 3).tolist()


def test_payloads_of_one_file_are_walked_by_all_tasks(spark):
    rows = spark.range(200, numPartitions=1).selectExpr("id", """parse_json('{"a":"Bearer x","b":[{"c":1}]}') AS payload""")
    levels = payloads.walk(rows, "id", "payload", found=F.col("text").contains("Bearer"))
    assert [level.count() for level in levels] == [200, 400, 200, 200]
    assert levels[0].select(F.spark_partition_id()).distinct().count() > 1
    assert levels[1].where("found").count() == 200  # judged once, when its level is written


def test_batches_are_worked_on_in_parts_of_bounded_bytes():
    batch = pa.RecordBatch.from_pydict({"id": list(range(7)), "a": ["x" * 40, None, "y" * 300, "", "é" * 20, "z" * 40, "w"], "b": [None, "x" * 50, "y", "", None, "z", ""]})
    parts = list(pieces(batch, ["a", "b"], 100))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict() and len(parts) > 2
    for sizes in ([sum(len((r[c] or "").encode()) for c in "ab") for r in p.to_pylist()] for p in parts):
        assert sum(sizes) < 100 + max(sizes)  # the limit, but for the row that crosses it
    assert list(pieces(batch.slice(0, 0), ["a"])) == []


def test_dumps_of_one_file_are_read_by_all_tasks(spark):
    said = '[{"title":"t","comments":[{"body":"c"}]},{}]'
    rows = spark.createDataFrame([(i, (said, "[]", "{", '[{"comments":[{}]}]')[i % 4]) for i in range(80)], "id long, text string").coalesce(1)
    found = dumps.reddit_posts(rows, "id").withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in found}) > 1
    want = [(i, at, None) for i in range(0, 80, 4) for at in (0, 1)] + [(i, None, "adapter.reddit.dump_invalid") for i in range(80) if i % 4 > 1]
    assert sorted(((r.id, r.at, r.fault) for r in found), key=str) == sorted(want, key=str)
    assert all((r.url is None) == (r.fault is not None) == (r.content is None) for r in found)


def test_what_all_sets_unlike_a_pivot_lack_is_not_compared(spark, monkeypatch):
    join = pytest.importorskip("millrace.llm.jaccard_join")
    shared = lambda i: list(range(1000 * (i // 2), 1000 * (i // 2) + 95))
    rows = [(0, i, False, 100, list(range(-100, 0)), [*shared(i), *range(100_000 * i, 100_000 * i + 5)]) for i in range(2, 12)]
    deltas = spark.createDataFrame(rows, "p long, doc long, linked boolean, n long, lacks array<long>, extras array<long>")
    compared, real = [], join.stored

    def stored(df, name):
        out = real(df, name)
        lists = [c for c, kind in out.dtypes if kind == "array<bigint>"]
        if name == "far-sets":
            compared.append(out.select(sum((F.size(c) for c in lists), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0] or 0)
        return out

    monkeypatch.setattr(join, "stored", stored)
    found = spark.createDataFrame([], "node long, component long")
    pairs = {(r.a, r.b) for r in join._far_pairs(deltas, found, join.Measure(5, 80, 100)).collect()}
    assert pairs == {(i, i + 1) for i in range(2, 12, 2)}
    assert max(compared) <= 10 * 100  # extras; with what the sets lack, as before, 10 * 200


def test_tokens_of_one_component_alone_are_not_compared(spark, monkeypatch):
    join = pytest.importorskip("millrace.llm.jaccard_join")
    shared = lambda i: list(range(1000 * (i // 2), 1000 * (i // 2) + 95))
    rows = [(0, i, False, 100, list(range(-100, 0)), [*shared(i), *range(100_000 * i, 100_000 * i + 5)]) for i in range(2, 12)]
    rows += [(0, 12, False, 100, list(range(-100, 0)), rows[-1][5])]  # links with 10 and 11, which are of one component
    deltas = spark.createDataFrame(rows, "p long, doc long, linked boolean, n long, lacks array<long>, extras array<long>")
    compared, real = [], join.stored

    def stored(df, name):
        out = real(df, name)
        if name == "far-sets":
            compared.extend(r.doc for r in out.select("doc").collect())
        return out

    monkeypatch.setattr(join, "stored", stored)
    found = spark.createDataFrame([(i, i - i % 2) for i in range(2, 12)], "node long, component long")
    assert {(r.a, r.b) for r in join._far_pairs(deltas, found, join.Measure(5, 80, 100)).collect()} == {(10, 12), (11, 12)}
    assert set(compared) == {10, 11, 12}  # before, every set, as the two of a component share their tokens


def test_ends_of_declarations_are_found_in_one_pass():
    from millrace.operators import documents

    n, code = 40_000, 30_000
    lines = pa.array([i % 7 for i in range(n)]), pa.array([False] * n), pa.array([int(i < code) for i in range(n)]), pa.array([int(i >= code) for i in range(n)])
    asked = pa.array(range(code)), pa.array([False] * code), pa.array(["python" if i % 2 else "rust" for i in range(code)]), pa.array([str(i) for i in range(code)])
    took = time.monotonic()
    ends, of, parents = documents._extents(*lines, *asked)
    assert time.monotonic() - took < 20  # a walk of 4,000 lines for each, as before, is 120,000,000 steps
    assert ends[:9] == [-1, 6, -1, 6, -1, 6, -1, 13, -1] and ends[29_998] == 30_001 and ends[28_000] == 31_999 and ends[27_998] == -1
    assert set(of) == {n} and parents[:9] == [None, "0", "1", "2", "3", "4", "5", None, "7"]
