"""Keyed state over micro-batches: streams agree with the tables, go on after a restart, and number late events last."""

from pyspark.sql import functions as F

from millrace.operators import ledger as L
from millrace.streaming import events as S

EVENTS = "job string, id long, key string, at long"
FILES = [
    [("a", 1, "x", 1), ("a", 2, None, 2), ("b", 3, "x", 3), ("a", 4, "x", 4)],
    [("a", 5, "y", 5), ("a", 6, None, 6), ("b", 7, "x", 7), ("b", 8, "z", 8), ("a", 9, "x", 9)],
    [("a", 10, "y", 10), ("b", 11, None, 11), ("c", 12, None, 12)],
]


def run(spark, frame, folder, name):
    query = frame.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-cp").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.parquet(f"{folder}/{name}")


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_sequences_on_streams(spark, tmp_path):
    read = lambda: S.appended_stream(S.read_events(spark, f"{tmp_path}/in", EVENTS), "job", "key", ["at", "id"])
    for rows in FILES[:2]:
        put(spark, rows, EVENTS, tmp_path)
    run(spark, read(), tmp_path, "out")
    put(spark, FILES[2], EVENTS, tmp_path)
    got = {tuple(r) for r in run(spark, read(), tmp_path, "out").select("id", "sequence").collect()}  # a new query goes on from the checkpoint
    table = spark.createDataFrame([r for rows in FILES for r in rows], EVENTS)
    assert got == {tuple(r) for r in L.appended(table, "job", "key", ["at", "id"]).select("id", "sequence").collect()}
    put(spark, [("a", 13, None, 0), ("a", 14, "y", 0)], EVENTS, tmp_path)  # late, and a late repeat
    after = {tuple(r) for r in run(spark, read(), tmp_path, "out").select("id", "sequence").collect()}
    assert after == got | {(13, 1 + max(n for i, n in got if i in (1, 2, 5, 6)))}
    assert {tuple(r) for r in run(spark, read(), tmp_path, "out").select("id", "sequence").collect()} == after


def test_counters_on_streams(spark, tmp_path):
    schema = "job string, phase string, id long, done long, total long"
    files = [
        [("a", "p", 1, 3, None), ("a", "p", 2, 2, 10), ("b", "p", 3, None, None)],
        [("a", "p", 4, 12, 20), ("b", "p", 5, 1, 5), ("a", "q", 6, 1, 1)],
        [("a", "p", 7, 4, None), ("b", "p", 8, 9, 100)],
    ]
    read = lambda: S.counters_stream(S.read_events(spark, f"{tmp_path}/in", schema), ["job", "phase"], ["id"])
    for rows in files:
        put(spark, rows, schema, tmp_path)
        out = run(spark, read(), tmp_path, "out")
    want = L.counters(spark.createDataFrame([r for rows in files for r in rows], schema), ["job", "phase"], ["id"])
    columns = ["id", "done", "total"]
    assert {tuple(r) for r in out.select(*columns).collect()} == {tuple(r) for r in want.select(*columns).collect()}
    assert out.where(F.col("id") == 4).first()["done"] == 10
