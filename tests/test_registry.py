"""Each registered query of the engine's own operators against its SQL, on the smallest tables."""

import duckdb
import pytest

from millrace.plans import answers, documents, dumps, manifests, pages, payloads, registry, rules, structured, texts, upkeep  # noqa: F401  the modules register their queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = got.select(*[f"`{c}`" for c in columns]).collect()
    if name not in registry.oracle_sql():
        assert rows
        return
    inner = registry.oracle_sql()[name]
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({inner})").fetchall()
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(map(plain, r)) for r in want)


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from millrace.sources.tables import table
    from millrace.streaming import events as S

    rows = table(spark, DATA, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = S.tumbling(S.read_events(spark, f"{tmp_path}/in", rows.schema, 10), "1 day", "90 days")
    run = stream.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {tuple(r) for r in spark.table("daily").select("start", "event_type", "n").collect()} == {tuple(r) for r in S.tumbling(rows, "1 day").select("start", "event_type", "n").collect()}
