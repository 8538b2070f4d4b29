"""Cases of the job operators that the tables do not hold."""

from millrace.operators import jobs as J


def test_embedding_audit_names_each_fault(spark):
    chunks = spark.createDataFrame([(1,), (2,), (3,), (4,), (6,)], "k long")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, float("nan")]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (5, [1.0, 2.0])], "k long, v array<double>")
    got = {r["k"]: r["verdict"] for r in J.embedding_audit(chunks, vectors, "k", "v", 2).collect()}
    assert got == {1: "ok", 2: "wrong_dimension", 3: "not_finite", 4: "duplicate", 5: "unexpected", 6: "missing"}


def test_link_changes_report_repeated_links_each(spark):
    before = spark.createDataFrame([(1, "a"), (1, "b")], "page_id long, href string")
    after = spark.createDataFrame([(1, "b"), (1, "c"), (1, "c")], "page_id long, href string")
    got = sorted((r["href"], r["change"]) for r in J.link_changes(before, after).collect())
    assert got == [("a", "removed"), ("c", "added"), ("c", "added")]


def test_link_changes_deal_links_to_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(J, "LINKS_A_TASK", 100, raising=False)
    monkeypatch.setattr(J, "COPIES", 3, raising=False)
    after = spark.range(5000).selectExpr("id % 1000 as page_id", "if(id % 1000 = 7, null, string(id)) as href")
    before = after.where("page_id < 500")
    more = after.unionByName(spark.sql("select 1L as page_id, 'again' as href from range(10)"))
    found = J.link_changes(before, more)
    assert found.rdd.getNumPartitions() >= 70  # 7,510 links
    got = sorted((r["page_id"], r["href"], r["change"]) for r in found.collect())
    assert got == sorted([(i % 1000, str(i), "added") for i in range(5000) if i % 1000 >= 500] + [(1, "again", "added")] * 10)
