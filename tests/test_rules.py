"""Expected values of single rules, as the reference's own tests and texts state them."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import records as C
from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.operators import access as A
from millrace.operators import graph as G
from millrace.operators import ledger as L
from millrace.operators import lifecycle as Y
from millrace.operators import memory as M
from millrace.sources import tables as S


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "score"),
    [("https://docs.example.com/guide", 6), ("https://example.com/", 1), ("https://example.com/blog/post?page=2", -3), ("https://example.com/a.zip", -4), ("https://example.com/a/b/c/d/e", 0), ("no address", 0), ("https://example.com/documents", 2), ("https://example.com/my-docs-old", 6)],
)
def test_suggestion_score(spark, url, score):
    assert one(spark, U.suggestion_score, url) == score


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://Example.com", "https://example.com/"), ("https://example.com/", "https://example.com/"), ("HTTP://example.com:80/a/#x", "http://example.com/a"), ("https://example.com:8443/a//?q=/", "https://example.com:8443/a?q=/"), ("https://example.com?q=1/", "https://example.com/?q=1/")],
)
def test_canonical(spark, url, want):
    assert one(spark, U.canonical, url) == want


def test_hosts(spark):
    assert one(spark, U.host, "https://[2001:db8::1]:8080/x") == "[2001:db8::1]"
    assert one(spark, U.host, "https://user:pw@WWW.Example.com:80/x") == "example.com"
    assert one(spark, U.valid_host, "https://n/path") is False and one(spark, U.valid_host, "/relative") is True
    assert one(spark, U.endpoint_noise, "https://a.io/app.js?api") is True and one(spark, U.is_endpoint, " /API/users") is True


def test_exclusions_and_scope(spark):
    assert one(spark, lambda u: U.excluded_any_case(u, ["/de"]), "https://a.io/DE-ch/x") is True
    assert one(spark, lambda u: U.excluded_any_case(u, ["de", "/"]), "https://a.io/docs/de/x") is True
    assert one(spark, lambda u: U.excluded_any_case(u, ["/de"]), "https://a.io/design") is False
    assert one(spark, lambda u: A.in_scope(u, "www.a.io", "/docs"), "https://a.io/docs/x") is True
    assert one(spark, lambda u: A.in_scope(u, "a.io", "/docs"), "https://a.io/docs-old") is False
    assert one(spark, lambda u: A.in_scope(u, "a.io"), "https://b.a.io/") is False
    assert one(spark, lambda u: A.in_scope(u, "a.io", subdomains=True), None) is False


def test_secrets(spark):
    assert one(spark, T.contains_secret, "key sk_" + "a1" * 10) is True
    assert one(spark, T.contains_secret, "key sk_" + "a1" * 9) is False
    assert one(spark, T.contains_secret, "AKIA" + "A1" * 10) is False


def test_pages(spark):
    assert one(spark, T.challenge, "x <b>Just A Moment</b> cf-spinner") == "cloudflare"
    assert one(spark, T.challenge, "/cdn-cgi/challenge-platform/scripts/jsd/main.js") is None
    assert one(spark, T.challenge, "cf-turnstile" + " " * 100_000) is None
    assert one(spark, T.meta_description, '<head><META name="Description" content="a b"></head>') == "a b"
    assert one(spark, T.meta_description, '<head></head><meta name="description" content="a">') is None
    assert one(spark, T.links, '<a href="https://a.io/x"><abbr href="https://b.io"><a class=y href=" http://c.io "><a href="/r"><a href="https://a.io/x">') == ["https://a.io/x", "http://c.io"]
    assert one(spark, C.link_identity, "https://a.io/x?utm_source=1&b=2&ref=3&fbclid=4#f") == "https://a.io/x?b=2"
    assert tuple(one(spark, T.env_keys, "export DATABASE_URL=x")) == ("DATABASE_URL", True, True)
    assert one(spark, T.markdown_links, "[a](https://x.io/p#q) [b](#c) [d](mailto:e) [f]( http://y.io )") == ["https://x.io/p", "http://y.io"]


def test_transitions(spark):
    rows = spark.createDataFrame([("queued", "running", True), ("running", "expired", True), ("completed", "running", False), ("canceling", "canceling", True), ("queued", "completed", False), (None, "queued", False)], "a string, b string, want boolean")
    assert all(r["got"] == r["want"] for r in rows.withColumn("got", L.may_become(F.col("a"), F.col("b"))).collect())
    assert sum(map(len, L.TRANSITIONS.values())) == 27


def test_authority(spark):
    rows = spark.createDataFrame([("official", "official", "official", True), ("inferred", "inferred", "inferred", False), ("mirror", "verified", "verified", False), ("user_pinned", "official", "user_pinned", False)], "a string, b string, winner string, conflict boolean")
    for r in rows.withColumn("got", G.resolved(F.col("a"), F.col("b"))).collect():
        assert tuple(r["got"]) == (r["winner"], r["conflict"])


def test_memory(spark):
    assert one(spark, lambda b: M.keyword_semantic(b, "Red Car"), "A red car.") == 1.0
    assert one(spark, lambda b: M.keyword_semantic(b, "red bus"), "A red car.") == 0.5
    assert one(spark, lambda b: M.keyword_semantic(b, "  "), "A red car.") == 0.0
    records = spark.createDataFrame([(1, "g", 5, 0), (2, "g", 9, 1), (3, "g", 4, 2), (4, "g", 1, 3), (5, "h", 99, 0)], "id long, g string, cost int, at int")
    assert [tuple(r) for r in M.packed(records, "g", [F.col("at")], "id", "cost", 10).collect()] == [("g", [1, 3, 4], 10)]
    entries = spark.createDataFrame([("g", 1, "abcdef"), ("g", 2, "gh"), ("h", 1, "ab"), ("h", 2, "cdefgh")], "g string, at int, t string")
    assert sorted(tuple(r) for r in M.clipped_prefix(entries, "g", "at", "t", 8, 4).collect()) == [("g", 1, "abcd"), ("h", 1, "ab")]


def test_deletions(spark):
    points = spark.createDataFrame([(1, 7, 3, "u/1"), (2, 7, 4, None), (3, None, 3, "u/2")], "point_id long, source_id long, source_generation long, item_canonical_uri string")
    points = points.withColumns({c: F.lit(None).cast("string") for c in ("source_canonical_uri", "source_item_key", "locator_uri")})
    left = lambda kind, **of: [r["point_id"] for r in A.without(points, kind, **of).orderBy("point_id").collect()]
    assert left("source", source_id="7") == [3]
    assert left("source", source_id="7", generation="4") == [1, 3]
    assert left("uri", uri="u/", prefix=True) == [2]
    assert left("uri", uri="u/") == [1, 2, 3]
    assert left("points", point_ids=[]) == [1, 2, 3]
    assert left("filter", filter={"source_generation": 3}) == [2]
    assert left("collection") == []


def test_upsert_is_idempotent(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "point_id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "point_id long, v string")
    paths = [f"file://{tmp_path}/{i}" for i in range(3)]
    S.write_points(old, paths[0])
    S.upsert_points(new, paths[0], paths[1])
    S.upsert_points(new, paths[1], paths[2])
    for p in paths[1:]:
        assert sorted(tuple(r) for r in spark.read.parquet(p).collect()) == [(1, "a"), (2, "c"), (3, "e")]


def test_memory_scores_lose_by_age_and_status(spark):
    rows = spark.sql("""SELECT * FROM VALUES (1, 'fast', 7.0D, FALSE, 'active', 0.5D), (2, 'none', 900.0D, FALSE, 'active', 1.0D), (3, 'very_slow', 730.0D, FALSE, 'superseded', 0.0D),
      (4, 'normal', 30.0D, TRUE, 'archived', 0.75D), (5, 'slow', -5.0D, FALSE, 'contradicted', 0.75D), (6, 'very_fast', 2.0D, FALSE, 'forgotten', 0.0D), (7, 'odd', 5.0D, FALSE, 'working', 1.0D) AS t(id, profile, age, pinned, status, want)""")
    full = F.lit(1.0)
    score = Y.memory_score(full, full, full, full, F.lit(10**6), Y.decay(F.col("age"), Y.half_life(F.col("profile")), F.col("pinned")), F.col("status"))
    for r in rows.withColumn("got", score).collect():
        assert r["got"] == pytest.approx(r["want"]), r
    kept = rows.where("id = 4").select(Y.status_penalty(F.col("status"), archived=True).alias("p")).first()["p"]
    assert kept == 0.0


def test_merged_nodes_take_the_highest_authority(spark):
    rows = spark.createDataFrame([(1, "mirror", 0.5, "a", 1, 1), (1, "inferred", None, "b", 2, 2), (1, "community", 3.0, "a", 3, 3), (2, None, None, "c", 4, 4), (3, "observed", -1.0, "d", 5, 5)], "node_id long, authority string, confidence double, source_id string, label long, updated_at long")
    got = {r["node_id"]: (r["authority"], r["confidence"], r["source_ids"], r["label"]) for r in Y.merge_nodes(rows, 0.25).collect()}
    assert got[1] == ("inferred", 1.0, ["a", "b"], 3) and got[2] == ("unknown", 0.25, ["c"], 4) and got[3][1] == 0.0


def test_term_lists(spark):
    docs = spark.createDataFrame([(1, "The Spark spark, ab c1d2 é-über"), (2, None), (None, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in T.term_lists(docs).collect()}
    assert sorted(got[1]["counts"]) == [1, 1, 2] and got[2]["buckets"] == [] and got[None]["weights"] == []
    word = docs.select(T.bucket(F.lit("spark")).alias("b")).first()["b"]
    assert dict(zip(got[1]["buckets"], got[1]["counts"], strict=True))[word] == 2
