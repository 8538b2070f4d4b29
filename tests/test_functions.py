from datetime import date

from pyspark.sql import functions as F

from millrace.functions import sitemaps as M
from millrace.functions import text as T
from millrace.operators import reports as P


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("x")).first()["x"]


def test_robots(spark):
    robots = "User-agent: *\nSITEMAP: https://b.org/s.xml # note\n sitemap : https://a.org/s.xml\r\nSitemap:\n# Sitemap: no\nsitemap: https://a.org/s.xml"
    assert one(spark, M.robots_sitemaps(F.col("v")), robots) == ["https://a.org/s.xml", "https://b.org/s.xml"]
    assert one(spark, M.robots_sitemaps(F.col("v")), "") == []


def test_sitemap(spark):
    xml = "<urlset><url><loc> https://a.org/?x=1&amp;y=2 </loc></url><URL><LOC>https://b.org</LOC><lastmod>2024-05-06</lastmod></URL><url></url></urlset>"
    assert [tuple(r) for r in one(spark, M.sitemap_entries(F.col("v")), xml)] == [("https://a.org/?x=1&y=2", None), ("https://b.org", "2024-05-06")]


def test_recent(spark):
    today = F.lit(date(2024, 5, 10))
    for value, want in (("2024-05-03T10:00:00Z", True), ("2024-05-02", False), ("soon", True), (None, True)):
        assert one(spark, M.recent(F.col("v"), today, 7), value) is want


def test_judged(spark):
    assert tuple(one(spark, M.judged(F.col("v")), "RAG: 4 Baseline: 3.5\nRAG: 2\nx RAG: 1.5, Baseline: 5")) == (5.5, 8.5)
    assert one(spark, M.judged(F.col("v")), "RAG: 4\nBaseline: 3") is None


def test_starved(spark):
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    rows = [("interactive", "queued", "2024-01-01 00:50:00"), ("background", "running", "2024-01-01 00:00:00")]
    make = lambda rows: spark.createDataFrame(rows, "priority string, status string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert [r[0] for r in P.starved(make(rows), now, 600).collect()] == [600]
    assert P.starved(make(rows), now, 601).count() == P.starved(make(rows), now, 0).count() == 0
    assert P.starved(make([*rows, ("interactive", "running", "2024-01-01 00:59:00")]), now, 600).count() == 0
    assert P.starved(make([]), now, 600).count() == 0


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], "k long, at timestamp")
    assert P.duplicate_breakdown(none, F.col("k"), F.col("k")).count() == 0
    assert tuple(P.staleness(none, F.col("at"), F.current_timestamp(), 1).first()) == (0, 0, 0, 0, 0.0, None, None)
    assert tuple(P.set_audit(none, none, "k").first()) == (0, 0, 0)


def test_redact(spark):
    run, dull = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6", "x" * 40
    for text, want in (
        (f"id {run}, {dull} end", f"id [REDACTED], {dull} end"),
        (f"{dull}{dull}\n{run}-{run}\n", f"{dull}{dull}\n[REDACTED]\n"),
        ("ab" * 40 + " " + run[:31], "ab" * 40 + " " + run[:31]),
        ("12345678" * 4 + " " + "1234567" * 5, "[REDACTED] " + "1234567" * 5),
        ("ya29.a-b atk_x ghu_1 ghr_2 sk-1 task-force", "[REDACTED] [REDACTED] [REDACTED] [REDACTED] [REDACTED] task-force"),
        ("Authorization: Basic dXNlcg== rest", "[REDACTED] rest"),
        ("authorization=abc\nAuthorization:\nnext", "[REDACTED]\n[REDACTED]\nnext"),
        ("a MY_TOKEN=x1 b?api_key:2 ghp_ab.SECRET=q", "a [REDACTED] [REDACTED] [REDACTED][REDACTED]"),
        ("no-gap sk-ab.TOKEN=1", "no-gap [REDACTED][REDACTED]"),
        ("(ya29.x)TOKEN=1 AIza" + "b" * 35 + "c", "[REDACTED] [REDACTED]c"),
        ("", ""),
        (None, None),
    ):
        assert one(spark, T.redact(F.col("v")), text) == want, text
    assert one(spark, T.redact(F.col("v"), services=True), "http://u:p@h/ hf_abcdefghijklmnop") == "http://[REDACTED]@h/ [REDACTED]"


def test_contains_secret(spark):
    token = "a" * 20
    for text, want in (
        ("a Bearer x", True), ("X-Api-Key: 1", True), ("?token=1", True), ("adapter_Response", True), ("bearer\nof news", False),
        (f"(sk_{token})", True), (f"sk-{token[1:]}", False), (f"task-{token} xsk-{token}", False), (f"sk-proj-{token} ", True), (f"ghu_{token}", True),
        ("x\n A_B = 1", True), ("A_B =\n1", False), ("Ab=1", False),
        ("-----BEGIN RSA PRIVATE KEY-----", True), ("-----BEGIN x PRIVATE KEY-----", False),
        ("s://u:p@h", True), ("s://u:p@ h", False), ("s://u@h:1", False),
        ("sid=0123456789abcdef; HttpOnly", True), ("sid=0123456789abcde; HttpOnly", False), ("sid=0123456789abcdef;", False), ("sid=0123456789abcdef; no flag", False), ("sid=0123456789abcdef; a.b", False),
        ("", False), (None, None),
    ):
        assert one(spark, T.contains_secret(F.col("v")), text) is want, text


def test_windows_keep_both_limits(spark):
    import random

    rng = random.Random(9)
    texts = ["", "a", "a" * 2000, "a" * 2001, "é" * 2100, "你" * 1400, "🙂" * 1100, "a" * 8500]
    texts += ["".join(rng.choices("aé你🙂", weights=[rng.random() + 0.01 for _ in range(4)], k=rng.randint(1500, 5000))) for _ in range(12)]
    want = []
    for t in texts:
        out, start, size = [], 0, 0
        for i, c in enumerate(t):
            n = len(c.encode())
            if i > start and (size + n > 4096 or i + 1 - start > 2000):
                out.append(t[start:i])
                start, size = i, 0
            size += n
        want.append(out + ([t[start:]] if t else []))
    got = spark.createDataFrame(list(enumerate(texts)), "i int, v string").where("v <> ''").select("i", T.windows(F.col("v")).alias("w")).collect()
    assert {r["i"]: r["w"] for r in got} == {i: w for i, w in enumerate(want) if texts[i]}
