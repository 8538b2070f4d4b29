"""Structured data, anchors, feeds and manifests against values written by hand."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import manifests as M
from millrace.operators import pages as G

PAGE = """<html><head><meta property="og:title" content="A &amp; B"><meta content='x' name='og:x'><meta property="og:title" content="Last"><!-- <meta property="og:no" content="n"> -->
<script type="application/ld+json">{"@type":["x1","Y"],"@id":"i","text":"a
b"}</script><script type='application/ld+json'>[{"@type":"B"},{"a":1}]</script><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"k":1}},"page":"/"}</script>
<script>kit.start(app, {node_ids:[0], data: [null,{type:"data",data:{title:"x]",n:[1,2]},uses:{}},{"type":"z", q:[{a:1}]}]})</script></head>
<table><tr><td><table><tr></tr></table></td></tr><tr></tr></table><table></table><a href="/x?q#f">1</a><a class=y href='../up'>2</a><area href="/no"><a data-href="/no" href="mailto:a">3</a><a href="?p=1">4</a><a href="//o.org">5</a><a href="/x?q#f">6</a></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "https://h.io/a/b/c?z=1", PAGE), (2, "https://h.io", "<p>none</p>"), (3, None, None)], "id long, url string, html string")


def test_structured_pass(pages):
    got = {r["id"]: tuple(r)[1:] for r in G.structured_pass(pages, "id").collect()}
    assert got[1] == (3, 1, 2, "jsonld", '{"@id":"i","@type":["x1","Y"],"text":"a\\nb"}', "x1", "i")
    assert got[2] == got[3] == (0, 0, 0, None, None, None, None)
    first = pages.where("id = 1").select(F.transform(G.sveltekit(F.col("html")), lambda v: F.to_json(v)).alias("s"), F.transform(G.next_data(F.col("html")), lambda v: F.to_json(v)).alias("n")).first()
    assert first["s"] == ['{"n":[1,2],"title":"x]"}', '{"q":[{"a":1}],"type":"z"}'] and first["n"] == ['{"k":1}']


def test_page_items(pages):
    source = '"_source_url":"https://h.io/a/b/c?z=1"'
    assert [tuple(r)[1:] for r in G.page_items(pages, "id").orderBy("at").collect()] == [
        (0, "json-ld", f'{{"@type":"B","_parser":"json-ld",{source}}}'),
        (1, "json-ld", f'{{"_parser":"json-ld",{source},"a":1}}'),
        (2, "open-graph", f'{{"_parser":"open-graph",{source},"og:title":"Last","og:x":"x"}}'),
        (3, "html-table", f'{{"_parser":"html-table",{source},"rows":3}}'),
    ]


def test_results_and_repeats(spark):
    html = '<script type="application/ld+json">{"results":[{"b":2},{"b":2},7]}</script><script type="application/ld+json">"text"</script>'
    rows = spark.createDataFrame([(1, "u", html)], "id long, url string, html string")
    assert [r["item"] for r in G.page_items(rows, "id").orderBy("at").collect()] == ['{"_parser":"json-ld","_source_url":"u","b":2}', "7"]


@pytest.mark.parametrize(
    "base, link, want",
    [
        ("https://h/a/b?q#f", "c", "https://h/a/c"), ("https://h/a/b", "../../../c/./d/", "https://h/c/d/"), ("https://h", "c", "https://h/c"), ("https://h/a", "#x", "https://h/a#x"), ("https://h/a?q", "?r", "https://h/a?r"),
        ("https://h/a/", "..", "https://h/"), ("https://h/a/b", "", "https://h/a/b"), ("http://h/a", "//o/p", "http://o/p"), ("no base", "c", None), ("https://h", "HTTPS://X/y", "HTTPS://X/y"), ("https://h", "https://x?y", "https://x/?y"),
    ],
)
def test_resolved(spark, base, link, want):
    assert spark.createDataFrame([(base, link)], "b string, l string").select(G.resolved(F.col("b"), F.col("l")).alias("x")).first()["x"] == want


def test_anchors(pages):
    got = [r["x"] for r in pages.select(G.anchors(F.col("url"), F.col("html")).alias("x")).collect()]
    assert got == [["https://h.io/x?q#f", "https://h.io/a/up", "https://h.io/a/b/c?p=1", "https://o.org/"], [], None]
    assert pages.where("id = 1").select(F.size(G.anchors(F.col("url"), F.col("html"), 2)).alias("n")).first()["n"] == 2


RSS = """<?xml version="1.0"?>
<rss version="2.0" xmlns:content="http://c" xmlns:dc="http://d"><channel><title>E</title><link>https://example.com/blog/</link>
<item><title> First </title><link>https://example.com/a?utm_source=x&amp;b=1#f</link><description>Hello &lt;b&gt;world&lt;/b&gt;</description><guid isPermaLink="false">g1</guid><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><dc:creator>Ann</dc:creator></item>
<item><link>https://example.com/a?b=1</link></item><item><title>rel</title><link>post/2</link><content:encoded><![CDATA[<p>x</p>]]></content:encoded></item><item><guid>https://g.io/1</guid></item><item><title>no</title></item></channel></rss>"""
ATOM = """<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><link rel="self" href="https://s/self"/><link rel="alternate" href="https://s/"/><entry><title type="html">Atom Post</title>
<link rel="edit" href="e"/><link rel="alternate" href="/x"/><content type="html">&lt;p&gt;Hi there&lt;/p&gt;</content><updated>2024-01-02T03:04:05+01:00</updated><author><name>Bob</name></author></entry></feed>"""
JSON = '{"version":"https://jsonfeed.org/version/1","items":[{"id":"1","url":"https://j/1","content_text":"t","date_published":"2024-01-02T03:04:05Z"},{"id":"https://j/2"}]}'


def test_feeds(spark):
    texts = [RSS, ATOM, JSON, "<rss><channel><item>", "plain", "<rss><channel><title>E</title></channel></rss>", None]
    got = G.feed_entries(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id").orderBy("id", "at")
    seconds = F.unix_timestamp("published") - 1704164645
    assert [tuple(r) for r in got.withColumn("published", seconds).collect()] == [
        (0, 0, "rss", "g1", "https://example.com/a?utm_source=x&b=1#f", "First", "Hello <b>world</b>", 0, "Ann", None),
        (0, 1, "rss", None, "https://example.com/blog/post/2", "rel", "<p>x</p>", None, None, None),
        (0, 2, "rss", "https://g.io/1", "https://g.io/1", None, "", None, None, None),
        (1, 0, "atom", None, "https://s/x", "Atom Post", "<p>Hi there</p>", -3600, "Bob", None),
        (2, 0, "json", "1", "https://j/1", None, "t", 0, None, None),
        (2, 1, "json", "https://j/2", "https://j/2", None, "", None, None, None),
        (3, 0, None, None, None, None, None, None, None, "no feed"),
        (4, 0, None, None, None, None, None, None, None, "no feed"),
        (6, 0, None, None, None, None, None, None, None, "no feed"),
    ]


FILES = [
    ("a/Cargo.toml", '[package]\nedition = "2021"\nrust-version = "1.75"\nname="x"\n[dependencies]\nserde = { version = "1.0" }\n# c = "1"\nlocal = { path = \'../x\' }\n[workspace]\nmembers = ["a", \'b\']\n[features]\ndefault = []\n[other]\nz = "1"\n'),
    ("package.json", '{"dependencies":{"react":"^18","w":{"x":1}},"devDependencies":{},"scripts":{"b":"run","e":""},"engines":{"node":">=18","n":1}}'),
    ("b/package.json", "{"),
    ("requirements.txt", "# c\nflask==2.0\nrequests >= 1 ; x\nplain\n==1\n"),
    ("pyproject.toml", '[project]\ndependencies = ["a>=1", \'b\']\nrequires-python = ">=3.9"\n[project.optional-dependencies]\ndev = ["pytest", "black"]\nnone = []\n[tool]\nq = "1"\n'),
    ("go.mod", "module m\n\ngo 1.21\ntoolchain go1.21.5\nrequire github.com/a/b v1.0\nrequire (\n\tx.io/y v2 // indirect\n\t// c\n)\nexclude z v1\n"),
    ("pom.xml", "<project>\n<properties>\n <java.version>\n17</java.version><maven.compiler.source>11</maven.compiler.source></properties>\n<dependency>\n<groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency>\n<dependency><groupId>g</groupId></dependency>\n\n<dependency><groupId>h</groupId><artifactId>b</artifactId></dependency></project>"),
    ("x.txt", "a=1"),
    ("go.mod", None),
]
DECLARED = [
    (0, 2, "package", "rust", "2021"), (0, 3, "package", "rust", "1.75"), (0, 6, "dependencies", "serde", "1.0"), (0, 8, "dependencies", "local", "../x"), (0, 10, "workspace.members", "a", None), (0, 10, "workspace.members", "b", None), (0, 12, "features", "default", None),
    (1, 1, "dependencies", "react", "^18"), (1, 1, "dependencies", "w", None), (1, 1, "engines", "node", ">=18"), (1, 1, "scripts", "b", "run"), (1, 1, "scripts", "e", None),
    (2, None, None, None, None),
    (3, 2, "runtime", "flask", "==2.0"), (3, 3, "runtime", "requests", ">= 1 ; x"), (3, 4, "runtime", "plain", None),
    (4, 2, "project.dependencies", "a", ">=1"), (4, 2, "project.dependencies", "b", None), (4, 3, "project", "python", ">=3.9"), (4, 5, "project.optional-dependencies", "dev", "pytest, black"), (4, 6, "project.optional-dependencies", "none", None),
    (5, 3, "toolchain", "go", "1.21"), (5, 4, "toolchain", "go", "1.21.5"), (5, 5, "require", "github.com/a/b", "v1.0"), (5, 7, "require", "x.io/y", "v2"),
    (6, 4, "properties", "java", "11"), (6, 5, "dependencies", "g:a", "1"), (6, 9, "dependencies", "h:b", None),
]


def test_manifests(spark):
    files = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(FILES)], "doc_id long, path string, text string")
    rows = M.manifest_facts(files).orderBy("doc_id", "line", "scope", "name").collect()
    assert sorted(((r["doc_id"], r["line"], r["scope"], r["name"], r["version"]) for r in rows), key=str) == sorted(DECLARED, key=str)
    assert {r["fault"] for r in rows} == {None, "parse.manifest.invalid"} and {r["quote"] for r in rows if r["name"] == "w"} == {'w: {"x":1}'}
