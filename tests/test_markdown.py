"""Pages as Markdown against values written by hand, and the ladder of attempts."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import markdown as K

PAGE = """<html><head><title>t</title></head><body><nav>menu</nav><main><h1>Title <em>x</em></h1><p>One <b>bold</b> and <a href='/u'>a link</a>.<br>Next</p><ul><li>a<li>b<ul><li>c</li></ul></li></ul><ol><li>x</li><li>y</li></ol>
<pre><code>def f():\n    pass</code></pre><blockquote><p>q1</p><p>q2</p></blockquote><table><tr><th>h1<th>h2</tr><tr><td>1</td><td>2|3</td></tr></table><img src=x><hr><p hidden>no</p><div role=navigation>no</div></main><footer>f</footer></body></html>"""
WANT = "# Title *x*\n\nOne **bold** and [a link](/u).\nNext\n\n- a\n- b\n - c\n\n1. x\n2. y\n\n```\ndef f():\n pass\n```\n\n> q1\n\n> q2\n\n| h1 | h2 |\n| --- | --- |\n| 1 | 2\\|3 |\n\n---"


def loose(text):
    """Blank lines around lists do not count."""
    return [line for line in text.split("\n") if line]


def test_a_page():
    assert loose(K.to_markdown(PAGE)) == loose(WANT)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<body><div><p>no main</p><script>x</script><p>two</p></div>", "no main\n\ntwo"), ("plain &amp; text", "plain & text"), ("<div id=navbar>x</div><p>y", "y"), ("<p>a<p>b", "a\n\nb"),
        ("<article><p>a</p></article><article><p>b</p></article>rest", "a\n\nb"), ("", ""), ("<p><b> </b>x<a href=''>y</a></p>", "xy"), ("<h2>a</h2>b<h3>c", "## a\n\nb\n\n### c"), ("<p>a   b\n\n c</p>", "a b c"),
        ("<div aria-hidden='true'>x</div><div class='a feedback-toolbar'>y</div><a href='#content-area'>skip</a><p data-nosnippet>z</p>k", "k"), ("<p>1 < 2 & 3</p>", "1 < 2 & 3"), ("<p>cut <b>off", "cut **off**"),
    ],
)
def test_small_pages(html, want):
    assert K.to_markdown(html) == want


def test_selectors():
    page = "<div class='doc x'><p>in</p><span class=no>out</span></div><main><p>rest</p></main>"
    assert K.to_markdown(page, root=".doc", exclude="span.no, #none") == "in" and K.to_markdown(page) == "rest" and K.to_markdown(page, root="#gone") == ""
    with pytest.raises(ValueError):
        K.to_markdown(page, root="div > p")


def test_ladder(spark):
    word = "w " * 400
    rows = [("a " * 10, word, None, 6000, True, "relaxed", 400), ("a " * 10, word, None, 5000, True, "scored", 10), ("a " * 30, word, None, 6000, True, "scored", 30), ("a " * 10, None, word, 6000, False, "body", 400), ("a " * 199, None, "w " * 398, 6000, False, "scored", 199), ("", None, "w " * 50, 6000, False, "scored", 0), ("", None, "w " * 51, 6000, False, "body", 51)]
    df = spark.createDataFrame(rows, "s string, r string, b string, n long, root boolean, tier string, words long")
    got = df.select(K.ladder(*[F.col(c) for c in ("s", "r", "b", "n", "root")]).alias("f"), "tier", "words").collect()
    assert all((r["f"]["tier"], r["f"]["words"]) == (r["tier"], r["words"]) for r in got)


def test_extracted(spark):
    body = f"<body><main><p>few words</p></main><div><p>{'many words here. ' * 400}</p></div></body>"
    rows = spark.createDataFrame([(1, PAGE), (2, body), (3, None), (4, "<main><p>" + "one two three " * 100 + "</p></main>")], "page_id long, html string")
    got = {r["page_id"]: (r["tier"], r["words"]) for r in K.extracted(rows, "page_id").collect()}
    assert got[2] == ("body", 1202) and got[3] == ("scored", 0) and got[4] == ("scored", 300) and got[1][0] == "scored"
