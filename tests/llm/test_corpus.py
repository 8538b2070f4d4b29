import itertools
import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import ann, components, fm_index, html_text, jaccard_join, quality, substring_dedup

from . import cases


def brute_substring(data, window):
    docs = [(i, (t or "").encode().split()) for i, t, *_ in data]
    first = {}
    for i, w in docs:
        if i is not None:
            for s in range(len(w) - window + 1):
                k = tuple(w[s : s + window])
                first[k] = min(i, first.get(k, i))
    out = Counter()
    for i, w in docs:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out[i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()] += 1
    return out


@pytest.mark.parametrize("dense", [substring_dedup.DENSE, 1])
def test_substring_dedup(spark, dense, monkeypatch):
    monkeypatch.setattr(substring_dedup.removals, "__defaults__", (50, 8, dense))
    data = cases.rows(["same word " * 120, "other same word " + "same word " * 60, "z " * 49])
    docs = cases.frame(spark, ["same word " * 120, "other same word " + "same word " * 60, "z " * 49])
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == brute_substring(data, 50)
    assert any(k[2] for k in got)
    assert substring_dedup.substring_dedup(cases.empty(spark)).count() == 0


def test_fm_index_against_scan():
    rng = np.random.default_rng(5)
    base = rng.integers(1, 6, 60)
    segments = [np.concatenate((rng.integers(1, 6, rng.integers(0, 9)), base[a:b], rng.integers(1, 6, rng.integers(0, 9)))) for a, b in rng.integers(0, 60, (40, 2)) if a < b]
    owners = rng.integers(0, 12, len(segments))
    for length in (3, 7):
        held = fm_index.FMIndex(segments, owners).held_by_smaller(length)
        for s, o, own in zip(segments, owners, held, strict=True):
            smaller = {tuple(x[i : i + length]) for x, p in zip(segments, owners, strict=True) if p < o for i in range(len(x) - length + 1)}
            want = {p for i in range(len(s) - length + 1) if tuple(s[i : i + length]) in smaller for p in range(i, i + length)}
            assert {p for a, b in own for p in range(a, b)} == want


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(data, m):
    sets = [(i, shingles(t, m.k)) for i, t, *_ in data]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and b and m.den * len(a & b) >= m.num * len(a | b):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


@pytest.mark.parametrize(("m", "short"), [(jaccard_join.Measure(3, 90, 100), 16), (jaccard_join.Measure(5, 80, 100), 2), (jaccard_join.Measure(3, 90, 100), 1)])
def test_near_components(spark, m, short, monkeypatch):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 400, 120)]
    extra = []
    for _ in range(40):  # a group of near copies at various distances, and chains between them
        w = list(base)
        for p in rng.integers(0, 120, rng.integers(1, 5)):
            w[p] = f"e{rng.integers(0, 30)}"
        extra.append(" ".join(w[rng.integers(0, 4) :]))
    got = Counter(tuple(r) for r in jaccard_join.near_components(cases.frame(spark, extra), m, short).collect())
    assert got == brute_components(cases.rows(extra), m)
    assert jaccard_join.near_components(cases.empty(spark), m).count() == 0


@pytest.mark.parametrize("num", [80, 90])
def test_linked_sets_share_a_signature(num):
    m = jaccard_join.Measure(3, num, 100)
    rng = np.random.default_rng(num)
    universe = np.unique(rng.integers(0, 2**60, 3000).astype(np.uint64) * np.where(rng.random(3000) < 0.5, 5, 1).astype(np.uint64))
    for trial in range(300):
        frequent = np.sort(rng.choice(universe[universe % 5 == 0], rng.integers(0, 500), replace=False))
        counts = rng.integers(5, 50, len(frequent))
        n = int(rng.choice([3, 30, 380, 420, 500]))
        a = rng.choice(universe, n, replace=False)
        b = np.concatenate((a[rng.integers(0, max(1, n // 8)) :], rng.choice(universe, rng.integers(0, max(1, n // 8)))))
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if 100 * common >= num * (len(a) + len(b) - common) and len(a) + len(b) > 2 * common:
            assert len(np.intersect1d(jaccard_join.signatures(a, frequent, counts, m)[0], jaccard_join.signatures(b, frequent, counts, m)[0])), trial


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (9, 8), (8, 7), (20, 21), (21, 22), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 7: 3, 8: 3, 9: 3, 20: 20, 21: 20, 22: 20}


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    x[100:180] = x[7]
    rows = [(i, [float(v) for v in e], "c") for i, e in enumerate(x)] + [(900, None, "c"), (920, [0.0] * 8, "c"), (940, [math.nan] + [1.0] * 7, "c"), (960, [None] + [1.0] * 7, "c"), (None, [1.0] * 8, "c"), (980, [1.0], "c"), (7, [float(v) for v in x[7]], "c")]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string"), 20, 20).collect()
    by = {}
    for r in out:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 400, 20))
    hits = 0
    for q, own in by.items():
        own.sort()
        s = x @ x[q]
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-round(s[i], 9), i))[:20]
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(abs(score - s[v]) < 1e-12 for _, v, score in own)
        hits += len({v for _, v, _ in own} & set(want))
    assert hits >= 0.9 * 20 * len(by)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(few).collect()] == [(0, 1, 1, 0.0)]
    assert ann.nearest(few.limit(0)).count() == 0


def test_nearest_of_mixed_lengths(spark):
    rng = np.random.default_rng(4)
    long, short = rng.normal(size=(60, 5)), rng.normal(size=(40, 3))
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(long)] + [(100 + i, [float(v) for v in e]) for i, e in enumerate(short)] + [(200, [1.0])]
    by = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 20).collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(by) == {0, 20, 40, 100, 120}
    for q, found in by.items():
        x, first = (long, 0) if q < 100 else (short, 100)
        s = x @ x[q - first]
        want = [first + int(i) for i in np.argsort(-s) if first + i != q][:5]
        assert len(set(want) & {v for _, v in found}) >= 4 and sorted(r for r, _ in found) == [1, 2, 3, 4, 5]


def _recall(spark, x, k=20, every=20):
    out = ann.nearest(spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<double>"), k, every).collect()
    asked = list(range(0, len(x), every))
    hits = 0
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({r["vec_id"] for r in out if r["query_id"] == q} & set(np.argsort(-s, kind="stable")[:k].tolist()))
    return hits / sum(min(k, len(x) - 1) for _ in asked), len(out)


def test_nearest_of_different_norms(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 16))
    x *= np.exp(rng.normal(0, 1.2, (4000, 1))) / np.sqrt((x**2).sum(1, keepdims=True))
    assert _recall(spark, x)[0] >= 0.95


def test_nearest_reads_a_part_of_the_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 32))[rng.integers(0, 60, 6000)] + 0.3 * rng.normal(size=(6000, 32))
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    rows = ann.usable(spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<double>"))
    asked, read = list(range(0, 6000, 20)), []
    found = ann.search(ann.build(rows, 20), rows.where("vec_id % 20 = 0"), 20, read=read).collect()
    hits = 0
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({r["vec_id"] for r in found if r["query_id"] == q} & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert hits >= 0.9 * 20 * len(asked)
    assert read[0] < 0.2 * len(x) * len(asked)  # postings scored, replicas included


def test_long_lists_are_dealt_to_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_VECTORS", 30)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    recall, rows = _recall(spark, np.random.default_rng(2).normal(size=(900, 6)))
    assert recall >= 0.9 and rows == 45 * 20


@pytest.mark.parametrize("n", [20, 22, 30, 40])
def test_nearest_of_few(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 8))
    recall, rows = _recall(spark, x)
    assert rows == len(range(0, n, 20)) * min(20, n - 1)
    assert recall >= 0.9


def test_html_field_on_pages_kept_apart():
    model = html_text.trained()
    wrong = total = 0
    for page, labels in html_text.labelled_pages(50, seed=77):
        found = html_text.blocks(page)
        wrong += sum(y != labels.get(b.text) for b, y in zip(found, model.decode(found), strict=True))
        total += len(found)
    assert wrong < 0.02 * total


def test_viterbi_is_the_best_path():
    model = html_text.trained(40)
    page = html_text.blocks(html_text.labelled_pages(1, seed=5)[0][0])[:9]

    def value(labels):
        v = model.start[labels[0]] + sum(model.moves[a, b] for a, b in itertools.pairwise(labels))
        return v + sum(y * sum(model.weights.get(f, 0) for f in (*html_text.place_features(b), *html_text.text_features(b))) for b, y in zip(page, labels, strict=True))

    assert value(model.decode(page)) == pytest.approx(max(value(y) for y in itertools.product((0, 1), repeat=len(page))))


def test_extract(spark):
    head = "<html><head><title>no</title><script>var a='<p>x</p>'</script></head><body><nav><a href=/>Menu here</a></nav><!-- c -->"
    body = "<article><h1>A  title &amp; more</h1><p>First <b>bold</b>&nbsp;words\n go on, and on.<br>And so.<p>Second &#233; one follows here.</p></article>"
    tail = "<div class='comments'><p>Nice one, thanks for that.</p></div><footer>&copy; us</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", head + body + tail, 5), (2, None, None, 5), (3, "u", "", 5), (3, "u", head, 5), (None, "u", (head + body + tail)[:-30], 5)], "page_id long, url string, html string, n_chars int")
    want = "A title & more First bold words go on, and on. And so. Second é one follows here."
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()]
    assert got == [(1, want, len(want)), (2, "", 0), (3, "", 0), (3, "", 0), (None, want, len(want))]
    assert html_text.extract(pages.limit(0)).count() == 0
    assert html_text.main_text("<p>" * 5000 + "deep", html_text.trained(20)) is not None


#: Pages written by hand, with the text that a reader would take for the article.
BY_HAND = {
    "a form inside does not end the article": ("<article><h1>Title of it</h1><p>First has some words in it.</p><form><label>Email</label><button>Go</button></form><p>Second has words, too.</p><p>Third as well.</p></article>", "Title of it First has some words in it. Second has words, too. Third as well."),
    "an article in a plain element": ("<nav><a href=/>Home</a><a href=/b>Blog</a></nav><div><h1>Title of it</h1><p>First has some words in it, and more.</p><p>Second has words in it, too.</p></div><footer>&copy; us</footer>", "Title of it First has some words in it, and more. Second has words in it, too."),
    "nothing but paragraphs": ("<body><p>First has some words in it, and then more.</p><p>Short one.</p></body>", "First has some words in it, and then more. Short one."),
    "adverts and notices inside": ("<article><h1>T</h1><p>First has some words.</p><div class='ad'>Buy this now. It is great.</div><p>Second has words.</p><div class=newsletter>Get our letter. Sign up.</div><aside>Pulled words here.</aside><p>Third one, at last.</p><p class='share'>Share this</p><select><option>One<option>Two</select></article>", "T First has some words. Second has words. Third one, at last."),
    "a lone quote": ("<article><p title=it's>First has some words.</p><p>And it's a second.</p></article>", "First has some words. And it's a second."),
    "a quote that is never closed": ('<article><p>First has some words.</p><p title="oh>And a second one.</p></article>', "First has some words. And a second one."),
    "no tags": ("Just plain text without any tags at all. It goes on.", "Just plain text without any tags at all. It goes on."),
    "its own header, comments behind": ("<article><header><h1>The headline</h1><p class=byline>By someone</p></header><p>First has some words.</p><h2>Sub head</h2><ul><li>One thing</li><li>Another thing</li></ul><footer>Filed under x</footer></article><div id=comments><h3>2 comments</h3><p>I like it a lot. Very good.</p></div>", "The headline First has some words. Sub head One thing Another thing"),
    "a sidebar inside the content": ("<div id='content'><div class='sidebar'><ul><li><a href=x>Link a</a></li><li><a href=x>Link b</a></li></ul></div><div class='post'><h1>Title</h1><p>First has some words.</p><p>Read <a href=x>this long piece about it all</a> now.</p></div></div>", "Title First has some words. Read this long piece about it all now."),
    "a form around the page": ("<form id='aspnetForm'><div id=menu><a href=x>Home</a></div><div id=main><h1>Title</h1><p>First has some words.</p><p>Next one has words as well.</p></div></form>", "Title First has some words. Next one has words as well."),
    "a button left open": ("<article><p>First has some words.</p><button>Go<p>Second has some, too.</p></article>", "First has some words. Second has some, too."),
}


@pytest.fixture(scope="module")
def field():
    return html_text.trained()


@pytest.mark.parametrize("what", BY_HAND)
def test_pages_written_by_hand(field, what):
    page, want = BY_HAND[what]
    assert html_text.main_text(f"<html><head><title>no</title></head>{page}</html>", field) == want


#: Classes of ordinary articles with words that tell other parts of a page.
CLASSES = [
    "post has-sidebar", "content with-sidebar", "post-12 post hentry category-news tag-social", "entry-content comment-open", "article-body no-ads", "site-main page-popular", "post-content share-enabled",
    "content-area search-enabled", "post tags", "article meta", "story promo-layout", "hentry print", "post notice", "post poll", "post related-on", "content logo-left", "entry brand-story", "site-content tags-on", "author-page main",
]


@pytest.mark.parametrize("cls", CLASSES)
def test_articles_with_telling_classes_are_whole(field, cls):
    body = "<h1>Title of it</h1><p>First has some words in it, and more.</p><h2>Sub head</h2><ul><li>One thing</li><li>Another thing here</li></ul><p>Second has words in it, too. And then it goes on.</p>"
    want = "Title of it First has some words in it, and more. Sub head One thing Another thing here Second has words in it, too. And then it goes on."
    for tag in ("article", "div", "main", "section"):
        for name in ("class", "id"):
            page = f'<nav><a href=/>Home</a><a href=/b>Blog</a></nav><{tag} {name}="{cls}">{body}</{tag}><div class="comments"><p>I like it. Very good.</p></div><footer><p>&copy; us.</p></footer>'
            assert html_text.main_text(f"<html><body>{page}</body></html>", field) == want


@pytest.mark.parametrize("lead", ['<div class="post-header">{}</div>', '<header class="entry-header">{}</header>', '<div class="articleHeader">{}</div>'])
def test_titles_in_a_lead_stay(field, lead):
    head = lead.format("<h1>Title of it</h1><p class='byline'>By someone</p>")
    page = f"<div class='site-header'><p>Brand of all</p></div><div class='post'>{head}<p>First has some words in it, and more.</p><p>Second has words.</p><div class='post tags'><a href=x>one</a><a href=y>two</a></div></div>"
    assert html_text.main_text(page, field) == "Title of it First has some words in it, and more. Second has words."


def test_scanner_is_linear(field):
    for bad in ("<a '", "<p x='", '<p x="', "<!--", "<", "</", "<svg>", "<b>"):
        start = time.time()
        html_text.main_text(bad * 60_000, field)
        assert time.time() - start < 10, bad
    long = "word " * 400_000
    assert html_text.main_text(f"<article><p>{long}</p></article>", field) == long.strip()


def test_quality(spark):
    rng = np.random.default_rng(1)
    prose = lambda: " ".join("".join(rng.choice(list("abcde"), rng.integers(2, 7))) for _ in range(rng.integers(20, 90))).capitalize() + "."
    texts = [(i, prose() if i % 3 else prose().upper().replace(" ", "!! "), 1) for i in range(600)]
    docs = spark.createDataFrame([*texts, (None, "x", 1), (1000, None, 1), (1001, "", 1), (1, texts[1][1], 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(None, 1, 0), (5, None, 0), (77777, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.train_and_score(docs, labels).collect()
    assert len(out) == 604
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    kept = [r for r in out if r["held_out"] and r["doc_id"] < 600]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in kept) > 0.97 * len(kept)
    assert quality.train_and_score(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.train_and_score(docs, labels.limit(0)).collect()} == {0.5}
