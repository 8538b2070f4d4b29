"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import raw, slices

#: Elements by the part they play in a page.
INLINE = set("a abbr acronym b bdi bdo big cite code data dfn del em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is never text of the page; the first of them hold no elements but end at their end tag.
RAW = set("script style noscript iframe textarea title noembed noframes xmp".split())
HIDDEN = set("template svg math canvas object audio video map select option optgroup datalist button".split())
#: A hidden element that was left open ends before these.
_OPENERS = set("p h1 h2 h3 h4 h5 h6 article section main table ul ol blockquote pre footer header aside nav form".split())
#: Elements whose names tell a block's part, and those whose presence alone is of use.
_TAG_KIND = {"nav": "nav", "menu": "nav", "header": "head", "footer": "foot", "aside": "side", "form": "form", "fieldset": "form", "dialog": "note", "article": "main", "main": "main"}
_TELLING = set("article main section aside nav header footer form ul ol li table td th figure figcaption blockquote pre details dl dt dd h1 h2 h3 h4 h5 h6 p address".split())
#: Words in class, id and role that tell a block's part.
KEYWORDS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs sitemap skip",
    "head": "header masthead topbar banner logo branding",
    "foot": "footer foot copyright colophon legal contentinfo",
    "side": "sidebar side aside rail widget related recommended recommend recommendations popular trending complementary",
    "ad": "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted teaser",
    "note": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall dialog toast",
    "share": "share sharing social follow tags byline meta metadata author print",
    "comment": "comment comments reply replies respond disqus discussion",
    "form": "form search login contact poll survey",
    "main": "article content main post entry hentry story body text prose page",
}
#: First words of a class that only say what a page has or is filed under, and last words that only say how it is set.
MODIFIERS = set("has with no not without is are hide show tag category format status type".split())
STATES = set("open opened closed enabled disabled on off allowed layout active visible ready loaded".split())
_KIND = {word: kind for kind, words in KEYWORDS.items() for word in words.split()}

_MARK = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_STOP = re.compile(r"[=>]")
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PARTS, _CAMEL = re.compile(r"[a-z]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {tag: re.compile(rf"</{tag}(?![^\s/>])", re.IGNORECASE) for tag in RAW}
_DEPTH = 200


def tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(kind, tag, attributes, text) of the page's texts, start tags and end tags, each found in one pass over the page.

    A quote only counts after an equals sign, as browsers have it; one that nothing closes counts as a letter. A
    tag or comment that the page's end cuts off is dropped; raw elements go with all they hold.
    """
    at, n, unquoted = 0, len(page), set()
    while at < n:
        mark = _MARK.search(page, at)
        if mark is None:
            yield "text", "", "", page[at:]
            return
        if mark.start() > at:
            yield "text", "", "", page[at : mark.start()]
        comment, slash, tag = mark.groups()
        at = mark.end()
        if comment:
            end = page.find("-->", at - 2)
            at = n if end < 0 else end + 3
            continue
        if not tag:
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        begin = at
        while (stop := _STOP.search(page, at)) is not None and page[stop.start()] == "=":
            at = stop.end()
            while at < n and page[at] in " \t\n\f\r":
                at += 1
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote not in unquoted:
                end = page.find(quote, at + 1)
                if end < 0:
                    unquoted.add(quote)
                at = at if end < 0 else end + 1
        if stop is None:
            return
        at = stop.end()
        tag = tag.lower()
        if slash:
            yield "end", tag, "", ""
            continue
        yield "start", tag, page[begin : stop.start()], ""
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = n if end is None else end.start()


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    kinds: tuple[str, ...]
    link_share: float
    tag: str


@dataclass
class _Open:
    tag: str
    tags: tuple[str, ...] = field(default=())
    kinds: tuple[str, ...] = field(default=())
    hidden: bool = False


def _told(name: str) -> str:
    """The part that one class, id or role tells. Of its words those of parts that are left out go first; what only says that the page has
    such a part, or how it is set (has-sidebar, tag-social, comment-open), tells nothing; a header of the text itself is its lead."""
    words = _PARTS.findall(_CAMEL.sub("-", name).lower())
    if len(words) > 1 and (words[0] in MODIFIERS or words[-1] in STATES):
        return ""
    found = [_KIND[w] for w in words if w in _KIND]
    out = next((k for k in found if k != "main"), "")
    return "lead" if out == "head" and found[0] == "main" else out or ("main" if found else "")


def _kind(tag: str, attributes: str) -> str:
    """The part that a block element's name, classes and id tell. Where one of them tells the main part and another one that is left out
    (post tags), it is mixed: the texts within decide. An element's own name (nav, aside) goes before that."""
    if tag in ("body", "html"):
        return ""
    names = " ".join("".join(x) for x in _ATTRIBUTE.findall(attributes)).split() if attributes else ()
    found = [k for k in map(_told, names) if k]
    out, own = next((k for k in found if k != "main"), ""), _TAG_KIND.get(tag, "")
    if own and own != "main":
        return "lead" if own == "head" and out in ("", "lead") and found else out or own
    if out and out != "lead" and ("main" in found or tag == "main"):
        return "mixed"
    return out or own or ("main" if found else "")


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order: stretches of text that no block element divides, references decoded,
    white space made single, with the block elements around them and the parts that these tell, outermost first. What
    scripts, styles, comments, buttons, choices and the head's title hold is no block."""
    out: list[Block] = []
    stack = [_Open("")]
    opened: dict[str, int] = {}
    pieces: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                top = stack[-1]
                out.append(Block(text, top.tags, top.kinds, min(1.0, linked / len(text)), top.tags[-1] if top.tags else ""))
            pieces.clear()
            linked = 0

    def close(at: int) -> None:
        for gone in stack[at:]:
            opened[gone.tag] -= 1
        del stack[at:]

    for what, tag, attributes, text in tokens(page):
        if what == "text":
            if not stack[-1].hidden:
                pieces.append(text)
                if in_link:
                    linked += len(text)
            continue
        block = tag not in INLINE
        if tag == "a":
            in_link = int(what == "start")
        if tag == "br":
            pieces.append(" ")
            continue
        if block:
            flush()
        if tag in VOID:
            continue
        if what == "end":
            if opened.get(tag):
                for at in range(len(stack) - 1, 0, -1):
                    if stack[at].tag == tag:
                        close(at)
                        break
                    if not block and (stack[at].tag not in INLINE or len(stack) - at > _DEPTH):
                        break  # an inline end tag closes nothing outside its block
            continue
        if tag in _OPENERS and stack[-1].hidden:
            at = next(i for i, o in enumerate(stack) if o.hidden)
            if stack[at].tag in ("button", "select", "option"):
                close(at)
        if block and tag in ("p", "li", "td", "th", "tr", "dt", "dd"):
            while len(stack) > 1 and (stack[-1].tag in INLINE or stack[-1].tag == "p" or stack[-1].tag == tag):
                close(len(stack) - 1)
        top = stack[-1]
        tags, kinds = top.tags, top.kinds
        if block and len(tags) < _DEPTH:
            tags = (*tags, tag)
            if kind := _kind(tag, attributes):
                kinds = (*kinds, kind)
        stack.append(_Open(tag, tags, kinds, top.hidden or tag in HIDDEN or tag in RAW))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


_SENTENCE = re.compile(r"[.!?…](?:\s|$)")


def _part(kinds: tuple[str, ...]) -> str:
    return kinds[-1] if kinds else "none"


def text_features(b: Block) -> tuple[str, ...]:
    words = b.text.count(" ") + 1
    part = _part(b.kinds)
    where = part if part in ("main", "none", "mixed", "lead") else "other"
    size, ends, links = f"words:{min(6, words.bit_length())}", f"ends:{min(3, len(_SENTENCE.findall(b.text)))}", f"links:{int(b.link_share * 3.99)}"
    rights = "copyright:1" if "©" in b.text or "&copy" in b.text else "copyright:0"
    return (size, ends, links, rights, f"last:{b.text[-1] in '.!?…:;'}", f"{where} {size}", f"{where} {links}", f"{where} {rights}", f"{where} {ends}", f"{where} {b.tag} {links}")


def place_features(b: Block) -> tuple[str, ...]:
    part = _part(b.kinds)
    inside = "main" if "main" in b.kinds[:-1] else "other" if b.kinds[:-1] else "none"
    marked = part not in ("main", "none", "mixed", "lead")
    return (
        *{f"in:{t}" for t in b.tags if t in _TELLING}, *{f"kind:{k}" for k in b.kinds}, f"tag:{b.tag if b.tag in _TELLING else 'other'}", f"part:{part}", f"part:{part} in {inside}",
        f"marked:{marked}", f"{b.tag if b.tag in _TELLING else 'other'} in {part}",
    )


@dataclass
class Field:
    """Weights of a chain with labels 0 (left out) and 1 (main text)."""

    weights: dict[str, float]  # for label 1 against 0
    start: np.ndarray
    moves: np.ndarray

    def decode(self, page: list[Block], memory: dict | None = None) -> list[int]:
        """Viterbi: the most likely labels of the page's blocks together."""
        if not page:
            return []
        memory = {} if memory is None else memory
        get = self.weights.get
        (m00, m01), (m10, m11) = self.moves.tolist()
        back: list[tuple[int, int]] = []
        a, b = self.start.tolist()
        for i, block in enumerate(page):
            place = block.tags, block.kinds
            if (e := memory.get(place)) is None:
                if len(memory) > 20_000:
                    memory.clear()
                e = memory[place] = sum(get(f, 0.0) for f in place_features(block))
            e += sum(get(f, 0.0) for f in text_features(block))
            if i:
                from_a, from_b = (0 if a + m00 >= b + m10 else 1), (0 if a + m01 >= b + m11 else 1)
                back.append((from_a, from_b))
                a, b = max(a + m00, b + m10), max(a + m01, b + m11)
            b += e
        label = int(b > a)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 150, rate: float = 0.15, ridge: float = 0.01) -> Field:
    """Maximum likelihood with a ridge: forward-backward over all pages at once, Adam steps."""
    pages = [p for p in pages if p[0]]
    names = sorted({f for page, _ in pages for b in page for f in (*place_features(b), *text_features(b))})
    index = {f: i for i, f in enumerate(names)}
    longest = max(len(p) for p, _ in pages)
    n, d = len(pages), len(names)
    x = np.zeros((n, longest, d), np.float32)
    y, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (page, labels) in enumerate(pages):
        for t, b in enumerate(page):
            for f in (*place_features(b), *text_features(b)):
                x[i, t, index[f]] = 1
        y[i, : len(page)], mask[i, : len(page)] = labels, True
    theta = np.zeros(d + 2 + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    both = mask[:, 1:]
    seen = np.array([[(both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    for step in range(1, rounds + 1):
        w, s, m = theta[:d], theta[d : d + 2], theta[d + 2 :].reshape(2, 2)
        e = np.zeros((n, longest, 2))
        e[:, :, 1] = x @ w
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + s
        for t in range(1, longest):
            alpha[:, t] = np.where(mask[:, t, None], np.logaddexp(alpha[:, t - 1, :1] + m[0], alpha[:, t - 1, 1:] + m[1]) + e[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = e[:, t + 1] + beta[:, t + 1]
            beta[:, t] = np.where(mask[:, t + 1, None], np.logaddexp(m[:, 0] + ahead[:, :1], m[:, 1] + ahead[:, 1:]), beta[:, t + 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        pair = np.exp(alpha[:, :-1, :, None] + m + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        gradient = np.concatenate((np.einsum("nt,ntd->d", (y * mask - p[:, :, 1]).astype(np.float32), x), np.bincount(y[:, 0], minlength=2) - p[:, 0].sum(0), (seen - pair.sum((0, 1))).ravel()))
        gradient = gradient / n - ridge * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(dict(zip(names, theta[:d].tolist(), strict=True)), theta[d : d + 2], theta[d + 2 :].reshape(2, 2))


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[str, dict[str, int]]]:
    """Pages of varied layouts with the label of each block's text, made by rule: the labelled set to learn from.

    The article stands in a marked element, in a plain one, or in none; what is left out stands before, behind and
    inside it, marked or told only by its links and its place. Some elements of the article have classes that tell other parts too.
    """
    rng = random.Random(seed)
    serial = iter(range(10**9))
    pick = rng.choice

    def prose(sentences: int) -> str:
        word = lambda: "".join(rng.choices(["an", "to", "re", "ils", "or", "e", "um", "ka", "ti", "sé"], k=rng.randint(1, 3)))
        end = lambda: pick([".", ".", ".", "?", "!", ". &&&"])
        return " ".join(" ".join(word() for _ in range(rng.randint(4, 16))).capitalize() + f" x{next(serial)}{end()}" for _ in range(sentences)).replace("&&&", "")

    def phrase() -> str:
        return prose(1).rstrip(".?! ").split(" ", 1)[-1][-30:] + f" y{next(serial)}"

    out = []
    for _ in range(n):
        labels: dict[str, int] = {}

        def say(text: str, label: int, labels=labels) -> str:
            labels[" ".join(text.split())] = label
            return text

        def element(tag: str, cls: str, inner: str) -> str:
            return f'<{tag} {pick(["class", "class", "id"])}="{cls}">{inner}</{tag}>' if cls else f"<{tag}>{inner}</{tag}>"

        link = lambda: f'<a href="/">{say(phrase(), 0)}</a>'
        links = lambda k: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(k)) + "</ul>"
        row = lambda k: "".join(f"<div>{link()}</div>" for _ in range(k))
        words = lambda label, tag="p": f"<{tag}>{say(prose(rng.randint(1, 3)), label)}</{tag}>"
        junk = {
            "nav": lambda: element(*pick([("nav", ""), ("div", "menu"), ("nav", "main-nav"), ("div", "breadcrumbs"), ("ul", "nav"), ("div", "toc")]), pick([links, row])(rng.randint(2, 8))),
            "header": lambda: element(*pick([("header", ""), ("div", "site-header"), ("div", "topbar"), ("div", "masthead")]), pick(["<div>{}</div>", "<h2>{}</h2>", "<p>{}</p>", "<h1>{}</h1>", "{}"]).format(say(phrase(), 0))),
            "ad": lambda: element(pick(["div", "section", "aside", "p"]), pick(["ad", "ads", "sponsored", "promo-box", "advert", "ad-slot"]), say(prose(rng.randint(1, 3)), 0)),
            "side": lambda: element(*pick([("aside", ""), ("aside", "pull"), ("div", "sidebar"), ("div", "related"), ("section", "recommended")]), f"<h3>{say(phrase(), 0)}</h3>" + pick([links(3), words(0), say(prose(1), 0)])),
            "note": lambda: element(pick(["div", "section", "p"]), pick(["cookie-notice", "notice", "newsletter", "alert", "subscribe-box", "paywall"]), say(prose(rng.randint(1, 2)), 0)),
            "form": lambda: f"<form><label>{say(phrase(), 0)}</label><input>{pick(['', words(0)])}<button>Go</button></form>",
            "share": lambda: element(pick(["div", "p", "ul"]), pick(["share", "social-links", "byline", "post-meta", "tags"]), pick([links(2), say(phrase(), 0)])),
            "comments": lambda: element(*pick([("section", "comments"), ("div", "comment-list"), ("ol", "comments"), ("div", "disqus")]), f"<h3>{say(phrase(), 0)}</h3>" + "".join(f'<div class="comment">{words(0)}</div>' for _ in range(rng.randint(1, 5)))),
            "footer": lambda: element(*pick([("footer", ""), ("div", "footer"), ("div", "site-footer")]), pick(["<p>", ""]) + say(pick(["© ", ""]) + prose(rng.randint(1, 2)), 0)),
            "plain-nav": lambda: element(pick(["div", "ul", "table"]), "", pick([links, row])(rng.randint(3, 8))),
            "plain-footer": lambda: element(pick(["div", "p"]), "", say("© " + phrase(), 0)),
            "mixed": lambda: element(pick(["div", "ul", "section"]), pick(["post tags", "content related", "entry share", "post nav", "story promo"]), pick([links, row])(rng.randint(2, 5))),
        }
        some = lambda names, p: "".join(junk[k]() for k in names if rng.random() < p)
        inside = ["ad", "side", "note", "form", "share", "nav"]
        shapes = ["<p>{}</p>"] * 6 + ["<p><b>{}</b></p>", "<p><b>{}<br>", "<p>{}", "<h2>{}</h2>", "<h3>{}</h3>", "<ul><li>{}</li></ul>", "<ol><li>{}</ol>", "<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>"]
        shapes += ["<table><tr><td>{}</td></tr></table>", "<div>{}</div>", "<section><p>{}</p></section>", "<figure><img><figcaption>{}</figcaption></figure>", "<dl><dt>{}</dt></dl>", "<details><p>{}</p></details>", '<p><a href="/x">{}</a></p>', "{}<br>", '<div class="wrap"><p>{}</p></div>']
        body = []
        for _ in range(rng.randint(1, 12)):
            shape = pick(shapes)
            short = shape.startswith(("<h", "<dl")) or rng.random() < 0.15
            text = say(phrase() if short else prose(rng.randint(1, 6)), 1)
            if not short and rng.random() < 0.25:  # words of a paragraph that are a link
                cut = text.rfind(" ", 0, rng.randint(len(text) // 2, len(text)))
                at = text.rfind(" ", 0, max(cut - rng.randint(4, 60), 0)) + 1
                text = text[:at] + '<a href="/y">' + text[at:cut] + "</a>" + text[cut:] if at < cut else text
            body.append(shape.format(text))
            if rng.random() < 0.12:
                body.append(junk[pick(inside)]())
        title = pick([f"<h1>{say(phrase(), 1)}</h1>", f"<h1>{say(phrase(), 1)}</h1>", ""])
        layout = rng.random()
        if layout < 0.3 and title:
            byline = element(pick(["p", "div", "span"]), pick(["byline", "entry-meta", "author"]), say(pick(["", prose(1)]) + phrase(), 0)) if rng.random() < 0.4 else ""
            title = element(*pick([("header", ""), ("header", "entry-header"), ("div", "post-header"), ("div", "article-header"), ("div", "entry-header")]), title + byline)
        main = title + "".join(body) + some(["share", "comments", "side", "footer", "mixed"], 0.12)
        if layout < 0.45:
            cls = pick(["post", "content", "entry-content", "story", "article-body", "post hentry", "site-main"])
            if rng.random() < 0.4:  # further classes that tell other parts
                also = [pick(["tags", "meta", "print", "notice", "poll", "logo-left", "author-page", "page-popular", "sidebar-right", "social", "comment", "promo", "header-top", "ad-free"]) for _ in range(rng.randint(1, 2))]
                cls = " ".join(rng.sample([cls, *also], 1 + len(also)))
            main = element(*pick([("article", ""), ("article", cls), ("main", ""), ("main", cls), ("div", cls), ("div", cls), ("section", cls)]), main)
        elif layout < 0.7:
            main = element(pick(["div", "div", "section", "td"]), pick(["", "", "wrap", "col-8"]), main)
        marked = ["header", "nav", "note", "ad", "side"]
        if layout < 0.85:
            page = some(marked, 0.45) + main + some(["comments", "side", "ad", "form", "nav"], 0.3) + some(["footer"], 0.8)
        else:  # little or nothing is marked
            page = some(["plain-nav"], 0.7) + some(["header"], 0.2) + main + some(["plain-nav"], 0.3) + some(["plain-footer"], 0.6)
        if rng.random() < 0.25:
            page = element(pick(["div", "main"]), pick(["page", "wrapper", "content", "main"]), page)
        out.append((f"<html><head><title>t</title><style>p{{}}</style></head><body>{page}</body></html>", labels))
    return out


def trained(n_pages: int = 400) -> Field:
    made = []
    for page, labels in labelled_pages(n_pages):
        found = [b for b in blocks(page) if b.text in labels]
        made.append((found, [labels[b.text] for b in found]))
    return train(made)


def main_text(page: str, model: Field, memory: dict | None = None) -> str:
    found = blocks(page)
    return " ".join(b.text for b, keep in zip(found, model.decode(found, memory), strict=True) if keep)


def extract(pages: DataFrame, model: Field | None = None, html_col: str = "html") -> DataFrame:
    """pages with the columns text and n_chars (code points) instead of html, for each row.

    The whole html is read; null or empty html, and pages without main text, give the empty text. A page cut
    off anywhere is read up to there. Repeated rows and null keys make no difference; columns named text or n_chars
    that pages may have are replaced, other columns stay. An empty table gives no rows.
    """
    model = model or trained()
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    source = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(p.decode(), model, memory) for p in raw(part.column("html"))]
                columns = [part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*kept, "text", "n_chars"])

    schema = source.drop("html").schema.add("text", "string").add("n_chars", "long")
    return source.mapInArrow(run, schema)
