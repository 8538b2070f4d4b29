"""Pages as Markdown, and the ladder of attempts that ends with the one that gives most words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.diffs import words

#: What is never text of a page, by role, attribute, id and class; a body below so many bytes is tried once; words a body must have.
LEFT_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "form"}
LEFT_OUT_IDS = {"navbar", "sidebar", "footer", "table-of-contents", "search-bar-entry", "search-bar-entry-mobile", "page-context-menu", "pagination", "feedback-thumbs-up", "feedback-thumbs-down"}
LEFT_OUT_CLASS, LEFT_OUT_LINK = "feedback-toolbar", "#content-area"
#: The body's start and end are looked for in so many characters at either end of a page.
LEAST_BODY, LEAST_WORDS, EDGE = 5 * 1024, 50, 8192
_GONE = set("script style noscript iframe svg img picture video audio canvas template head title object map".split())
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = set("p div section article main header footer nav aside form fieldset address figure figcaption dl dt dd details summary table thead tbody tfoot tr ul ol li blockquote pre h1 h2 h3 h4 h5 h6 hr body html".split())
#: No element is ended by a later one of its kind beyond these.
_BARS = _BLOCKS - set("p dt dd li tr".split()) | {"td", "th"}
_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "del": "~~", "s": "~~"}


def selector(text: str | None) -> list[tuple[str, str, str]]:
    """(tag, id, class) of each of the simple selectors `tag`, `#id`, `.class` and their joins, divided by commas."""
    found = [re.fullmatch(r"([A-Za-z][\w-]*)?(?:#([\w-]+))?(?:\.([\w-]+))?", part.strip()) for part in (text or "").split(",") if part.strip()]
    if not all(found):
        raise ValueError(f"only tags, ids and classes can select: {text}")
    return [(m[1] or "", m[2] or "", m[3] or "") for m in found if m]


def _meets(wanted: list[tuple[str, str, str]], tag: str, own: dict[str, str]) -> bool:
    classes = own.get("class", "").split()
    return any((not t or t == tag) and (not i or i == own.get("id")) and (not c or c in classes) for t, i, c in wanted)


class _Writer(HTMLParser):
    """Markdown of what is within the roots and not left out. Blocks are written when they end; marks stand around their text."""

    def __init__(self, roots: list[tuple[str, str, str]], excluded: list[tuple[str, str, str]], main: bool):
        super().__init__(convert_charrefs=True)
        self.roots, self.excluded, self.main = roots, excluded, main
        self.open: list[tuple[str, bool, bool]] = []  # tag, whether it begins a root, whether it is left out
        self.inside, self.out_of, self.any_root = 0, 0, False
        self.lines: list[str] = []
        self.text: list[str] = []
        self.lists: list[int] = []  # numbers of the lists that are open, -1 where bulleted
        self.quotes = self.pre = 0
        self.head, self.cells, self.links = "", None, []

    def _is_root(self, tag: str, own: dict[str, str]) -> bool:
        if self.roots:
            return _meets(self.roots, tag, own)
        return self.main and (tag in ("main", "article") or own.get("role") == "main")

    def _left_out(self, tag: str, own: dict[str, str]) -> bool:
        return (
            tag in _GONE
            or own.get("role") in LEFT_OUT_ROLES
            or own.get("aria-hidden") == "true"
            or "hidden" in own
            or "data-nosnippet" in own
            or own.get("id") in LEFT_OUT_IDS
            or LEFT_OUT_CLASS in own.get("class", "").split()
            or (tag == "a" and own.get("href") == LEFT_OUT_LINK)
            or _meets(self.excluded, tag, own)
        )

    @property
    def shown(self) -> bool:
        return not self.out_of and (self.inside > 0 or not (self.roots or self.main))

    def flush(self) -> None:
        raw = "".join(self.text)
        self.text.clear()
        if self.cells is not None:
            self.cells[-1:] = [self.cells[-1] + " ".join(raw.split())] if self.cells else []
            return
        body = raw.strip("\n") if self.pre else "\n".join(" ".join(part.split()) for part in raw.split("\r")).strip()
        if body:
            lead = "  " * max(len(self.lists) - 1, 0)
            head, self.head = self.head, ""
            first = ("" if head.startswith(("#", "```")) else lead) + head
            block = first + body.replace("\n", "\n" + " " * (len(first) if self.lists else 0))
            if self.quotes:
                block = "\n".join("> " * self.quotes + line for line in block.split("\n"))
            joint = "\n" if self.lists and self.lines and not block.startswith("#") else "\n\n"
            self.lines.append((joint if self.lines else "") + block)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {k: v or "" for k, v in attrs}
        if tag in _VOID:
            if self.shown and tag == "br":
                self.text.append("\r" if not self.pre else "\n")
            elif self.shown and tag == "hr":
                self.flush()
                self.lines.append(("\n\n" if self.lines else "") + "---")
            return
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd"):
            for at in [t for t, _, _ in self.open[::-1]]:
                if at == tag or (tag in ("td", "th") and at in ("td", "th")):
                    self.handle_endtag(at)
                    break
                if at in _BARS and not (tag == "tr" and at in ("td", "th")):
                    break
        root, gone = self._is_root(tag, own), self._left_out(tag, own)
        if tag in _BLOCKS and self.shown:
            self.flush()
        self.open.append((tag, root, gone))
        self.inside, self.out_of, self.any_root = self.inside + root, self.out_of + gone, self.any_root or root
        if not self.shown:
            return
        if tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else -1)
        elif tag == "li" and self.lists:
            if self.lists[-1] >= 0:
                self.lists[-1] += 1
            self.head = "- " if self.lists[-1] < 0 else f"{self.lists[-1]}. "
        elif re.fullmatch("h[1-6]", tag):
            self.head = "#" * int(tag[1]) + " "
        elif tag == "blockquote":
            self.quotes += 1
        elif tag == "pre":
            self.pre += 1
            self.text.append("```\n")
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")
        elif tag == "a":
            self.links.append((own.get("href", ""), len(self.text)))
        elif tag in _MARKS and not self.pre:
            self.text.append(_MARKS[tag])

    def handle_endtag(self, tag: str) -> None:
        if tag not in [t for t, _, _ in self.open]:
            return
        while self.open:
            at, root, gone = self.open[-1]
            if self.shown:
                self._close(at)
            self.open.pop()
            self.inside, self.out_of = self.inside - root, self.out_of - gone
            if at == tag:
                return

    def _close(self, tag: str) -> None:
        if tag in _MARKS and not self.pre:
            body = "".join(self.text)
            mark = _MARKS[tag]
            at = body.rfind(mark)
            inner = body[at + len(mark) :] if at >= 0 else ""
            self.text[:] = [body + mark] if inner.strip() else [body[:at] + inner if at >= 0 else body]
        elif tag == "a" and self.links:
            href, at = self.links.pop()
            label = " ".join("".join(self.text[at:]).split())
            before = "".join(self.text[at:])
            pad = " " if before[:1].isspace() else ""
            self.text[at:] = [f"{pad}[{label}]({href})" if label and href else before]
        elif tag == "pre":
            self.text.append("\n```")
            self.flush()
            self.pre -= 1
        elif tag in ("td", "th"):
            self.flush()
        elif tag == "tr" and self.cells is not None:
            self.flush()
            cells, self.cells = self.cells, None
            if cells:
                row = "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
                first = not (self.lines and self.lines[-1].lstrip("\n").startswith("|"))
                self.lines.append(("\n\n" if first and self.lines else "" if first else "\n") + row)
                if first:
                    self.lines.append("\n|" + " --- |" * len(cells))
        elif tag in _BLOCKS:
            self.flush()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            elif tag == "blockquote":
                self.quotes = max(self.quotes - 1, 0)

    def handle_data(self, data: str) -> None:
        if self.shown:
            self.text.append(data)


def _written(html: str, roots: list, excluded: list, main: bool) -> tuple[str, bool]:
    writer = _Writer(roots, excluded, main)
    writer.feed(html)
    writer.close()
    for tag, _, _ in writer.open[::-1]:
        writer.handle_endtag(tag)
    writer.flush()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "".join(writer.lines))).strip(), writer.any_root


def to_markdown(html: str, root: str | None = None, exclude: str | None = None, main: bool = True) -> str:
    """A page as Markdown: within root, else within its main or article elements, else all of the body; images and boilerplate left out; three or
    more line breaks are two, runs of spaces one."""
    roots, excluded = selector(root), selector(exclude)
    out, found = _written(html, roots, excluded, main)
    return out if found or not main or roots else _written(html, [], excluded, False)[0]


def candidates(pages: DataFrame, id_col: str, html_col: str = "html", root: str | None = None, exclude: str | None = None, thresholds: tuple[int, int] = (30, 200)) -> DataFrame:
    """(id, scored, relaxed, body, body_bytes, had_root) of each page: Markdown as asked for, without the selectors, and of the whole body; the latter two
    are null where ladder() would not look at them. A null page is an empty one."""
    kind = pages.schema[id_col].dataType.simpleString()
    selector(root), selector(exclude)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for html in (h or "" for h in batch.column("html").to_pylist()):
                low = html.lower()
                begin, end = low[:EDGE].find("<body"), low.rfind("</body>", max(0, len(low) - EDGE))
                size = len((html if min(begin, end) < 0 else html[begin:end]).encode())
                scored = to_markdown(html, root, exclude)
                n, again = len(scored.split()), size >= LEAST_BODY
                relaxed = to_markdown(html) if again and root and n < thresholds[0] else None
                body = to_markdown(html, main=False) if again and not root and n < thresholds[1] else None
                rows.append((scored, relaxed, body, size, root is not None))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "scored", "relaxed", "body", "body_bytes", "had_root"])

    source = pages.select(F.col(id_col), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, f"`{id_col}` {kind}, scored string, relaxed string, body string, body_bytes long, had_root boolean")


def ladder(scored: Column, relaxed: Column, body: Column, body_bytes: Column, had_root: Column, thresholds: tuple[int, int] = (30, 200), multiplier: float = 2.0) -> Column:
    """struct(markdown, tier, words): the scored text; if it has fewer words than the first threshold and a root was asked for, the relaxed one if that
    has more; without a root and below the second threshold the body's, if it has more than LEAST_WORDS and more than multiplier times as
    many. A body of less than LEAST_BODY bytes is not tried again."""
    n, r, b = words(scored), words(relaxed), words(body)
    again = body_bytes >= LEAST_BODY
    loose = again & had_root & (n < thresholds[0]) & (r > n)
    whole = again & ~had_root & (n < thresholds[1]) & (b > n * multiplier) & (b > LEAST_WORDS)
    pick = lambda text, tier, count: F.struct(text.alias("markdown"), F.lit(tier).alias("tier"), count.alias("words"))
    return F.when(loose, pick(relaxed, "relaxed", r)).when(whole, pick(body, "body", b)).otherwise(pick(scored, "scored", n))


def extracted(pages: DataFrame, id_col: str, html_col: str = "html", root: str | None = None, exclude: str | None = None) -> DataFrame:
    """(id, markdown, tier, words) of each page, by ladder() over candidates()."""
    each = candidates(pages, id_col, html_col, root, exclude)
    found = ladder(*[F.col(c) for c in ("scored", "relaxed", "body", "body_bytes", "had_root")])
    return each.select(id_col, found.alias("f")).select(id_col, "f.*")
