"""Sections of Markdown and symbols of source code. Ids name one row each; null texts have no rows. White space is ASCII white space."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from millrace.functions import records as C

#: A leading block between lines of three hyphens; the second may go on after them.
FRONTMATTER = r"^---\n[\s\S]*?\n---[^\n]*\n?"
#: Bytes above which a symbol is cut, bytes of a piece, and lines that are searched for a symbol's end.
MOST_BYTES, PIECE_BYTES, SCAN_LINES = 6000, 3000, 4000
LEVELS = range(1, 7)

_MODIFIERS = "(?:export default |export |declare |abstract )*"
_KEYWORDS = "pub fn |fn |def |class |struct |enum |impl |async function |function |interface |type "
_ASSIGNED = r"(?:const|let|var) (?=[A-Za-z0-9_$]+[\s\S]*(?:=>|function|React\.FC))"
#: A line that opens a symbol; its name is what follows, up to a character that no name holds.
SYMBOL = rf"^\s*{_MODIFIERS}(?:pub |pub\(crate\) |pub\(super\) )?(?:{_KEYWORDS}|{_ASSIGNED})"
_NAME = r"([\p{L}\p{N}_]*)"


def numbered(docs: DataFrame, id_col: str, text_col: str, *carry: str) -> tuple[DataFrame, Window]:
    """(id, carried columns, at, line, byte, total) of each line, and the window of a text's lines: `byte` is where the line begins, `total`
    the bytes of the text. Texts are dealt by id once; everything that goes by this window or by id needs no further shuffle."""
    w = Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    each = docs.select(id_col, *carry, F.octet_length(text_col).alias("total"), F.posexplode(F.split(text_col, "\n", -1)).alias("at", "line"))
    return each.withColumn("byte", F.sum(F.octet_length("line") + 1).over(w) - F.octet_length("line") - 1), w


def _joined(condition: Column | None = None) -> Column:
    """The lines of a group in order, as one text."""
    line = F.struct("at", "line")
    kept = F.collect_list(line if condition is None else F.when(condition, line))
    return F.array_join(F.transform(F.array_sort(kept), lambda x: x["line"]), "\n")


def _span() -> list[Column]:
    return [
        (F.min("at") + 1).cast("long").alias("line_start"),
        (F.max(F.when((F.col("byte") < F.col("total")) | (F.col("at") == 0), F.col("at"))) + 1).cast("long").alias("line_end"),
        F.min("byte").alias("byte_start"),
        F.least(F.max(F.col("byte") + F.octet_length("line") + 1), F.first("total")).cast("long").alias("byte_end"),
    ]


def markdown_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, kind, level, title, heading_path, fence_language, content, line_start, line_end, byte_start, byte_end).

    A frontmatter block is section -1; what stands before the first heading is section 0; each ATX heading outside fences starts another.
    Lines of three backquotes or tildes open and close fences, whichever opened. heading_path names the headings above a section and its
    own: a heading takes the place of those of its level and below. Sections of white space alone are left out."""
    front = F.regexp_extract(text_col, FRONTMATTER, 0)
    n_front = F.when(front == "", 0).otherwise(F.size(F.split(front, "\n", -1)) - F.when(front.endswith("\n"), 1).otherwise(0))
    each, w = numbered(docs.withColumn("n_front", n_front), id_col, text_col, "n_front")
    body, bare = F.col("at") >= F.col("n_front"), F.regexp_replace("line", r"^\s+|\r+\z", "")
    fence = body & F.col("line").rlike(r"^\s*(?:```|~~~)")
    marked = each.select("*", bare.alias("bare"), body.alias("body"), fence.alias("fence"), F.sum(fence.cast("int")).over(w).alias("fences"))
    heading = F.col("body") & ~F.col("fence") & (F.col("fences") % 2 == 0) & F.col("bare").rlike(r"^#{1,6}(?:[ \t]|\z)")
    marked = marked.withColumn("level", F.when(heading, F.length(F.regexp_extract("bare", "^#+", 0))))
    title = C.trimmed(F.regexp_replace(C.trimmed(F.regexp_replace("bare", "^#+", "")), r"#+\z", ""))
    marked = marked.withColumn("title", F.when(F.col("level").isNotNull(), title))
    last = [F.max(F.when(F.col("level") == n, F.struct("at", "title"))).over(w).alias(f"last{n}") for n in LEVELS]
    placed = marked.select("*", F.when(F.col("body"), F.count("level").over(w)).otherwise(-1).alias("section"), *last)
    # the last heading of a level stands as long as none of a smaller level came after it
    above = [F.greatest(F.lit(-1), F.lit(-1), *[F.col(f"last{m}.at") for m in range(1, n)]) for n in LEVELS]
    path = F.filter(F.array(*[F.when(F.col(f"last{n}.at") > a, F.col(f"last{n}.title")) for n, a in zip(LEVELS, above, strict=True)]), lambda t: t.isNotNull())
    label = C.trimmed(F.regexp_extract("line", r"^\s*(?:```|~~~)(.*)", 1))
    head = F.max(F.when(F.col("level").isNotNull(), F.struct("level", "title", path.alias("path"))))
    found = placed.groupBy(id_col, "section").agg(
        F.when(F.col("section") < 0, "frontmatter").otherwise("section").alias("kind"),
        head["level"].alias("level"),
        head["title"].alias("title"),
        F.coalesce(head["path"], F.array().cast("array<string>")).alias("heading_path"),
        F.min(F.when(F.col("body") & (label != ""), F.struct("at", label.alias("label"))))["label"].alias("fence_language"),
        C.trimmed(_joined()).alias("content"),
        *_span(),
    )
    return found.where(F.col("content") != "")


def heading_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, level, heading, anchor, heading_path) of each ATX heading, fences or not.

    heading_path keeps the first level - 1 names of the path before it and adds its own, so a heading that leaves out levels stands no deeper
    than one below the last. Only headings are shuffled."""
    each = docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("at", "line"))
    each = each.where(F.col("line").rlike(r"^\s*#{1,6}(?!#)\s*\S"))
    rest = F.regexp_replace("line", r"^\s*#+", "")
    named = each.select(id_col, "at", F.length(F.regexp_extract("line", r"^\s*(#+)", 1)).alias("level"), C.trimmed(F.regexp_replace(C.trimmed(rest), r"#+\z", "")).alias("heading"))
    w = Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counted = named.withColumn("k", F.count("*").over(w))
    # depth = min(depth before, level - 1) + 1, which is a running minimum of level - k, moved back
    deep = counted.withColumn("depth", F.least("k", F.col("k") + F.min(F.col("level") - F.col("k")).over(w)))
    last = [F.max(F.when(F.col("depth") == n, F.struct("at", "heading"))).over(w)["heading"].alias(f"last{n}") for n in LEVELS]
    anchor = F.regexp_replace(F.regexp_replace(F.lower("heading"), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")
    placed = deep.select("*", *last)
    return placed.select(
        id_col, (F.col("at") + 1).cast("long").alias("line"), "level", "heading", anchor.alias("anchor"), F.slice(F.array(*[F.col(f"last{n}") for n in LEVELS]), F.lit(1), F.col("depth").cast("int")).alias("heading_path")
    )


def symbol_kind(content: Column) -> Column:
    first = F.regexp_replace(F.regexp_extract(content, r"^\s*([^\n]*)", 1), rf"^{_MODIFIERS}(?:pub |pub\(crate\) |pub\(super\) )?", "")
    return (
        F.when(first.rlike(rf"^(?:pub fn |fn |def |async function |function |{_ASSIGNED})"), "function")
        .when(first.rlike("^(?:class |interface |type |struct )"), "type")
        .when(first.startswith("enum "), "enum")
        .when(first.startswith("impl "), "impl")
        .otherwise("symbol")
    )


def pieces(content: Column) -> Column:
    """array<struct<part, line, byte, bytes, content>> of a text: itself as part null if it has at most MOST_BYTES, else windows of whole lines of at
    most PIECE_BYTES, or one longer line; windows of white space alone are counted but left out."""
    lines = F.split(content, "\n", -1)
    sizes = F.transform(lines, lambda x, i: F.octet_length(x) + F.when(i < F.size(lines) - 1, 1).otherwise(0))
    begin = F.struct(F.lit(0).alias("from_line"), F.lit(0).alias("from_byte"), F.lit(0).alias("line"), F.lit(0).alias("byte"), F.array().cast("array<struct<line:int,n:int,byte:int,bytes:int>>").alias("done"))

    def cut(s: Column) -> Column:
        return F.concat(s["done"], F.array(F.struct(s["from_line"].alias("line"), (s["line"] - s["from_line"]).alias("n"), s["from_byte"].alias("byte"), (s["byte"] - s["from_byte"]).alias("bytes"))))

    def step(s: Column, size: Column) -> Column:
        full = (s["byte"] + size - s["from_byte"] > PIECE_BYTES) & (s["byte"] > s["from_byte"])
        return F.struct(
            F.when(full, s["line"]).otherwise(s["from_line"]).alias("from_line"),
            F.when(full, s["byte"]).otherwise(s["from_byte"]).alias("from_byte"),
            (s["line"] + 1).alias("line"),
            (s["byte"] + size).alias("byte"),
            F.when(full, cut(s)).otherwise(s["done"]).alias("done"),
        )

    windows = F.aggregate(sizes, begin, step, cut)
    text = lambda x: C.trimmed(F.array_join(F.slice(lines, x["line"] + 1, x["n"]), "\n"))
    cuts = F.transform(windows, lambda x, i: F.struct(i.alias("part"), x["line"].alias("line"), x["byte"].alias("byte"), x["bytes"].alias("bytes"), text(x).alias("content")))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("part"), F.lit(0).alias("line"), F.lit(0).alias("byte"), F.octet_length(content).alias("bytes"), content.alias("content")))
    return F.when(F.octet_length(content) <= MOST_BYTES, whole).otherwise(F.filter(cuts, lambda x: x["content"] != ""))


def _by_lines(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, language, is_test, symbol, original_path, raw, content, line_start, byte_start, byte_end): a chunk for each symbol line up to the next."""
    each, w = numbered(files, id_col, text_col, "language", "is_test")
    whole, trim = Window.partitionBy(id_col).orderBy("at"), C.trimmed(F.col("line"))
    divider = F.coalesce(trim.rlike(r"^[=-]{8,}\z"), F.lit(False))
    each = each.select("*", divider.alias("divider"), F.regexp_extract(trim, r"^File: \s*(\S[\s\S]*)", 1).alias("path"))
    beside = F.coalesce(F.lag("divider").over(whole), F.lit(False)) | F.coalesce(F.lead("divider").over(whole), F.lit(False))
    each = each.withColumn("marker", (F.col("path") != "") & beside)
    each = each.select("*", F.sum(F.col("marker").cast("int")).over(w).alias("file"), F.coalesce(F.lag("marker").over(whole), F.lit(False)).alias("after_marker"))
    inside = (F.col("file") > 0) & ~F.col("marker") & ~(F.col("after_marker") & F.col("divider"))
    by_file, by_id = Window.partitionBy(id_col, "file"), Window.partitionBy(id_col)
    each = each.select(
        "*",
        F.max("path").over(by_file).alias("names"),
        F.max(F.when(F.col("marker"), F.col("path"))).over(by_file).alias("original_path"),
        F.max(F.when(inside & ~F.col("divider") & (trim != ""), F.col("at"))).over(by_file).alias("solid"),
    )
    packed = F.coalesce(inside & (F.col("at") <= F.col("solid")), F.lit(False))
    each = each.withColumn("packed", packed).withColumn("any_packed", F.max("packed").over(by_id))
    # texts of packed files are read file by file; others as one, as are those whose packed files are all empty
    kept = each.where(F.col("packed") | ~F.col("any_packed")).select(
        id_col, "language", "is_test", "at", "line", "byte", "total", F.when(F.col("any_packed"), F.col("file")).otherwise(0).alias("file"), F.when(F.col("any_packed"), F.col("original_path")).alias("original_path")
    )
    starts = F.col("line").rlike(SYMBOL)
    of_file = Window.partitionBy(id_col, "file")
    kept = kept.select("*", starts.alias("starts"), F.sum(starts.cast("int")).over(Window.partitionBy(id_col, "file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).alias("chunk"), F.max(starts).over(of_file).alias("has_symbols"))
    found = kept.where((F.col("chunk") > 0) | ~F.col("has_symbols")).groupBy(id_col, "file", "chunk").agg(
        F.first("language").alias("language"),
        F.first("is_test").alias("is_test"),
        F.first("original_path").alias("original_path"),
        F.max(F.when(F.col("starts"), F.regexp_extract("line", SYMBOL + _NAME, 1))).alias("symbol"),
        _joined().alias("raw"),
        *_span(),
    )
    return found.withColumn("content", C.trimmed(F.col("raw"))).where(F.col("content") != "").drop("file", "chunk")


def code_chunks(files: DataFrame, facts: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """(id, symbol, kind, original_path, language, is_test, chunk_source, parse_status, extraction_status, content, line_start, byte_start, byte_end).

    Where facts (id, name, line_start, line_end, parser_method) name symbols of a file, each is a chunk. Else lines that look like the start of a
    symbol cut the text; what stands before the first is no chunk; a text without any is one chunk. A text that packs files (`File: ` beside a
    divider) is read file by file. Chunks above MOST_BYTES become windows of PIECE_BYTES. byte_end is where the chunk's white space ends."""
    own = files.select(id_col, F.col(text_col).alias("text"), C.language(F.col(path_col)).alias("language"), C.is_test(F.col(path_col)).alias("is_test"))
    if facts is None:
        found = _by_lines(own, id_col, "text").withColumn("parser_method", F.lit(None).cast("string"))
    else:
        ends = F.greatest("line_start", F.coalesce("line_end", "line_start"))
        known = facts.select(id_col, F.col("name").alias("symbol"), F.col("line_start").cast("int").alias("s"), ends.cast("int").alias("e"), "parser_method").where("s >= 1")
        lines = F.filter(F.split("text", r"(?<=\n)", -1), lambda x: x != "")
        cut = own.join(known, id_col).where(F.size(lines) >= F.col("e")).select("*", F.array_join(F.slice(lines, F.lit(1), F.col("s") - 1), "").alias("before"), F.array_join(F.slice(lines, F.col("s"), F.col("e") - F.col("s") + 1), "").alias("content"))
        start = F.octet_length("before").cast("long")
        with_facts = cut.where("content <> ''").select(
            id_col, "language", "is_test", F.lit(None).cast("string").alias("original_path"), "symbol", F.col("content").alias("raw"), F.col("s").cast("long").alias("line_start"), F.col("e").cast("long").alias("line_end"), start.alias("byte_start"), (start + F.octet_length("content")).alias("byte_end"), "content", "parser_method"
        )
        rest = own.join(with_facts.select(id_col).distinct(), id_col, "left_anti")
        found = with_facts.unionByName(_by_lines(rest, id_col, "text").withColumn("parser_method", F.lit(None).cast("string")))
    method = F.lower("parser_method")
    names = ("source", "parse", "extraction")
    says = lambda *values: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)])
    status = (
        F.when(method.contains("unsupported"), says("line_window", "unsupported", "unsupported"))
        .when(method.rlike("fallback|heuristic|regex|line_scan"), says("heuristic_symbol", "fallback", "fallback"))
        .when(method.isNotNull(), says("ast_symbol", "parsed", "parsed"))
        .when(F.col("symbol").isNotNull(), says("heuristic_symbol", "fallback", "fallback"))
        .when(F.col("language") == "unknown", says("line_window", "unsupported", "unsupported"))
        .otherwise(says("line_window", "fallback", "none"))
    )
    lead = F.when(F.col("parser_method").isNull(), F.regexp_extract("raw", r"^[ \t\r\n]*", 0)).otherwise("")
    cut = found.select("*", status.alias("status"), lead.alias("lead"), F.explode(pieces(F.col("content"))).alias("p"))
    part, whole = F.col("p.part"), F.col("p.part").isNull()
    return cut.select(
        id_col,
        F.when(whole | F.col("symbol").isNull(), F.col("symbol")).otherwise(F.concat("symbol", F.lit("#part"), part)).alias("symbol"),
        symbol_kind(F.col("p.content")).alias("kind"),
        "original_path",
        "language",
        "is_test",
        F.when(whole, F.col("status.source")).otherwise("line_window").alias("chunk_source"),
        F.when(whole, F.col("status.parse")).otherwise("partial").alias("parse_status"),
        F.when(whole, F.col("status.extraction")).otherwise("fallback").alias("extraction_status"),
        F.col("p.content").alias("content"),
        F.when(whole, F.col("line_start")).otherwise(F.col("line_start") + F.size(F.split("lead", "\n", -1)) - 1 + F.col("p.line")).cast("long").alias("line_start"),
        F.when(whole, F.col("byte_start")).otherwise(F.col("byte_start") + F.octet_length("lead") + F.col("p.byte")).cast("long").alias("byte_start"),
        F.when(whole, F.col("byte_end")).otherwise(F.col("byte_start") + F.octet_length("lead") + F.col("p.byte") + F.col("p.bytes")).cast("long").alias("byte_end"),
    )


_IDENT, _EXPORTED = "([A-Za-z0-9_$]*)", "^(?:declare |abstract )*export "
#: The kind that each keyword declares.
RUST_KINDS = {"struct": "struct", "enum": "enum", "trait": "trait", "fn": "function", "async fn": "function"}
PYTHON_KINDS = {"class": "class", "def": "function"}
SCRIPT_KINDS = {"async function": "function", "function": "function", "class": "class", "interface": "interface", "type": "type", "enum": "enum"}
#: How lines begin that hold a comment or a string.
NO_CODE = ["//", "#", "/*", "*", '"', "'", 'r#"', 'r"']


def _declared(line: Column, head: str, kinds: dict[str, str], language: Column, public: Column | None) -> Column:
    """struct(language, kind, name, visibility) of a line that declares one of kinds after head; null of others."""
    pattern = rf"^{head}({'|'.join(sorted(kinds, key=len, reverse=True))}) {_IDENT}"
    word, name = F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)
    kind = F.lit(None).cast("string")
    for k, v in kinds.items():
        kind = F.when(word == k, v).otherwise(kind)
    seen = ~name.startswith("_") if public is None else public
    return F.when(line.rlike(pattern), F.struct(language.alias("language"), kind.alias("kind"), name.alias("name"), F.when(seen, "public").otherwise("private").alias("visibility")))


def declaration(line: Column, script: Column) -> Column:
    """struct(language, kind, name, visibility) of a line without its indent, or null: declarations of Rust and Python in any file, of JavaScript
    and TypeScript where script names one of them."""
    out = F.coalesce(
        _declared(line, "(?:pub )?", RUST_KINDS, F.lit("rust"), line.startswith("pub ")),
        F.when(script.isNotNull(), F.coalesce(_declared(line, _MODIFIERS, SCRIPT_KINDS, script, line.rlike(_EXPORTED)), _assigned(line, script))),
        _declared(line, "", PYTHON_KINDS, F.lit("python"), None),
    )
    comment = F.lit(False)
    for start in NO_CODE:
        comment |= line.startswith(start)
    return F.when(~comment, out)


def _assigned(line: Column, script: Column) -> Column:
    pattern = rf"^{_MODIFIERS}(?:const|let|var) ([A-Za-z0-9_$]+)([\s\S]*)"
    made = F.regexp_extract(line, pattern, 2).rlike(r"=>|function|React\.FC")
    return F.when(line.rlike(pattern), F.struct(script.alias("language"), F.when(made, "function").otherwise("constant").alias("kind"), F.regexp_extract(line, pattern, 1).alias("name"), F.when(line.rlike(_EXPORTED), "public").otherwise("private").alias("visibility")))


#: How a line without its indent must begin to declare anything.
_MAY_DECLARE = rf"^(?:pub )?{_MODIFIERS}(?:{'|'.join(sorted({*RUST_KINDS, *PYTHON_KINDS, *SCRIPT_KINDS}, key=len, reverse=True))}|const|let|var) "


def _extents(*arrays: pa.Array) -> tuple[list[int], list[int], list[str | None]]:
    """Of one file: the last line of each declaration (-1 if its braces stay open), the number of lines, and the names of parents.

    The line where the indent goes back is found for all lines in one pass; braces are added up once, and a search stops where they close."""
    indent, blank, opens, closes, at, closed, language, name = (x.to_pylist() for x in arrays)
    n, ends, parents, stack = len(indent), [], [], []
    back, last, waiting = [n] * n, [], []
    if "python" in language:
        for i in range(n):
            if not blank[i]:
                while waiting and indent[i] <= indent[waiting[-1]]:
                    back[waiting.pop()] = i
                waiting.append(i)
            last.append(i if not blank[i] else last[-1] if last else -1)
    seen, depth = ([0, *accumulate(x)] for x in (opens, (o - c for o, c in zip(opens, closes, strict=True))))
    falls = [i for i, (o, c) in enumerate(zip(opens, closes, strict=True)) if c > o]
    for i, done, spoken, own in zip(at, closed, language, name, strict=True):
        limit = min(n, i + SCAN_LINES)
        if spoken == "python":
            ends.append(last[min(back[i], limit) - 1])
        elif done:
            ends.append(i)
        else:
            first = bisect_right(seen, seen[i]) - 1
            later = (falls[k] for k in range(bisect_right(falls, first), len(falls)))
            end = next((y for y in chain([first], later) if y >= limit or depth[y + 1] <= depth[i]), n)
            ends.append(end if end < limit else -1)
        while stack and stack[-1][0] >= indent[i]:
            stack.pop()
        parents.append(stack[-1][1] if stack else None)
        stack.append((indent[i], own))
    return ends, [n] * len(at), parents


def code_symbols(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """(id, line_start, line_end, name, language, kind, visibility, parent, truncated) of each declaration.

    Bodies end where their braces close (Rust, JavaScript, TypeScript; braces in strings and line comments do not count) or where the indent goes
    back (Python), within SCAN_LINES lines; truncated says that the file goes on where the search ended. parent is the last declaration
    before it with a smaller indent. All of it happens in the row of the file: nothing is shuffled, and time grows with its lines."""
    low = F.lower(path_col)
    script = F.when(low.rlike(r"\.(?:ts|tsx|mts|cts)\z"), "typescript").when(low.rlike(r"\.(?:js|jsx|mjs|cjs)\z"), "javascript")
    lines = F.split(F.regexp_replace(F.regexp_replace(text_col, r"\r\n", "\n"), r"\n\z", ""), "\n", -1)

    def read_once(line: Column) -> Column:
        code = F.regexp_replace(line, r""""(?:[^"\\]|\\.)*"|'[{}]'|//.*""", "")
        return F.struct(line.alias("line"), F.regexp_replace(line, r"^\s+", "").alias("bare"), F.when(line.contains("{") | line.contains("}"), code).otherwise("").alias("code"))

    def facts(x: Column, i: Column) -> Column:
        line = x["line"]
        count = lambda c: F.length(x["code"]) - F.length(F.replace(x["code"], F.lit(c), F.lit("")))
        return F.struct(
            i.alias("i"),
            F.length(F.regexp_extract(line, r"^[ \t]*", 0)).alias("indent"),
            (C.trimmed(line) == "").alias("blank"),
            count("{").alias("opens"),
            count("}").alias("closes"),
            (~line.contains("{") & line.contains(";") & line.rlike(r";\s*\z")).alias("closed"),
            F.when(x["bare"].rlike(_MAY_DECLARE), declaration(x["bare"], F.col("script"))).alias("d"),
        )

    read = files.select(id_col, script.alias("script"), lines.alias("lines")).withColumn("rows", F.transform(F.transform("lines", read_once), facts))
    read = read.select(id_col, "rows", F.filter("rows", lambda x: x["d"].isNotNull()).alias("declared"))
    arrays = {"indent": "rows.indent", "blank": "rows.blank", "opens": "rows.opens", "closes": "rows.closes", "at": "declared.i", "closed": "declared.closed", "language": "declared.d.language", "name": "declared.d.name"}
    asked = read.select(id_col, "declared", *[F.col(v).alias(k) for k, v in arrays.items()])
    shape = S.StructType([asked.schema[id_col], asked.schema["declared"], *[S.StructField(k, S.ArrayType(t)) for k, t in (("end", S.IntegerType()), ("n", S.IntegerType()), ("parent", S.StringType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_extents(*[batch.column(k)[r].values for k in arrays]) if batch.column("indent")[r].is_valid else (None, None, None) for r in range(batch.num_rows)]
            columns = [pa.array([f[k] for f in found], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("declared"), *columns], schema=pa.schema([batch.schema.field(id_col), batch.schema.field("declared"), *[pa.field(k, c.type) for k, c in zip(("end", "n", "parent"), columns, strict=True)]]))

    each = asked.mapInArrow(run, shape).select(id_col, F.explode(F.arrays_zip("declared", "end", "n", "parent")).alias("f"))
    x, limit = F.col("f.declared"), F.least(F.col("f.n"), F.col("f.declared.i") + SCAN_LINES)
    open_ = F.col("f.end") < 0
    e = F.struct(x.alias("x"), F.when(open_, limit).otherwise(F.col("f.end") + 1).alias("line_end"), (limit < F.col("f.n")).alias("more"), limit.alias("limit"), open_.alias("open"))
    found = each.select(id_col, F.struct(e.alias("e"), "f.parent").alias("f"))
    e = F.col("f.e")
    at_limit = F.when(e["x"]["d"]["language"] == "python", e["line_end"] == e["limit"]).otherwise(e["open"])
    return found.select(
        id_col,
        (e["x"]["i"] + 1).cast("long").alias("line_start"),
        e["line_end"].cast("long").alias("line_end"),
        e["x"]["d"]["name"].alias("name"),
        e["x"]["d"]["language"].alias("language"),
        e["x"]["d"]["kind"].alias("kind"),
        e["x"]["d"]["visibility"].alias("visibility"),
        F.col("f.parent").alias("parent"),
        (e["more"] & at_limit).alias("truncated"),
    )
