"""Records of structured texts, rules of answers and small value rules, as column functions. White space is ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENDS = r"^[ \t\r\n]+|[ \t\r\n]+\z"
_MARK = "\x1e"

#: File extensions of each language.
LANGUAGES = {
    "rust": "rs",
    "python": "py pyi",
    "javascript": "js mjs cjs jsx",
    "typescript": "ts mts cts tsx",
    "go": "go",
    "java": "java",
    "kotlin": "kt kts",
    "ruby": "rb",
    "php": "php",
    "csharp": "cs",
    "c": "c h",
    "cpp": "cc cpp cxx hpp hh",
    "shell": "sh bash zsh",
    "powershell": "ps1",
    "dart": "dart",
    "elixir": "ex exs",
    "swift": "swift",
    "scala": "scala",
    "lua": "lua",
    "toml": "toml",
    "yaml": "yaml yml",
    "json": "json",
}

#: Parts of a path that mark a test.
TEST_PARTS = ["/test/", "/tests/", "_test.", "_tests.", ".test.", ".tests.", ".spec.", "/test_"]

#: Query parameters that only track a reader, beside utm_*.
TRACKING = ["gclid", "fbclid", "mc_cid", "mc_eid", "igshid", "ref"]


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def html_plain(page: Column) -> Column:
    """A page's text with a line break for each tag's end; a tag that never ends takes the rest with it."""
    return F.regexp_replace(F.regexp_replace(page, r"<[^>]*\z", ""), r"<[^>]*>|>", "\n")


def sections(text: Column, first: str) -> Column:
    """Sections of a text, trimmed, each from a line whose first character is in the class `first` to the next; none is empty."""
    cut = F.regexp_replace(text, rf"(^|\n)({first})", f"$1{_MARK}$2")
    return F.filter(F.transform(F.split(cut, _MARK), trimmed), lambda s: s != "")


def yaml_records(text: Column) -> Column:
    """struct(path, content) of each top-level key or list item with what is indented under it."""
    def named(s: Column) -> Column:
        line = trimmed(F.regexp_replace(F.regexp_extract(s, r"^[^\n]*", 0), "^-+", ""))
        return F.struct(trimmed(F.regexp_extract(line, "^[^:]*", 0)).alias("path"), s.alias("content"))

    return F.transform(sections(text, r"[^ \t#\r\n]"), named)


def toml_records(text: Column) -> Column:
    """struct(path, content) of each table; what stands before the first is `root`."""
    def named(s: Column) -> Column:
        line = F.regexp_replace(F.regexp_extract(s, r"^[^\r\n]*", 0), r"^[\[\]]+|[\[\]]+\z", "")
        return F.struct(F.when(s.startswith("["), line).otherwise("root").alias("path"), s.alias("content"))

    return F.transform(sections(text, r"\["), named)


def language(path: Column) -> Column:
    """Language of a path by its extension, `unknown` without a known one."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)\z", 1))
    out = F.lit("unknown")
    for name, known in LANGUAGES.items():
        out = F.when(ext.isin(known.split()), name).otherwise(out)
    return out


def is_test(path: Column) -> Column:
    low = F.lower(path)
    out = low.startswith("test_")
    for part in TEST_PARTS:
        out |= low.contains(part)
    return F.coalesce(out, F.lit(False))


def endpoint_kind(value: Column) -> Column:
    low = F.lower(value)
    return (
        F.when(low.rlike("^wss?://"), "websocket")
        .when(low.contains("graphql") | low.contains("/gql"), "graphql")
        .when(low.rlike("^https?://"), "absolute_url")
        .otherwise("relative_path")
    )


def link_identity(link: Column) -> Column:
    """A link without fragment and tracking parameters: links of equal identity are one entry."""
    bare = F.regexp_replace(link, r"#[\s\S]*\z", "")
    name = lambda p: F.lower(F.regexp_extract(p, "^[^=]*", 0))
    parts = F.split(F.regexp_extract(bare, r"\?([\s\S]*)\z", 1), "&")
    kept = F.array_join(F.filter(parts, lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(TRACKING)), "&")
    return F.concat(F.regexp_replace(bare, r"\?[\s\S]*\z", ""), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def is_llms_txt(body: Column) -> Column:
    """Whether a text opens with a Markdown title, after a byte order mark and white space."""
    return F.coalesce(body.rlike("^﻿?[ \t\r\n]*#[ \t]"), F.lit(False))


def without_sources_section(answer: Column) -> Column:
    """An answer up to its `## Sources` heading; empty if it opens with it."""
    return F.regexp_replace(F.regexp_replace(answer, r"(?i)(^|\n)## sources[\s\S]*\z", ""), r"[ \t\r\n]+\z", "")


def first_score(value: Column, label: str) -> Column:
    """The first run of digits and points after a label as a number; null where it is none or the label is missing."""
    at = F.instr(value, F.lit(label))
    tail = value.substr(at + F.lit(len(label)), F.length(value))
    return F.when(at > 0, F.regexp_extract(tail, r"^[^0-9.]*([0-9.]+)", 1).try_cast("double"))


def bare_json(raw: Column) -> Column:
    """Model output without a code fence around it or prose before its first bracket."""
    body = trimmed(raw)
    fenced = F.regexp_replace(F.regexp_replace(body, r"^```([^\n]*\n)?", ""), r"^([\s\S]*)```[\s\S]*\z", "$1")
    inner = F.regexp_extract(body, r"[{\[][\s\S]*\z", 0)
    return F.when(body.startswith("```"), trimmed(fenced)).otherwise(F.when(inner != "", inner).otherwise(body))


def color_usage(prop: Column) -> Column:
    return (
        F.when(prop.isin("background-color", "background"), "background")
        .when(prop == "color", "text")
        .when(prop.isin("border-color", "border", "outline-color"), "accent")
        .otherwise("unknown")
    )


def dry_vector(seed: Column, dims: int) -> Column:
    """The vector that tests use for a text: a fold of its bytes, then a linear congruential sequence."""
    word = F.lit(0xFFFFFFFF)
    byte = lambda i: F.conv(F.substring(F.hex(F.encode(seed, "UTF-8")), i * 2 - 1, F.lit(2)), 16, 10).cast("long")
    spots = F.filter(F.sequence(F.lit(0), F.octet_length(seed)), lambda i: i > 0)
    start = F.aggregate(spots, F.lit(0x811C9DC5), lambda acc, i: (acc * F.lit(16777619)).bitwiseAND(word).bitwiseXOR(byte(i)))
    states = F.aggregate(
        F.sequence(F.lit(1), F.lit(dims)),
        F.array(start),
        lambda acc, i: F.concat(acc, F.array((F.element_at(acc, -1) * F.lit(1664525) + F.lit(1013904223)).bitwiseAND(word))),
    )
    return F.transform(F.slice(states, 2, dims), lambda s: ((s % 10000).cast("float") / F.lit(10000).cast("float")).cast("float"))
