"""Sections, symbols, differences and payloads against values of the rules and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import diffs, documents, payloads


def sections(spark, text):
    rows = documents.markdown_sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("section").collect()
    return [(r["kind"], r["level"], r["title"], r["heading_path"], r["fence_language"], r["content"]) for r in rows]


def test_fences_hide_headings(spark):
    got = sections(spark, "# Title\n\n```\n# not a heading\n## also not\n```\n\n## Real Heading\nbody\n")
    assert [r[2] for r in got] == ["Title", "Real Heading"]
    assert "# not a heading" in got[0][5]


@pytest.mark.parametrize(
    "text, path",
    [("# A\n## B\n### C\nleaf content\n", ["A", "B", "C"]), ("# A\n## B\ntext\n## C\nmore\n", ["A", "C"]), ("# A\n### C\n## B", ["A", "B"]), ("### C\n# A #\n", ["A"]), ("# A\n## B\n# D\n### E", ["D", "E"])],
)
def test_breadcrumbs(spark, text, path):
    assert sections(spark, text)[-1][3] == path


def test_frontmatter_and_fence_language(spark):
    got = sections(spark, "---\ntitle: Doc\n---\n# Heading\nbody\n")
    assert got[0][0] == "frontmatter" and "title: Doc" in got[0][5] and got[1][2] == "Heading"
    assert sections(spark, "## Snippet\n```rust\nfn main() {}\n```\n")[0][4] == "rust"
    assert sections(spark, "---\n---\nx")[0][0] == "section" and sections(spark, " \n\n") == [] and sections(spark, None) == []


def test_headings_with_anchors(spark):
    text = "# Axon Guide\n\nbody\n\n## Source Pipeline\n\n### Document Parse & Chunk\n```\n##### Deep ##\n```\n#\n####### no"
    rows = documents.heading_facts(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("line").collect()
    assert [r["anchor"] for r in rows] == ["axon-guide", "source-pipeline", "document-parse-chunk", "deep"]
    assert [len(r["heading_path"]) for r in rows] == [1, 2, 3, 4]


def chunks(spark, text, path="src/a.rs", facts=None):
    files = spark.createDataFrame([(1, text, path)], "doc_id long, text string, path string")
    return documents.code_chunks(files, facts).orderBy("byte_start").collect()


def test_code_chunks(spark):
    got = chunks(spark, "use x;\npub(crate) fn one() {}\n\nexport default class Two {}\nconst three = () => 1;\nlet four = 4;\n")
    assert [(r["symbol"], r["kind"]) for r in got] == [("one", "function"), ("Two", "type"), ("three", "function")]
    assert [r["line_start"] for r in got] == [2, 4, 5] and got[0]["byte_start"] == 7
    (none,) = chunks(spark, "\nplain text\n", "notes")
    assert (none["language"], none["chunk_source"], none["parse_status"], none["content"]) == ("unknown", "line_window", "unsupported", "plain text")
    assert chunks(spark, " \n") == [] and chunks(spark, None) == []


def test_huge_symbols_become_windows(spark):
    text = "fn huge() {\n" + "".join(f"    let x{i} = {i};\n" for i in range(2000)) + "}\n"
    got = chunks(spark, text)
    assert len(got) > 1 and all(len(r["content"]) <= 3000 and r["extraction_status"] == "fallback" for r in got)
    assert [r["symbol"] for r in got] == [f"huge#part{i}" for i in range(len(got))]
    assert "\n".join(r["content"].strip() for r in got).split() == text.split()
    assert all(text.encode()[r["byte_start"] : r["byte_end"]].decode().strip() == r["content"] for r in got)
    assert all(text[: r["byte_start"]].count("\n") + 1 == r["line_start"] for r in got)


def test_packed_files(spark):
    text = "preamble\n================\nFile: src/a.py\n================\ndef a():\n  pass\n\n================\nFile: b.txt\n================\n\n----------\nFile: c.js\nfunction c() {}\n"
    assert [(r["original_path"], r["symbol"]) for r in chunks(spark, text)] == [("src/a.py", "a"), ("c.js", "c")]


def test_facts_name_the_chunks(spark):
    facts = spark.createDataFrame([(1, "b", 2, 3, "tree_sitter"), (1, "gone", 9, 9, "x"), (1, "a", 1, None, "regex_fallback")], "doc_id long, name string, line_start int, line_end int, parser_method string")
    got = chunks(spark, "one\ntwo é\nthree", facts=facts)
    assert [(r["symbol"], r["content"], r["chunk_source"]) for r in got] == [("a", "one\n", "heuristic_symbol"), ("b", "two é\nthree", "ast_symbol")]
    assert (got[1]["byte_start"], got[1]["byte_end"], got[1]["line_start"]) == (4, 16, 2)


def symbols(spark, text, path):
    files = spark.createDataFrame([(1, text, path)], "doc_id long, text string, path string")
    return [tuple(r)[1:] for r in documents.code_symbols(files).orderBy("line_start").collect()]


def test_symbols_nest_by_braces_and_indent(spark):
    rust = 'pub fn run() {\n    let close = "}";\n    struct In;\n}\n// fn no()\nasync fn next() {}\nenum Open {\n'
    assert symbols(spark, rust, "a.rs") == [
        (1, 4, "run", "rust", "function", "public", None, False),
        (3, 3, "In", "rust", "struct", "private", "run", False),
        (6, 6, "next", "rust", "function", "private", None, False),
        (7, 7, "Open", "rust", "enum", "private", None, False),
    ]
    python = "class Widget:\n    def render(self):\n        x = 1\n\n        return x\n\n    def _hide(self):\n        pass\nx = 2\n"
    assert symbols(spark, python, "a.py") == [
        (1, 8, "Widget", "python", "class", "public", None, False),
        (2, 5, "render", "python", "function", "public", "Widget", False),
        (7, 8, "_hide", "python", "function", "private", "Widget", False),
    ]
    script = "export interface A { x: 1 }\ndeclare type B = 1;\nconst c = () => {\n  let d = 1;\n};\n"
    assert [r[2:6] for r in symbols(spark, script, "x.tsx")] == [("A", "typescript", "interface", "public"), ("B", "typescript", "type", "private"), ("c", "typescript", "function", "private"), ("d", "typescript", "constant", "private")]
    assert symbols(spark, script, "x.txt") == []


def test_search_for_an_end_stops(spark):
    text = "fn a() {\n" + "x\n" * 5000 + "}\n"
    assert symbols(spark, text, "a.rs")[0][1:2] == (4000,) and symbols(spark, text, "a.rs")[0][-1] is True


def common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_matches_are_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = (rng.choices("abcd" if rng.random() < 0.7 else "abcdefghij", k=rng.randint(0, 14)) for _ in range(2))
        found = diffs.matches(a, b)
        assert len(found) == common(a, b) and all(a[i] == b[j] for i, j in found)
        assert all(x < u and y < v for (x, y), (u, v) in zip(found, found[1:], strict=False))


def patched(old, diff):
    """old with a unified diff applied."""
    lines, out, at = old.splitlines(True), [], 0
    parts = diff.split("\n")[2:-1]
    k = 0
    while k < len(parts):
        head = parts[k].split(" ")
        start, n = ([int(x) for x in head[1][1:].split(",")] + [1])[:2]
        start = start if n == 0 else start - 1
        out += lines[at:start]
        at = start
        k += 1
        while k < len(parts) and not parts[k].startswith("@@ "):
            mark, text = parts[k][0], parts[k][1:] + "\n"
            if k + 1 < len(parts) and parts[k + 1].startswith("\\"):
                text = text[:-1]
                k += 1
            if mark != "+":
                assert lines[at] == text
                at += 1
            if mark != "-":
                out.append(text)
            k += 1
    return "".join(out + lines[at:])


def test_diffs_apply_and_have_context():
    rng = random.Random(4)
    for _ in range(600):
        old = [rng.choice("abcdef") for _ in range(rng.randint(0, 40))]
        new = [x for x in old if rng.random() > 0.1]
        for _ in range(rng.randint(0, 3)):
            new.insert(rng.randint(0, len(new)), rng.choice("xyz"))
        a, b = ("\n".join(t) + rng.choice(["", "\n"]) for t in (old, new))
        diff = diffs.unified(a, b)
        assert (diff is None) == (a == b)
        if diff:
            assert patched(a, diff) == b
    assert diffs.unified("1\n2\n3\n4\n5\n6\n7\n8\n9\n", "1\n2\n3\n4\nx\n6\n7\n8\n9\n") == "--- a\n+++ b\n@@ -2,7 +2,7 @@\n 2\n 3\n 4\n-5\n+x\n 6\n 7\n 8\n"
    assert diffs.unified("", "a") == "--- a\n+++ b\n@@ -0,0 +1 @@\n+a\n\\ No newline at end of file\n"


def test_page_changes(spark):
    rows = spark.sql("""SELECT 1 AS id, 'a b' AS old_text, 'a b' AS new_text, parse_json('{"title":"x","n":1}') AS old_meta, parse_json('{"title":"x","n":2}') AS new_meta, array(named_struct('href', 'u', 'text', 'p')) AS old_links, array(named_struct('href', 'u', 'text', 'q')) AS new_links
      UNION ALL SELECT 2, 'a', NULL, parse_json('{"title":"x"}'), parse_json('{"title":7}'), NULL, array(named_struct('href', 'v', 'text', ''))""")
    one, two = diffs.page_changes(rows, "id").orderBy("id").collect()
    assert (one["status"], one["word_count_delta"]) == ("same", 0)
    assert two["status"] == "changed" and two["word_count_delta"] == -1 and [tuple(x) for x in two["metadata_changes"]] == [("title", "x", None)] and two["links_added"][0]["href"] == "v"


def test_payloads(spark):
    rows = spark.createDataFrame([(1, '{"web_title":"Hello world","content_kind":"markdown"}'), (2, '{"a":{"password":"x","b]":"~/y"},"chunk_text":"Bearer x"}'), (3, "[]"), (4, "{}"), (5, None)], "id long, j string")
    rows = rows.select("id", F.parse_json("j").alias("p"))
    got = {r["id"]: (r["p"], r["status"]) for r in payloads.redacted(rows, "id", "p").select("id", F.to_json("payload").alias("p"), "status").collect()}
    assert got == {1: ('{"content_kind":"markdown","web_title":"Hello world"}', "clean"), 2: ('{"a":{"b]":"[REDACTED]"},"chunk_text":"Bearer x"}', "redacted"), 3: ("[]", "clean"), 4: ("{}", "clean")}
    assert sorted(tuple(r) for r in payloads.redaction_report(rows, "id", "p").collect()) == [(2, "a.b]", "redacted", "local_path"), (2, "a.password", "dropped", "secret_field_name")]
    assert sorted(tuple(r) for r in payloads.payload_faults(rows, "id", "p").collect()) == [(2, "a.b]", "value"), (2, "chunk_text", "value")]
