"""Records and answer rules against values told by hand."""

from pyspark.sql import functions as F

from millrace.functions import records as C


def one(spark, text, *columns):
    return tuple(spark.createDataFrame([(text,)], "t string").select(*[c(F.col("t")) for c in columns]).first())


def test_records(spark):
    yaml, toml = one(spark, "a: 1\n  b: 2\n# c\n- d: 3\r\nx\n", C.yaml_records, C.toml_records)
    assert [tuple(r) for r in yaml] == [("a", "a: 1\n  b: 2\n# c"), ("d", "- d: 3"), ("x", "x")]
    assert [r.path for r in toml] == ["root"]
    (toml,) = one(spark, "k = 1\n[a]\nx\n[[b.c]]\n", C.toml_records)
    assert [tuple(r) for r in toml] == [("root", "k = 1"), ("a", "[a]\nx"), ("b.c", "[[b.c]]")]
    assert one(spark, "", C.yaml_records, C.toml_records) == ([], [])
    assert one(spark, None, C.yaml_records) == (None,)


def test_text_rules(spark):
    assert one(spark, "<p>a>b</p><i", C.html_plain) == ("\na\nb\n",)
    assert one(spark, "https://h/a?UTM_x=1&b=2&ref=3#f", C.link_identity) == ("https://h/a?b=2",)
    assert one(spark, "https://h/a?gclid=1", C.link_identity) == ("https://h/a",)
    assert one(spark, "Yes [S1]. \n## Sources\n- [S1] x", C.without_sources_section) == ("Yes [S1].",)
    assert one(spark, "## sources\nx", C.without_sources_section) == ("",)
    assert one(spark, "```json\n{\"a\": 1}\n```", C.bare_json) == ('{"a": 1}',)
    assert one(spark, "Sure: [1] ", C.bare_json) == ("[1]",)
    assert one(spark, "RAG: 4.5/5 RAG: 1", lambda t: C.first_score(t, "RAG:")) == (4.5,)
    assert one(spark, "RAG: ? RAG: 3", lambda t: C.first_score(t, "RAG:")) == (3.0,)
    assert one(spark, "```\n[1]\n``` `x`", C.bare_json) == ("[1]",)
    assert one(spark, "none", lambda t: C.first_score(t, "RAG:")) == (None,)
    assert one(spark, "﻿\n# Title", C.is_llms_txt) == (True,)
    assert one(spark, "src/x_test.Go", C.language, C.is_test) == ("go", True)
    assert one(spark, "a.rs/b", C.language, C.is_test) == ("unknown", False)
    assert one(spark, "border", C.color_usage) == ("accent",)


def test_dry_vector(spark):
    for seed in ["", "a", "né"]:
        state = 0x811C9DC5
        for b in seed.encode():
            state = (state * 16777619 & 0xFFFFFFFF) ^ b
        want = []
        for _ in range(5):
            state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
            want.append(state % 10000 / 10000)
        (got,) = one(spark, seed, lambda t: C.dry_vector(t, 5))
        assert [round(x, 6) for x in got] == [round(x, 6) for x in want]
