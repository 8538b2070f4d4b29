"""Records of CSV, XML and tool output, and citations, against values of the rules and the csv module."""

import csv
import random

from pyspark.sql import functions as F

from millrace.operators import structured as D


def test_csv_fields_are_those_of_the_csv_module(spark):
    rng = random.Random(6)
    fields = [["".join(rng.choices('ab,"', k=rng.randint(0, 5))) for _ in range(rng.randint(1, 4))] for _ in range(300)]
    lines = [",".join('"' + f.replace('"', '""') + '"' if set(f) & set(',"') else f for f in row) for row in fields]
    assert [next(csv.reader([x])) if x else [""] for x in lines] == fields
    got = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", D.csv_fields(F.col("line")).alias("f")).orderBy("i").collect()
    assert [r["f"] for r in got] == fields
    odd = spark.createDataFrame([('a""b,"x,y',), ('""""',)], "line string").select(D.csv_fields(F.col("line")).alias("f")).collect()
    assert [r["f"] for r in odd] == [["ab", "x,y"], ['"']]


def records(spark, kind, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r["locator"], r["content"], r["warning"]) for r in D.structured_records(docs, kind).orderBy("record").collect()]


def test_csv_records(spark):
    docs = spark.createDataFrame([(1, "name, age\r\nann ,3\n\nbob,4,5\n"), (2, "only header"), (3, None)], "doc_id long, text string")
    got = [tuple(r) for r in D.csv_records(docs).orderBy("csv_row").collect()]
    assert got == [(1, 0, "name: ann\nage: 3", 11, 18), (1, 2, "name: bob\nage: 4", 19, 27)]
    assert records(spark, "csv", "only header") == [(None, "only header", "chunk.structured_parse_failed: csv")]


def test_xml_records(spark):
    text = '<?xml version="1.0"?><root><item id="1"><a>x</a><b/></item> t <empty/><item>y</item></root><late/>'
    assert records(spark, "xml", text) == [("/*/item", '<item id="1"><a>x</a><b/></item>', None), ("/*/empty", "<empty/>", None), ("/*/item", "<item>y</item>", None)]
    assert records(spark, "xml", "<r><open><x></x>") == [(None, "<r><open><x></x>", "chunk.structured_parse_failed: xml")]
    assert records(spark, "xml", " ") == [] and records(spark, "xml", None) == []
    docs = spark.createDataFrame([(1, "<é>ü<a>é</a></é>")], "doc_id long, text string")
    (row,) = D.xml_records(docs).collect()
    assert "<é>ü<a>é</a></é>".encode()[row["byte_start"] : row["byte_end"]].decode() == "<a>é</a>"


def test_json_yaml_and_toml_records(spark):
    assert records(spark, "json", '{"a/b":{"c":[1]},"~":null}') == [("/a~1b", '{"c":[1]}', None), ("/~0", "null", None)]
    assert records(spark, "json", "[1,[2]]") == [("/0", "1", None), ("/1", "[2]", None)] and records(spark, "json", '"x"') == [("", '"x"', None)]
    assert records(spark, "json", "[]") == [] and records(spark, "json", "{x")[0][2] == "chunk.structured_parse_failed: json"
    assert [r[0] for r in records(spark, "yaml", "a: 1\n b: 2\n# no\nc:\n")] == ["a", "c"] and [r[0] for r in records(spark, "toml", "x=1\n[a]\ny=2\n[[b]]\n")] == ["root", "a", "b"]


def test_tool_output(spark):
    docs = spark.createDataFrame([(1, 'plain\n\n{"tool_name":"grep","action":" ","name":"n","output":{"artifact_id":"art"}}\n[1]\n{bad'), (2, None)], "doc_id long, text string")
    got = [tuple(r)[1:] for r in D.tool_output(docs).orderBy("line").collect()]
    assert got[0] == (1, "plain", None, None, None, None) and got[1][0] == 3 and got[1][2:] == ("grep", None, None, "art") and [r[0] for r in got] == [1, 3, 4, 5]


WHOLE = """{"source_generation":7,"job_id":"00000000-0000-0000-0000-000000000001","redaction_status":"clean","visibility":"internal","redaction_version":"v1","redacted_field_count":0,
 "dropped_field_count":0,"detector_count":0,"detector_names":[],"chunk_locator":{"canonical_uri":"https://h/a","range":{"line_start":4,"xml_xpath":"/*/a"}},"source_range":{"line_start":1,"line_end":3,"xml_xpath":" "}}"""


def test_citations(spark):
    cases = [
        (WHOLE, None),
        (WHOLE.replace('"source_range":{"line_start":1,"line_end":3,"xml_xpath":" "}', '"x":1').replace('"line_start":4,"xml_xpath":"/*/a"', '"yaml_path":" "'), "missing_source_range"),
        (WHOLE.replace('"line_end":3', '"line_end":-3'), "invalid_source_range"),
        (WHOLE.replace('"line_start":4', '"line_start":"4"'), "invalid_chunk_locator_range"),
        (WHOLE.replace('"canonical_uri"', '"uri"'), "missing_canonical_uri"),
        (WHOLE.replace('"detector_names":[]', '"detector_names":[1]'), "missing_detector_names"),
        (WHOLE.replace('"source_generation":7', '"source_generation":-7'), "missing_source_generation"),
        (WHOLE.replace("clean", "dirty"), "missing_redaction_status"),
    ]
    rows = spark.createDataFrame([(i, "c", "d", "s", "k", p) for i, (p, _) in enumerate(cases)] + [(99, "c", None, "s", "k", WHOLE)], "point_id long, chunk_id string, document_id string, source_id string, source_item_key string, p string")
    got = {r["point_id"]: r for r in D.citations(rows.withColumn("payload", F.parse_json("p"))).collect()}
    assert [got[i]["fault"] for i in range(len(cases))] == [f for _, f in cases] and got[99]["fault"] == "missing_document_id"
    anchors = got[0]["anchors"]
    assert (anchors["line_start"], anchors["line_end"], anchors["xml_xpath"], got[0]["canonical_uri"], got[0]["source_generation"]) == (1, 3, "/*/a", "https://h/a", 7)
    assert got[1]["anchors"] is None
