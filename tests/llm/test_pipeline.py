"""The pipeline's stages, and the whole, against brute force."""

import itertools
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from millrace.llm import quality
from millrace.llm.jaccard_join import Measure

from . import cases
from .test_corpus import brute_components, brute_substring
from .test_tokens import library_ids

COLUMNS = pipeline.COLUMNS


def plain(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def brute_line_stage(data):
    """Rows as the stage gives them: texts without frequent lines, null as empty, n_chars anew."""
    frequent = brute_frequent(data, 10)
    texts = ["\n".join(x for x in (row[1] or "").split("\n") if key(x) not in frequent) for row in data]
    return Counter((row[0], text, row[2], row[3], len(text)) for row, text in zip(data, texts, strict=True))


def key(line):
    return line.encode().strip(b" \t\n\x0b\x0c\r").lower()


def brute_frequent(data, n):
    own = {}
    for at, row in enumerate(data):
        own.setdefault(("none", at) if row[0] is None else row[0], set()).update(key(x) for x in (row[1] or "").split("\n"))
    return {k for k, times in Counter(k for keys in own.values() for k in keys if k).items() if times >= n}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    to = f"file://{tmp_path_factory.mktemp('tables')}"
    cases.frame(spark).write.parquet(f"{to}/documents.parquet")
    labels = [(i, int(i % 4 > 0), 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    return to


def docs_of(spark, tables):
    df = spark.read.parquet(f"{tables}/documents.parquet")
    return df, [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_quality_stage(spark, tables):
    df, data = docs_of(spark, tables)
    rejected = {r["doc_id"] for r in quality.train_and_score(df, spark.read.parquet(f"{tables}/labels.parquet")).where("predicted = 0").collect()}
    assert plain(pipeline.quality_stage(spark, df, tables)) == Counter(r for r in data if r[0] not in rejected or r[0] is None)


def test_line_stage(spark, tables):
    df, data = docs_of(spark, tables)
    got = pipeline.line_stage(spark, df, tables)
    assert got.columns == COLUMNS
    assert plain(got) == brute_line_stage(data)
    assert sum(len(r[1] or "") for r in data) > sum(r[4] for r in plain(got).elements())


def test_near_stage(spark, tables):
    df, data = docs_of(spark, tables)
    component = {i: c for i, _, c in brute_components(data, Measure(5, 80, 100))}
    assert plain(pipeline.near_stage(spark, df, tables)) == Counter(r for r in data if r[0] is None or component[r[0]] == r[0])


def brute_cut(data):
    out = Counter()
    texts = {}
    for i, n, removed, t in brute_substring(data, 50):
        texts.setdefault(i, []).append((n, removed, t))
    for i, text, lang, source, _ in data:
        n = len((text or "").encode().split())
        removed, left = next((r, t) for m, r, t in texts[i] if m == n)
        new = left if removed else text
        out[i, new, lang, source, None if new is None else len(new)] += 1
    return out


def test_substring_stage(spark, tables):
    df, data = docs_of(spark, tables)
    assert plain(pipeline.substring_stage(spark, df, tables)) == brute_cut(data)


def test_packing_stage(spark, tables):
    df, data = docs_of(spark, tables)
    got = Counter()
    for r in pipeline.packing_stage(spark, df, tables).collect():
        got[r["doc_id"]] += r["length"]
    want = Counter()
    for i, text, *_ in data:
        want[i] += len(library_ids(text or "")) + 1
    assert got == want


def test_whole_run(spark, tables):
    df, data = docs_of(spark, tables)
    rejected = {r["doc_id"] for r in quality.train_and_score(df, spark.read.parquet(f"{tables}/labels.parquet")).where("predicted = 0").collect()}
    data = [r for r in data if r[0] not in rejected or r[0] is None]
    data = list(brute_line_stage(data).elements())
    component = {i: c for i, _, c in brute_components(data, Measure(5, 80, 100))}
    data = [r for r in data if r[0] is None or component[r[0]] == r[0]]
    data = list(brute_cut(data).elements())
    want = Counter()
    for i, text, *_ in data:
        want[i] += len(library_ids(text or "")) + 1
    got = Counter()
    for r in pipeline.run(spark, tables).collect():
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_empty_tables(spark, tmp_path):
    to = f"file://{tmp_path}"
    cases.empty(spark).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    assert pipeline.run(spark, to).count() == 0
    for (_, stage), (later, _) in itertools.pairwise(pipeline.STAGES):
        assert stage(spark, cases.empty(spark), to).columns == COLUMNS, later
