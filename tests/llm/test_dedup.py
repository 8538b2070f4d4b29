import hashlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import exact_dedup, line_dedup

from . import cases


def test_exact_groups(spark):
    data = cases.rows()
    groups = defaultdict(list)
    for i, t, *_ in data:
        groups[t or ""].append(i)
    got = Counter(tuple(r) for r in exact_dedup.exact_groups(cases.frame(spark)).collect())
    want = Counter()
    for i, t, *_ in data:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        want[i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    assert exact_dedup.exact_groups(cases.empty(spark)).count() == 0


def test_exact_dedup_keeps_columns(spark):
    out = exact_dedup.exact_dedup(cases.frame(spark))
    assert set(out.columns) == set(cases.frame(spark).columns)


def brute_lines(data, n):
    own = defaultdict(set)  # a document is all rows of a doc_id; without one, a row is
    for at, (i, t, *_) in enumerate(data):
        own[("none", at) if i is None else i] |= {line_dedup.line_key(x) for x in (t or "").encode().split(b"\n")}
    seen = Counter(k for keys in own.values() for k in keys if k)
    out = Counter()
    for i, t, *_ in data:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if not (k := line_dedup.line_key(x)) or seen[k] < n]
        out[i, b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)] += 1
    return out


@pytest.mark.parametrize("sent", [0, 500_000])
def test_line_dedup(spark, sent):
    data = cases.rows(["licensed line\nSame", "\t LICENSED Line \n"])
    docs = cases.frame(spark, ["licensed line\nSame", "\t LICENSED Line \n"])
    index = line_dedup.build_index(docs, 3, 4)
    got = Counter(tuple(r) for r in line_dedup.drop_frequent_lines(docs, index, broadcast_rows=sent).collect())
    assert got == brute_lines(data, 3)
    assert line_dedup.line_dedup(cases.empty(spark)).count() == 0


def test_a_document_in_many_rows_counts_once(spark):
    docs = spark.createDataFrame([(1, "same line")] * 12 + [(2, "same line")], "doc_id long, text string")
    assert {r["n_dropped"] for r in line_dedup.line_dedup(docs, 3).collect()} == {0}
    assert {r["n_dropped"] for r in line_dedup.line_dedup(docs, 2).collect()} == {1}


def test_insert_and_delete_are_reversible(spark):
    docs = cases.frame(spark)
    more = spark.createDataFrame([(100 + i, f"Licensed line\nline {i % 2}") for i in range(6)], "doc_id long, text string")
    base = line_dedup.build_index(docs, 3, 4)
    held = lambda index: ({(bytes(r[0]), r[1]) for r in index.counts.collect()}, {bytes(r[0]) for r in index.frequent().collect()})
    bigger = line_dedup.insert_docs(base, more)
    assert held(bigger) == held(line_dedup.build_index(docs.select("doc_id", "text").union(more), 3, 4))
    assert held(bigger)[1] != held(base)[1]
    back = line_dedup.delete_docs(bigger, more)
    assert held(back) == held(base)
    shared = {bytes(r[0]) for r in back.frequent().collect()}
    filters = {r["shard"]: line_dedup.CuckooFilter.load(bytes(r["filter"])) for r in back.filters.collect()}
    assert all(any(k in f for f in filters.values()) for k in shared)


def test_cuckoo_filter():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(5000)]
    f = line_dedup.CuckooFilter.of(keys)
    assert all(k in f for k in keys)
    others = [hashlib.md5(f"x{i}".encode()).digest() for i in range(5000)]
    assert sum(k in f for k in others) < 20
    assert all(f.delete(k) for k in keys[:2500]) and all(k in f for k in keys[2500:])
    assert sum(k in f for k in keys[:2500]) < 20
    small = line_dedup.CuckooFilter(1)
    before = None
    for k in keys:
        before = small.table.copy()
        if not small.insert(k):
            break
    assert (small.table == before).all()
