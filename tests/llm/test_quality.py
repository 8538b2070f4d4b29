"""The discriminant over the given labels against a plain one, and its ranking of held-out documents."""

import zlib

import numpy as np
import pytest

from millrace.llm import quality

from . import cases

DATA = "/root/testdata/sf0.01"


def plain_scores(x, labels, shrinkage):
    """Densities by solving with whole covariances, from all labelled rows at once."""
    both = np.array([x[i] for i, _ in labels])
    own = [np.array([x[i] for i, y in labels if y == c]) for c in (0, 1)]
    target = np.diag(np.maximum(both.var(0), 1e-4))
    every, logs = np.array(list(x.values())), []
    for c in (0, 1):
        mean = own[c].mean(0)
        cov = (1 - shrinkage) * np.cov(own[c].T, bias=True) + shrinkage * target
        away = every - mean
        distance = (away * np.linalg.solve(cov, away.T).T).sum(1)
        logs.append(np.log((len(own[c]) + 1) / (len(both) + 2)) - 0.5 * (distance + np.linalg.slogdet(cov)[1]))
    return dict(zip(x, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500))), strict=True))


def auc(pairs):
    good, bad = ([s for s, y in pairs if y == c] for c in (1, 0))
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_scores_and_ranking_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.select("doc_id", "text").collect()}
    known = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] is not None and r["doc_id"] in texts]
    out = {r["doc_id"]: r for r in quality.train_and_score(docs, labels).collect()}
    assert {i: r["held_out"] for i, r in out.items()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    x = {i: np.array(quality.statistics(t)) for i, t in texts.items()}
    want = plain_scores(x, [(i, y) for i, y in known if not out[i]["held_out"]], quality.SHRINKAGE)
    assert max(abs(out[i]["score"] - want[i]) for i in texts) < 1e-6
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in out.values())
    held = [(out[i]["score"], y) for i, y in known if out[i]["held_out"]]
    assert len({y for _, y in held}) == 2 and auc(held) >= 0.9


def test_long_texts_and_ties(spark):
    long = "Some plain words of prose, and more of them. " * 40_000
    data = [(1, long), (2, long), (3, "x"), (4, "x"), (5, None), (6, "")] + [(i, t) for i, t, *_ in cases.rows() if i and i > 6]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in data], "doc_id long, quality int")
    out = [(r["doc_id"], r["score"], r["predicted"]) for r in quality.train_and_score(docs, labels).collect()]
    by = dict((i, (s, p)) for i, s, p in out)
    assert len(out) == len(data) and by[1] == by[2] and by[3] == by[4] and by[5] == by[6]
    assert all(0 <= s <= 1 and not np.isnan(s) for _, s, _ in out)
    assert quality.statistics(long.encode())[0] == pytest.approx(np.log1p(9 * 40_000) / 4)
