"""Publishing is whole or nothing, repeats change nothing, and pruning keeps what versions need."""

import pytest

from millrace.sources import snapshots as S


def frame(spark, ids, text="a"):
    return spark.createDataFrame([(i, f"{text}{i}", i % 3) for i in ids], "point_id long, text string, n int")


def rows(spark, root, version=None):
    return {r["point_id"]: r["text"] for r in S.read_points(spark, root, version).collect()}


class Stopped(Exception):
    pass


def stop_after(step):
    def between(name):
        if name.startswith(step):
            raise Stopped

    return between


def test_publish_upserts_and_repeats(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    one = S.publish(frame(spark, range(50)), root, "g1", 50, buckets=8)
    assert one.count == 50 and rows(spark, root) == {i: f"a{i}" for i in range(50)}
    doubled = frame(spark, [3, 3, 70], "b")
    two = S.publish(doubled, root, "g2", 2, previous="g1", buckets=8)
    assert two.count == 51 and rows(spark, root) == {i: f"a{i}" for i in range(50)} | {3: "b3", 70: "b70"}
    touched = {b for b, v in two.buckets.items() if v == 2}
    assert 1 <= len(touched) <= 2 and {p.name for p in (tmp_path / "p/data/v=2").glob("bucket=*")} == {f"bucket={b}" for b in touched}
    assert S.publish(doubled, root, "g2", 999, previous="g1", buckets=8) == two and len(S.versions(spark, root)) == 2
    assert rows(spark, root, one) == {i: f"a{i}" for i in range(50)}


def test_refused_publishes_change_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    with pytest.raises(FileNotFoundError):
        S.read_points(spark, root)
    S.publish(frame(spark, range(9)), root, "g1", 9, buckets=4)
    before = rows(spark, root)
    with pytest.raises(S.PublishRefused):
        S.publish(frame(spark, [1], "x"), root, "g2", 2, previous="g1", buckets=4)
    with pytest.raises(S.PublishRefused):
        S.publish(frame(spark, [1], "x"), root, "g2", 1, previous="g0", buckets=4)
    for step in ("counted", "written", "checked"):
        with pytest.raises(Stopped):
            S.publish(frame(spark, [1], "x"), root, "g2", 1, previous="g1", buckets=4, between=stop_after(step))
        assert rows(spark, root) == before and len(S.versions(spark, root)) == 1
    S.publish(frame(spark, [1], "x"), root, "g2", 1, previous="g1", buckets=4)
    assert rows(spark, root) == before | {1: "x1"}
    assert S.publish(frame(spark, []), root, "g3", 0, previous="g2", buckets=4).count == 9 and rows(spark, root) == before | {1: "x1"}


def test_prune(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    for g in range(1, 5):
        S.publish(frame(spark, range(20) if g == 1 else [g], f"v{g}-"), root, f"g{g}", 20 if g == 1 else 1, previous=f"g{g - 1}" if g > 1 else None, buckets=2)
    before = rows(spark, root)
    for bad in ({"keep": 1}, {"keep": 0, "admin": True}, {"keep": 1, "admin": True, "current": "g3"}):
        with pytest.raises(S.PruneRefused):
            S.prune(spark, root, **bad)
    with pytest.raises(Stopped):
        S.prune(spark, root, 1, admin=True, between=stop_after("version"))
    assert rows(spark, root) == before
    S.prune(spark, root, 1, admin=True, current="g4")
    assert rows(spark, root) == before and [v.generation for v in S.versions(spark, root)] == ["g4"]
    needed = {f"v={n}" for n in S.versions(spark, root)[0].buckets.values()}
    assert {p.name for p in (tmp_path / "p/data").glob("v=*")} == needed
    assert S.prune(spark, root, 1, admin=True) == []
    S.publish(frame(spark, [99]), root, "g5", 1, previous="g4", buckets=2)
    assert set(rows(spark, root)) == set(before) | {99}
