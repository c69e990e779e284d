from __future__ import annotations

import numpy as np
import pytest

from repolith.llm import packing as K


def best_fit(sizes, capacity=K.CAPACITY):
    free: list[int] = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= s
        else:
            free.append(capacity - s)
    return len(free)


def test_differencing_is_near_equal():
    r = np.random.default_rng(1)
    for k in (1, 2, 5, 40):
        s = np.sort(r.integers(1, 100, 300))[::-1]
        load = np.bincount(K.differencing(s, k), s, k)
        assert load.sum() == s.sum() and load.max() - load.min() <= 100 / 5 + 1
    assert sorted(np.bincount(K.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]


@pytest.mark.parametrize("sizes", [[], [0, 0, 0], [5], [1023] * 7, [512] * 9, [513] * 9, [342] * 100, [1, 1023] * 50, [300, 400, 324] * 30])
def test_edges(sizes):
    s = np.sort(np.array(sizes, np.int64))[::-1]
    w = K.fewest_windows(s)
    assert len(w) == len(s)
    if len(s):
        load = np.bincount(w, s)
        assert load.max() <= K.CAPACITY and len(load) <= best_fit(sizes) and set(w) == set(range(len(load)))


def test_against_best_fit():
    r = np.random.default_rng(2)
    ours = theirs = least = 0
    for _ in range(25):
        s = np.sort(np.minimum(r.gamma(1, 240, int(r.integers(5, 300))).astype(np.int64), 1023))[::-1]
        w = K.fewest_windows(s)
        assert np.bincount(w, s).max() <= K.CAPACITY
        ours, theirs, least = ours + w.max() + 1, theirs + best_fit(s), least + max(1, -(-int(s.sum()) // K.CAPACITY))
    assert ours <= 1.01 * theirs and ours <= 1.08 * least


def test_table(spark):
    units = spark.createDataFrame([("r", "a", 1, 2500, "x", 1), ("r", "a", 1, 2500, "x", 1), ("r", "b", 1, None, "x", 1), ("r", "c", 1, None, "x", 1), ("r", "d", 1, 0, "x", 1), ("r", "d", None, 1024, "x", 1), ("q", "e", 1, 1025, "x", 1), (None, "f", 1, 7, "x", 1), ("r", None, 9, 600, "x", 1)],
                                  "csc_id string, source_path string, line_start int, token_count int, container string, block int")
    files = spark.createDataFrame([("r", "b", "a b_c d! " * 400, 5), ("r", "b", "a b_c d! " * 400, 5), ("r", "c", None, 5), ("q", "b", "x", 5)], "csc_id string, path string, text string, size int")
    got = K.pack_units(units, files).collect()
    per: dict = {}
    for r in got:
        per.setdefault((r["csc_id"], r["container"]), []).append(r["size"])
    assert all(sum(v) <= K.CAPACITY for v in per.values())
    tokens: dict = {}
    for r in got:
        tokens.setdefault((r["csc_id"], r["source_path"], r["line_start"]), []).append((r["part"], r["size"]))
    assert {k: sum(s for _, s in v) for k, v in tokens.items()} == {("r", "a", 1): 2500, ("r", "b", 1): 1200, ("r", "c", 1): 0, ("r", "d", 1): 0, ("r", "d", None): 1024, ("q", "e", 1): 1025, (None, "f", 1): 7, ("r", None, 9): 600}
    assert {k for k, v in tokens.items() if len(v) > 1} == {("r", "a", 1), ("r", "b", 1), ("q", "e", 1)} and all(len(set(v)) == len(v) for v in tokens.values())
    assert K.pack_units(units.limit(0), files.limit(0)).count() == 0
    report = {r["csc_id"]: (r["containers"], r["least"]) for r in K.packing_report(K.pack_units(units, files)).collect()}
    assert report["q"] == (2, 2)


def test_blocks_of_one_repository(spark):
    units = spark.range(3000).selectExpr("'hot' AS csc_id", "concat('f', id) AS source_path", "1 AS line_start", "cast(1 + id * 37 % 900 AS int) AS token_count")
    files = spark.createDataFrame([], "csc_id string, path string, text string")
    packed = K.pack_units(units, files, block=500)
    assert packed.count() == 3000 and packed.groupBy("container").sum("size").filter("`sum(size)` > 1024").count() == 0
    r = K.packing_report(packed).first()
    assert r["filled"] > 0.97


def test_bisection_of_large_blocks_ends_at_the_least_count(monkeypatch):
    for least in range(1001, 1011):
        monkeypatch.setattr(K, "differencing", lambda sizes, k, least=least: np.arange(len(sizes)) % k if k >= least else np.zeros(len(sizes), np.int64))
        assert K.fewest_windows(np.ones(4096, np.int64), 5).max() + 1 == least


def test_windows_above_capacity_are_differenced_again():
    r = np.random.default_rng(4)
    again = 0
    for _ in range(20):
        s = np.sort(np.minimum(r.gamma(1, 240, 200).astype(np.int64), 1023))[::-1]
        k = max(-(-int(s.sum()) // K.CAPACITY), int((s * 2 > K.CAPACITY).sum()))
        before = K.differencing(s, k)
        over = int((np.bincount(before, s, k) - K.CAPACITY).clip(0).sum())
        after, left = K.within_capacity(before, s, k, K.CAPACITY)
        load = np.bincount(after, s, k)
        assert load.sum() == s.sum() and left == (load - K.CAPACITY).clip(0).sum() <= over
        again += over > 0 and not left
    assert again >= 3
