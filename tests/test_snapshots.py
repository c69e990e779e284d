from __future__ import annotations

import random
from datetime import datetime

import pytest
from conftest import rows

from repolith.operators import snapshots as S

H = "workspace_id string, checkpoint_id string, target_commit_timestamp string, tree_sha string, ord string, digest string"
G = "workspace_id string, checkpoint_id string, fragment_id string, digest string, delivered_at timestamp, next_checkpoint_id string, island int"


def at(n: int) -> datetime:
    return datetime(2024, 1, 1 + n // 24, n % 24)


def changed(spark, h, g):
    history = spark.createDataFrame([(*x, "extra", "extra") for x in h], H)
    prints = spark.createDataFrame([(*x, "extra", 7) for x in g], G)
    return rows(S.snapshot_changes(history, prints), "checkpoint_id", "fragment_id", "change_kind"), history, prints


def test_kinds_of_change(spark):
    h = [("w", "c2", "2024-01-01T12:00:00+02:00", "t2"), ("w", "c1", "2024-01-01T11:00:00+09:00", "t1"), ("w", "c3", "2024-01-01T12:00:00Z", "t2"), ("w", "none", "2024-01-01T11:30:00Z", "t")]
    g = [("w", "c1", "a", "SHA256:AB", at(1)), ("w", "c1", "b", "x", at(1)), ("w", "c1", "n", None, at(1)), ("w", "c2", "a", "ab", at(2)), ("w", "c2", "n", None, at(2)), ("w", "c2", "d", "1", at(2)), ("w", "c2", "d", "2", at(5)),
         ("w", "c3", "a", None, at(3)), ("w", "c3", "b", "x", at(3)), ("w", "c3", "d", "2", at(1)), ("w", "c3", "d", "2", at(1)), ("w", "c3", None, "q", at(3)), (None, "c3", "z", "q", at(3)), ("w", None, "z", "q", at(3)), ("w", "c9", "z", "q", at(3))]
    got, history, prints = changed(spark, h, g)
    assert got == sorted([("c2", "b", "removed"), ("c2", "d", "added"), ("c3", "a", "changed"), ("c3", "b", "added"), ("c3", "n", "removed"), ("c3", None, "added")], key=str)
    assert rows(S.change_summary(history, prints), "checkpoint_id", "tree_changed", "added", "removed", "changed") == [("c2", True, 1, 1, 0), ("c3", False, 2, 1, 1)]


def test_empty_tables_and_unreadable_instants(spark):
    assert changed(spark, [], [])[0] == []
    got = changed(spark, [("w", "b", "no time", None), ("w", "a", None, None), ("w", "c", "2024-01-01", None)], [("w", c, "f", c, None) for c in "abc"])[0]
    assert got == [("b", "f", "changed"), ("c", "f", "changed")]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    h = [(w, f"{w}{i}", f"2024-01-{i + 1:02d}T00:00:00Z", None) for w in "uv" for i in range(6)]
    g = list({(w, f"{w}{i}", f"f{k}", r.choice(["a", "A", "x:a", "b", None]), at(r.randrange(3))) for w in "uv" for i in range(6) for k in range(8) for _ in range(2) if r.random() < 0.6})
    last: dict = {}
    for w, c, f, d, t in g:
        key = (t, (d is not None, d and d.split(":")[-1].lower()))
        last[w, c, f] = max(last.get((w, c, f), key), key)
    want = []
    for w in "uv":
        order = [c for x, c, *_ in h if x == w and any(k[1] == c for k in last)]
        for a, b in zip(order, order[1:]):
            for f in {k[2] for k in last if k[1] in (a, b)}:
                x, y = last.get((w, a, f)), last.get((w, b, f))
                if x is None or y is None or x[1] != y[1]:
                    want.append((b, f, "added" if x is None else "removed" if y is None else "changed"))
    assert changed(spark, h, g)[0] == sorted(want, key=str)
