from __future__ import annotations

import random

import pytest

from repolith.llm import truncation as T

SUBJECTS, VERBS, OBJECTS = ["The index", "A reader", "Each worker", "Our planner", "This section"], ["keeps", "resolves", "records", "explains", "follows"], ["every pending entry", "the order of batches", "its own counters", "all remaining shards", "the previous checkpoint"]
SCHEMA = "doc_id long, text string, source string, doc_type string, n_chars long, score string, copy string"


def sentence(r):
    return f"{r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(OBJECTS)} in step {r.randrange(99)}."


def text(r):
    kind = r.random()
    if kind < 0.6:
        return " ".join(sentence(r) for _ in range(r.randrange(2, 9)))
    if kind < 0.8:
        return "# Notes\n\n" + "\n".join(f"- {sentence(r)}" for _ in range(r.randrange(2, 7)))
    return sentence(r)[:-1].replace("The ", "Keep ") + "\n\nRefs: Alpha Beta"


@pytest.fixture(scope="module")
def corpus():
    r, out = random.Random(3), []
    for i in range(1500):
        t, source, cut = text(r), r.choice(["free", "forms", "crawl"]), False
        if source == "forms" and len(t) > 120:
            t = t[:120]
            cut = T.char_class(t.rstrip()[-1:]) != "end"
        elif source == "crawl" and r.random() < 0.2 and len(t) > 40:
            n = r.randrange(25, len(t) - 3)
            while not (t[n - 1].isalpha() and t[n].isalpha()):
                n -= 1
            t, cut = t[:n], True
        out.append((i, t, source, cut))
    return out


def test_held_out_accuracy(spark, corpus):
    df = spark.createDataFrame([(i, t, s, None, len(t), "x", "y") for i, t, s, _ in corpus], SCHEMA)
    score = {r["doc_id"]: r["score"] for r in T.scored(df).collect()}
    assert len(score) == len(corpus)
    found, true = {i for i, s in score.items() if s >= T.CUT}, {i for i, _, _, c in corpus if c}
    copies = {t for i, t, _, _ in corpus if i in true}
    true |= {i for i, t, _, _ in corpus if t in copies}
    assert len(found & true) >= 0.9 * len(true) and len(found & true) >= 0.9 * len(found)
    assert {r["source"]: r["max_chars"] for r in T.limits(df).collect()}["forms"] == 120
    share = {r["source"]: r["share"] for r in T.cut_share(df).collect()}
    assert share["forms"] > share["free"]


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "a", "t", 0, "x", "y"), (2, "", None, None, 0, "x", "y"), (3, " \n ", "a", None, 0, "x", "y"), (4, "One whole sentence about the index.", None, None, 0, "x", "y"), (5, "One whole sentence about the index.", "b", "t", 0, "x", "y"), (5, "One whole sentence about the index.", "b", "t", 0, "x", "y"), (6, "x" * 200_000, "b", "t", 0, "x", "y")], SCHEMA)
    got = {r["doc_id"]: r["score"] for r in T.scored(df).collect()}
    assert set(got) == {4, 5, 6} and got[4] == got[5] and T.scored(df).count() == 3
    assert T.scored(df.limit(0)).count() == 0 and T.cut_share(df.limit(0)).count() == 0
    assert T.scored(df.filter("doc_id < 4")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_cuts_fall_inside(seed):
    import numpy as np

    rng, r = np.random.default_rng(seed), random.Random(seed)
    for _ in range(200):
        t = text(r)
        c = T.cut_at_random(t, rng)
        assert c is None or c != t and not (T.char_class(c[-1:]) == "end" and not c.endswith(("...", "…")) and t[len(c) : len(c) + 1].isspace())


def test_one_longer_text_hides_no_limit(spark):
    rows = [(i, f"{i:04d}" + "x" * 196, "a", None, 0, "x", "y") for i in range(20)] + [(100 + i, "y" * (i + 1), "a", None, 0, "x", "y") for i in range(150)] + [(400, "z" * 5000, "a", None, 0, "x", "y"), (401, "z" * 900, "b", None, 0, "x", "y")]
    got = {r["source"]: (r["max_chars"], r["max_bytes"]) for r in T.limits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": (200, 200), "b": (None, None)}


def test_word_shares_do_not_depend_on_the_size_of_the_corpus(spark):
    rows = [(i, f"common {'rare' if i % 50 == 0 else 'usual'} ending{i}", "a", None, 0, "x", "y") for i in range(400)]
    small, large = (T.word_shares(spark.createDataFrame(rows * k, SCHEMA)) for k in (1, 7))
    assert large[1] == 7 * small[1] == 2800 and (small[0] == large[0]).all()
    assert small[0][T._slot("common")] > small[0][T._slot("usual")] > 0 and small[0][T._slot("ending7")] == 0
