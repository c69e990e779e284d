from __future__ import annotations

import random
import re

import pytest

from repolith.llm import splitting as S


def checked(text: str) -> list:
    pieces = S.split_texts([text])[0]
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for i, (a, z, repeated) in enumerate(pieces):
        assert len(re.findall(S.TOKEN, text[a:z])) <= S.LIMIT
        if i:
            assert pieces[i - 1][0] < a <= pieces[i - 1][1]
            assert len(re.findall(S.TOKEN, text[a : pieces[i - 1][1]])) == repeated and S.LEAST <= repeated <= S.MOST
    return pieces


@pytest.mark.parametrize("text", [" ".join(f"w{i}" for i in range(401)), "\n".join(f"w{i}" for i in range(5000)), "。".join("a b c" for _ in range(300)), "\n" * 5000 + "a b " * 500 + "\n\n\n", ("word " * 39 + "\n") * 100, "a." * 401, "x " * 100_000, "٣ " * 50 + "tok-" * 900])
def test_shapes(text):
    checked(text)


def test_random():
    r = random.Random(3)
    for _ in range(150):
        text = "".join(r.choice(["a", "bb", " ", "\n", ". ", "\r\n", "é", "\x0b"]) for _ in range(r.randint(1500, 6000)))
        if len(re.findall(S.TOKEN, text)) > S.LIMIT:
            checked(text)


def test_natural_places_first():
    text = "".join(f"line {i} has six tokens here\n" for i in range(200))
    assert all(text[a - 1] == "\n" for a, _, _ in checked(text)[1:])
    prose = " ".join(f"Sentence number {i} is short." for i in range(200))
    assert all(prose[:a].rstrip().endswith(".") for a, _, _ in checked(prose)[1:])


def test_squaring_equals_walking():
    import numpy as np

    r = np.random.default_rng(0)
    for _ in range(20):
        n = int(r.integers(5, 400))
        succ = np.minimum(np.arange(n) + r.integers(1, 9, n), n - 1)
        i, seen = 0, {0}
        while succ[i] != i:
            i = int(succ[i])
            seen.add(i)
        assert set(np.flatnonzero(S.reached(succ, np.array([0])))) == seen


def test_table(spark):
    schema = "csc_id string, chunk_id string, text string, line_start int, line_end int, metadata map<string,string>, piece string"
    long = "".join(f"line {i} has six tokens here\n" for i in range(100))
    df = spark.createDataFrame([("r", "a", long, 11, 110, None, "x"), ("r", "a", long, 11, 110, {"k": "v"}, "x"), ("r", "b", long, None, 5, None, "x"), ("r", "c", None, 1, 2, None, "x"), ("r", "d", "", 1, 2, None, "x"), ("r", "e", "a " * 400, 1, 1, None, "x"), (None, "f", "a " * 401, 7, 7, None, "x")], schema)
    got = S.split_chunks(df)
    assert {r["chunk_id"] for r in got.collect()} == {"a", "b", "f"}
    a = sorted(got.filter("chunk_id = 'a'").collect(), key=lambda r: r["piece"])
    assert [r["piece"] for r in a] == list(range(len(a))) and a[0]["line_start"] == 11 and a[-1]["line_end"] == 110
    for r in a:
        assert long.split("\n")[r["line_start"] - 11] == r["text"].split("\n")[0]
    assert all(r["line_start"] is None for r in got.filter("chunk_id = 'b'").collect()) and all(r["line_end"] == 7 for r in got.filter("chunk_id = 'f'").collect())
    assert S.split_chunks(df.limit(0)).count() == 0
