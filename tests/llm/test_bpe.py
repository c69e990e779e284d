from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest

from repolith.llm import bpe

pytestmark = pytest.mark.skipif(not Path(bpe.FOLDER, "byte_bpe_50k.tiktoken").exists(), reason="no vocabulary")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(f"{bpe.FOLDER}/byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def table(ranks):
    return bpe.PairTable(ranks)


@pytest.fixture(scope="module")
def reference(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


TEXTS = [None, "", " ", "\n\n  \n", "it's we'll IT'S", "Größe 漢字 🎉👩‍👩‍👧 \u0000 \ufffd", "<|endoftext|>", "a" * 3000, " " * 700 + "x", "ab" * 1000, "\t\tif (x) {\r\n", "12345678901234567890", "é" * 300, "0x" + "f" * 5000]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_a_public_encoder(table, reference, text):
    assert list(bpe.encode_texts([text], table, {})[0]) == reference(text or "")


def test_random_texts(table, reference):
    r = random.Random(5)
    texts = ["".join(r.choice(["a", "b", "the", " ", "  ", "\n", "é", "汉", "1", "'s", "_", ".", "ing"]) for _ in range(r.randrange(600))) for _ in range(300)]
    known: dict = {}
    for _ in range(2):
        assert [list(x) for x in bpe.encode_texts(texts, table, known)] == [reference(t) for t in texts]


def test_table(spark, reference):
    df = spark.createDataFrame([(1, "some text", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "y", "x")], "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"], list(r["ids"])) for r in bpe.encode(df).collect()), key=str)
    assert got == sorted([(1, reference("some text")), (2, []), (3, []), (3, []), (None, reference("y"))], key=str)
    assert bpe.encode(df.limit(0)).count() == 0


def test_long_rows_follow_the_rule_of_short_ones():
    """Rows longer than LONG, random and made of tokens that join parts of higher rank, against one merge a round done naively."""
    ranks = bpe.read_ranks(f"{bpe.FOLDER}/byte_bpe_50k.tiktoken")
    table, r = bpe.PairTable(ranks), random.Random(6)
    odd = [t for t, n in ranks.items() if len(t) > 2 and any(ranks.get(t[:i], -1) > n or ranks.get(t[i:], -1) > n for i in range(1, len(t)))]
    assert len(odd) > 1000

    def naive(piece):
        ids = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks.get(ids[i] + ids[i + 1], 1 << 40), i) for i in range(len(ids) - 1)), default=(1 << 40, 0))
            if best[0] == 1 << 40:
                return [ranks[x] for x in ids]
            ids[best[1] : best[1] + 2] = [ids[best[1]] + ids[best[1] + 1]]

    pieces = [b"".join(r.choice(odd)[r.randrange(2):] for _ in range(90)) for _ in range(12)] + [bytes(r.choice(b"aab ") for _ in range(500)) for _ in range(4)] + [b" " * 700, b"ab" * 300, b"\xff" * 300]
    assert all(len(p) > bpe.LONG for p in pieces)
    want = [naive(p) for p in pieces]
    assert [x.tolist() for x in bpe.encode_pieces(pieces, table)] == want
    rows = [table.byte_ids[np.frombuffer(p, np.uint8)] for p in pieces]
    assert [bpe._merge_bucket(x[None, :].copy(), np.array([len(x)]), table)[0].tolist() for x in rows] == want


def test_a_very_long_piece_ends_soon():
    table = bpe.PairTable(bpe.read_ranks(f"{bpe.FOLDER}/byte_bpe_50k.tiktoken"))
    ids = bpe.encode_pieces([b"abcdefghij" * 40_000], table)[0]
    assert len(ids) < 200_000
