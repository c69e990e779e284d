"""Cutting oversized texts at natural boundaries into overlapping pieces.

A piece begins at a boundary: the start of a line, else of a sentence, else of a
token. The farthest legal successor of every boundary is found at once, by search
in the sorted boundaries of all texts of a batch; squaring the successor table
then marks all starts that greedy cutting from the text's beginning visits, in as
many steps as the logarithm of the number of pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.session import slices

LIMIT, LEAST, MOST = 400, 20, 60
TOKEN = "[A-Za-z0-9_]+"

_TOKEN = re.compile(TOKEN)
#: Line ends as the project counts lines.
_LINE_END = re.compile("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
_SENTENCE_END = re.compile("[.!?…][\"'”’»)\\]]*\\s+|[。！？]\\s*|;\\s*\\}|[;{}]\\s+")
#: Ranks of boundaries: token, sentence, line.
_WORD, _SENTENCE, _LINE = 0, 1, 2


def boundaries(text: str, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(char position, rank) of what a piece may begin with, one at most for each token, beginning with position 0.

    starts: the tokens' positions. A boundary stands before its first token; of
    several before one token the highest rank stays, of these the last.
    """
    n, rank, at = len(starts), np.zeros(len(starts), np.int8), np.array(starts, np.int64)
    for kind, pattern in ((_SENTENCE, _SENTENCE_END), (_LINE, _LINE_END)):
        for m in pattern.finditer(text):
            t = bisect_right(starts, m.end() - 1)
            if t < n and rank[t] <= kind:
                rank[t], at[t] = kind, m.end()
    at[0], rank[0] = 0, _LINE
    return at, rank


def _farthest(ok: np.ndarray) -> np.ndarray:
    """For each token index the last index up to it where ok, -1 if none."""
    return np.maximum.accumulate(np.where(ok, np.arange(len(ok)), -1))


def successors(rank: np.ndarray, base: np.ndarray, size: np.ndarray, limit: int, least: int) -> np.ndarray:
    """The farthest legal start of the next piece, for a piece that starts at each token; itself where the rest of its text fits.

    rank: of all tokens of all texts, one text after the other; base: of each
    token the index of its text's first token; size: of each token its text's
    number of tokens. The next piece begins at least `least` tokens before the
    farthest end. A line start is preferred to a sentence, and a sentence to a
    token; of each kind first those in the second half of the reach.
    """
    i = np.arange(len(rank))
    last = base + size
    reach, half = np.minimum(i + limit - least, last - 1), i + (limit - least) // 2
    out, open_ = np.full(len(rank), -1), np.ones(len(rank), bool)
    lines, sentences = _farthest(rank == _LINE)[reach], _farthest(rank >= _SENTENCE)[reach]
    for found, above in ((lines, half), (sentences, half), (np.maximum(lines, sentences), i), (reach, i)):
        take = open_ & (found > above)
        out[take] = found[take]
        open_ &= ~take
    return np.where(i + limit >= last, i, out)


def reached(succ: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which indices are visited from `first` by following succ, found by squaring the table."""
    seen = np.zeros(len(succ), bool)
    seen[first] = True
    jump, frontier = succ, first
    while True:
        new = jump[frontier]
        new = np.unique(new[~seen[new]])
        if not len(new):
            return seen
        seen[new] = True
        frontier = np.flatnonzero(seen)
        jump = jump[jump]


def split_texts(texts: list[str], limit: int = LIMIT, least: int = LEAST, most: int = MOST) -> list[list[tuple[int, int, int]]]:
    """The pieces of each text of at least one token as (char start, char end, tokens repeated from the piece before)."""
    starts = [[m.start() for m in _TOKEN.finditer(t)] for t in texts]
    marks = [boundaries(t, s) for t, s in zip(texts, starts, strict=True)]
    sizes = np.array([len(s) for s in starts])
    bases = np.r_[0, np.cumsum(sizes)[:-1]]
    rank = np.concatenate([r for _, r in marks])
    succ = successors(rank, np.repeat(bases, sizes), np.repeat(sizes, sizes), limit, least)
    seen = reached(succ, bases)
    out = []
    for text, first, size, (at, ranks) in zip(texts, bases, sizes, marks, strict=True):
        begin = np.flatnonzero(seen[first : first + size])
        pieces, end = [], 0
        for k, s in enumerate(begin):
            repeated = end - s if k else 0
            if k + 1 == len(begin):
                pieces.append((int(at[s]), len(text), int(repeated)))
                break
            nxt = begin[k + 1]
            low, high = nxt + least, min(nxt + most, s + limit, size)
            best = low + int(np.flatnonzero(ranks[low : high + 1] == ranks[low : high + 1].max())[-1]) if high < size and ranks[low : high + 1].any() else high
            end = best
            stop = int(at[best]) if best < size else len(text)
            pieces.append((int(at[s]), stop, int(repeated)))
        out.append(pieces)
    return out


def _lines(text: str, pieces: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Offsets of the first and the last line of each piece within its text."""
    ends = [m.end() for m in _LINE_END.finditer(text)]
    return [(bisect_right(ends, a), bisect_right(ends, max(a, b - 1))) for a, b, _ in pieces]


def _split(limit: int, least: int, most: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (s for batch in batches for s in slices(batch, "text")):
            texts, rows = b["text"].tolist(), []
            for csc, chunk, first, last, text, pieces in zip(b["csc_id"], b["chunk_id"], b["line_start"], b["line_end"], texts, split_texts(texts, limit, least, most) if texts else [], strict=True):
                lined = not (pd.isna(first) or pd.isna(last))
                for k, ((start, end, repeated), (a, z)) in enumerate(zip(pieces, _lines(text, pieces), strict=True)):
                    rows.append((csc, chunk, k, text[start:end], start, end, repeated, int(min(first + a, last)) if lined else None, int(min(first + z, last)) if lined else None))
            out = pd.DataFrame(rows, columns=["csc_id", "chunk_id", "piece", "text", "char_start", "char_end", "overlap_tokens", "line_start", "line_end"])
            yield out.astype({"line_start": "Int32", "line_end": "Int32"})

    return run


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The distinct chunks of more than limit tokens. A null text has none; a short text is told by its length, without counting."""
    wanted = chunks.select("csc_id", "chunk_id", "text", "line_start", "line_end").filter((F.length("text") > 2 * limit) & (F.regexp_count("text", F.lit(TOKEN)) > limit))
    return wanted.distinct()


def split_chunks(chunks: DataFrame, limit: int = LIMIT, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Pieces of the chunks of more than limit tokens: (csc_id, chunk_id, piece, text, char_start, char_end, overlap_tokens, line_start, line_end).

    Pieces are numbered from 0 in order, hold at most limit tokens and together
    cover the text; each but the first repeats least to most tokens of the one
    before. line_start and line_end are the piece's own lines where the chunk has
    both, else null; they never pass the chunk's line_end. Chunks of at most limit
    tokens, also null and empty ones, give no pieces; repeated rows count once.
    Needs least <= most < limit / 2. Texts are cut whole, independently of each
    other.
    """
    return oversized(chunks, limit).mapInPandas(
        _split(limit, least, most), "csc_id string, chunk_id string, piece int, text string, char_start long, char_end long, overlap_tokens int, line_start int, line_end int")
