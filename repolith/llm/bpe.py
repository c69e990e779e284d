"""Encoding of whole texts with a byte-level BPE vocabulary, in numpy matrices.

Texts are cut into pieces by the vocabulary's pattern. The distinct pieces of a
batch are sorted into buckets by length; a bucket is a padded matrix with a row
per piece. In each round every row merges its leftmost pair of least rank, found
in a hash table of all pairs, rows close the gap, and rows without a pair leave.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from repolith.session import slices, spread

#: Folder of the public vocabulary files; a parameter of every function that reads one.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
# Fixed value: the pattern that cuts a text into pieces for byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Pieces of a worker that are kept between batches; those beyond are encoded again.
KEPT = 200_000
#: Longest row, in bytes, that closes its gap at each merge; longer ones merge in the same order and close all gaps at the end.
LONG = 256


class PairTable:
    """An open-addressed hash table from (left id, right id) to the id, and rank, of the merged token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        """ranks: the bytes of each token and its id; a lower id merges first."""
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        keys, merged = np.array(keys, np.uint64), np.array(merged, np.int32)
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys, self.ids = np.full(1 << self.bits, 2**64 - 1, np.uint64), np.full(1 << self.bits, _NONE, np.int32)
        self._pairs: dict[int, int] | None = None
        left, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(left):  # each round the first comer takes a free slot, the others try the next one
            free = self.keys[slot] == np.uint64(2**64 - 1)
            taken, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[taken], self.ids[taken] = keys[left[won]], merged[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self) -> dict[int, int]:
        """The same table as a dict from left << 32 | right, built at its first use."""
        if self._pairs is None:
            held = self.keys != np.uint64(2**64 - 1)
            self._pairs = dict(zip(self.keys[held].tolist(), self.ids[held].tolist(), strict=True))
        return self._pairs

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, _NONE where the pair doesn't merge."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out, todo, slot = np.full(keys.shape, _NONE, np.int32).ravel(), np.arange(keys.size), self._slot(keys.ravel())
        keys = keys.ravel()
        for _ in range(self.probes):
            held = self.keys[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.ids[slot[hit]]
            on = ~hit & (held != np.uint64(2**64 - 1))
            if not on.any():
                break
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _merge_bucket(rows: np.ndarray, length: np.ndarray, table: PairTable) -> list[np.ndarray]:
    """The final ids of each row; rows: ids padded with -1, changed in place."""
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(rows)
    which = np.arange(len(rows))
    rank = np.full((len(rows), rows.shape[1] - 1), _NONE, np.int32)
    valid = np.arange(rank.shape[1]) < (length - 1)[:, None]
    rank[valid] = table.merged(rows[:, :-1][valid], rows[:, 1:][valid])
    while len(which):
        at = rank.argmin(axis=1)
        least = rank[np.arange(len(which)), at]
        done = least == _NONE
        if done.any():
            for i in np.flatnonzero(done):
                out[which[i]] = rows[i, : length[i]].copy()
            go = ~done
            rows, rank, length, which, at, least = rows[go], rank[go], length[go], which[go], at[go], least[go]
            if not len(which):
                break
            width = max(2, int(length.max()))
            rows, rank = rows[:, :width].copy(), rank[:, : width - 1].copy()
        r, col = np.arange(len(which)), np.arange(rows.shape[1])
        rows[r, at] = least
        source = np.minimum(col + (col > at[:, None]), rows.shape[1] - 1)  # what is behind the pair moves up by one
        rows = np.take_along_axis(rows, source, axis=1)
        source = np.minimum(col[:-1] + (col[:-1] > at[:, None]), rank.shape[1] - 1)
        rank = np.take_along_axis(rank, source, axis=1)
        length = length - 1
        rank[col[:-1] >= (length - 1)[:, None]] = _NONE
        for side in (at - 1, at):  # only the pairs beside the merged token are new
            ok = (side >= 0) & (side + 1 < length)
            rank[r[ok], side[ok]] = table.merged(rows[r[ok], side[ok]], rows[r[ok], side[ok] + 1])
    return out


def _merge_long(ids: np.ndarray, table: PairTable) -> np.ndarray:
    """One long row under the same rule as in a bucket: one pair a round, the leftmost of least rank.

    Closing the gap of a long row at every merge would take time by the square of
    its length. So the row is a chain of places, and a heap of (rank, place) names
    the next pair; entries whose pair is gone are passed over. The gaps are closed once, at the end.
    """
    n = len(ids)
    token, after, before = ids.tolist(), [*range(1, n), -1], list(range(-1, n - 1))
    ranks = table.merged(ids[:-1], ids[1:])
    current = [*ranks.tolist(), int(_NONE)]
    at = np.flatnonzero(ranks != _NONE)
    heap = [(current[i], i) for i in at.tolist()]
    heapify(heap)
    pairs, none = table.pairs(), int(_NONE)
    while heap:
        rank, i = heappop(heap)
        if current[i] != rank:
            continue
        gone = after[i]
        token[i], after[i], current[gone] = rank, after[gone], none
        if after[i] >= 0:
            before[after[i]] = i
        current[i] = none
        for left in (before[i], i):
            if left >= 0 and after[left] >= 0:
                current[left] = pairs.get(token[left] << 32 | token[after[left]], none)
                if current[left] != none:
                    heappush(heap, (current[left], left))
        token[gone] = -1
    return np.array([x for x in token if x >= 0], np.int32)


def encode_pieces(pieces: list[bytes], table: PairTable) -> list[np.ndarray]:
    """Ids of each piece."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
    bucket = np.where(lengths > LONG, -1, np.ceil(np.log2(np.maximum(lengths, 2))).astype(np.int64))
    for b in np.unique(bucket):
        members = np.flatnonzero(bucket == b)
        if b == -1:
            for i in members:
                out[i] = _merge_long(table.byte_ids[np.frombuffer(pieces[i], np.uint8)], table)
            continue
        for part in np.array_split(members, max(1, len(members) * (1 << b) >> 21)):
            width = max(2, int(lengths[part].max()))
            rows = np.full((len(part), width), -1, np.int32)
            inside = np.arange(width) < lengths[part][:, None]
            rows[inside] = table.byte_ids[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
            for i, ids in zip(part, _merge_bucket(rows, lengths[part], table), strict=True):
                out[i] = ids
    return out


@lru_cache(maxsize=4)
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def encode_texts(texts: list[str | None], table: PairTable, known: dict[str, np.ndarray], pattern: str = PATTERN) -> list[np.ndarray]:
    """Ids of each whole text; an empty or null text has none. known: pieces encoded before, kept up to KEPT."""
    cut = [_pattern(pattern).findall(t) if t else [] for t in texts]
    new = list({p for pieces in cut for p in pieces if p not in known})
    fresh = dict(zip(new, encode_pieces([p.encode() for p in new], table), strict=True))
    empty = np.empty(0, np.int32)
    out = [np.concatenate([known[p] if p in known else fresh[p] for p in pieces]) if pieces else empty for pieces in cut]
    if len(known) < KEPT:
        known.update(x for x in fresh.items() if len(x[0]) <= LONG)
    return out


def encode(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, ids): the ids of every documents.text, without special tokens.

    Empty and null texts have an empty list. Strings of special tokens inside a
    text are ordinary text. Repeated rows of a doc_id give a row each. The rank
    file is read once by the driver and broadcast: its size is that of the
    vocabulary, whatever the data. Each text is encoded whole, where its input
    split is read.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(f"{folder}/{vocabulary}.tiktoken"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, known = PairTable(ranks.value), {}
        for b in (s for batch in batches for s in slices(batch, "text")):
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": encode_texts(b["text"].where(b["text"].notna(), None).tolist(), table, known)})

    return spread(documents.select("doc_id", "text"), "doc_id").mapInPandas(run, "doc_id long, ids array<int>")
