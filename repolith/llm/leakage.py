"""Evaluation texts that stand, fully or partly, in documents.

Both sides are written as their lower-case tokens with one blank between. All
8-grams of characters of the items make an index; those that a document shares are
counted in overlapping bands of diagonals (place in the document less place in the
item). By the q-gram lemma a region of w characters with at most e edits shares at
least w - 7 - 8e grams in its band; regions that reach the bound are aligned within
the band, and the exact rule on tokens is checked on what remains.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.session import slices, spread

Q = 8
#: Consecutive tokens in common that make a leak; shorter items must stand whole.
RUN = 12
#: Width of a band of diagonals and distance of one from the next: the edits that a region may have move it by three diagonals at most, so one band holds it.
BAND, STEP = 8, 4
#: Diagonals on either side of a band that its alignments may use, as longer regions drift further.
MARGIN = 5
#: Characters of the item before and behind a region that are aligned with it.
ROOM = 16
#: Bits of the slots in which the grams of half bands are counted before they are sorted.
_SLOTS = 20
#: A near copy: characters of a region, and edits that it may have as a share of them.
REGION, EDITS = 64, 0.05
#: Characters of items that are searched together; more are searched in further passes over the documents.
BLOCK_CHARS = 4_000_000

_BETWEEN = re.compile("[^A-Za-z0-9_]+")
#: Grams that a near copy of REGION characters shares at least.
_NEAR_GRAMS = REGION - Q + 1 - Q * int(EDITS * REGION)
#: Score of a near copy at least: of its n >= REGION characters all but the edits are equal, and an edit takes 2.
_LEAST_SCORE = math.ceil(REGION * (1 - 3 * EDITS) - 1e-9)


def normal_text(text: str | None) -> str:
    """` a b c ` for the tokens of a text after NFKC, in lower case; empty without tokens."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    out = _BETWEEN.sub(" ", text).lower().strip(" ")
    return f" {out} " if out else ""


def grams(codes: np.ndarray) -> np.ndarray:
    """The Q characters from each place on as one number; exact, as Q bytes fill 64 bits."""
    if len(codes) < Q:
        return np.empty(0, np.uint64)
    return np.ndarray((len(codes) - Q + 1,), "<u8", np.ascontiguousarray(codes).data, strides=(1,)).copy()


class GramIndex:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        """items: (id, normal text), texts not empty."""
        by_text: dict[str, list[int]] = {}
        for i, text in items:
            by_text.setdefault(text, []).append(i)
        self.texts, self.ids = list(by_text), [sorted(set(x)) for x in by_text.values()]
        self.windows = []
        for t in self.texts:
            words = t.split()
            self.windows.append([f" {' '.join(words[i : i + RUN])} " for i in range(max(1, len(words) - RUN + 1))])
        self.codes = [np.frombuffer(t.encode(), np.uint8) for t in self.texts]
        self.short = [k for k, t in enumerate(self.texts) if len(t) < Q]  # the lemma says nothing of these
        # the least of what a near copy shares and what the item's shortest run of RUN tokens shares without an edit
        self.need = np.array([max(1, min(_NEAR_GRAMS, min(map(len, w)) - Q + 1)) for w in self.windows], np.int64)
        found = [grams(c) for c in self.codes]
        all_grams = np.concatenate([*found, np.empty(0, np.uint64)])
        order = np.argsort(all_grams, kind="stable")
        self.item = np.repeat(np.arange(len(found)), np.array([len(g) for g in found], np.int64))[order]
        self.place = np.concatenate([*(np.arange(len(g)) for g in found), np.empty(0, np.int64)]).astype(np.int64)[order]
        self.grams, self.first, self.count = np.unique(all_grams[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(self.grams)] = True

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def candidates(self, texts: list[str]) -> np.ndarray:
        """Rows (text, item, lowest diagonal of the band, places, first and last place in the item) of all regions that reach the bound.

        A region is a run of places of the item, in one band, of which every one lies
        within REGION characters that share as many grams as the lemma asks for.
        """
        codes = np.frombuffer("\n".join(texts).encode() + b"\n", np.uint8)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        g = grams(codes)
        at = np.flatnonzero(self.maybe[self._slot(g)])
        where = np.searchsorted(self.grams, g[at])
        where[where == len(self.grams)] = 0
        hit = self.grams[where] == g[at] if len(self.grams) else np.zeros(len(at), bool)
        at, where = at[hit], where[hit]
        out, size = [np.empty((0, 6), np.int64)], np.cumsum(self.count[where]) if len(at) else np.empty(0, np.int64)
        text_of = np.searchsorted(starts, at, "right") - 1
        # texts are taken whole, some millions of hits at a time
        cuts = [0]
        while cuts[-1] < len(at):
            limit = (size[cuts[-1] - 1] if cuts[-1] else 0) + 1_000_000
            end = int(np.searchsorted(size, limit, "right"))
            if end < len(at):
                back = int(np.searchsorted(text_of, text_of[end]))
                end = back if back > cuts[-1] else int(np.searchsorted(text_of, text_of[cuts[-1]], "right"))
            cuts.append(max(end, cuts[-1] + 1))
        for a, b in zip(cuts, cuts[1:], strict=False):
            n = self.count[where[a:b]]
            posting = np.repeat(self.first[where[a:b]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            pair = np.repeat(text_of[a:b] * len(self.texts), n) + self.item[posting]
            diagonal = np.repeat(at[a:b] - starts[text_of[a:b]], n) - self.place[posting]
            out.append(self._regions(pair, diagonal, self.place[posting]))
        return np.concatenate(out)

    def _regions(self, pair: np.ndarray, diagonal: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The rows of candidates() for some texts, from the pair, diagonal and place of each shared gram."""
        half = diagonal // STEP
        # half a band and a neighbour must hold enough; counted in slots that several may share, so none is lost
        own = (((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).view(np.int64) + half) & np.int64((1 << _SLOTS) - 1)
        counts = np.bincount(own + 1, minlength=(1 << _SLOTS) + 2)
        counts[0], counts[-1] = counts[-2], counts[1]
        enough = counts[1:-1] + np.maximum(counts[:-2], counts[2:])
        full = np.flatnonzero(enough[own] >= self.need.min())
        full = full[enough[own[full]] >= self.need[pair[full] % len(self.texts)]]
        pair, diagonal, place, half = pair[full], diagonal[full], place[full], half[full]
        # the band that begins at half-band h holds h and h + 1, so every gram lies in two
        pair, diagonal, place, band = np.tile(pair, 2), np.tile(diagonal, 2), np.tile(place, 2), np.concatenate([half, half - 1])
        order = np.lexsort((place, band, pair))
        pair, diagonal, place, band = pair[order], diagonal[order], place[order], band[order]
        if not len(pair):
            return np.empty((0, 6), np.int64)
        fresh = np.r_[True, (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])]
        # a place counts once in a band, however many grams of the text repeat it
        one = np.flatnonzero(fresh | np.r_[True, place[1:] != place[:-1]])
        group = np.cumsum(fresh)[one]
        end = np.arange(len(one)) + self.need[pair[one] % len(self.texts)] - 1
        ok = end < len(one)
        begin, end = np.flatnonzero(ok), end[ok]
        ok = (group[begin] == group[end]) & (place[one[end]] - place[one[begin]] <= REGION - Q)
        begin, end = begin[ok], end[ok]
        if not len(begin):
            return np.empty((0, 6), np.int64)
        # windows that overlap in a band are one region; both ends rise together
        split = np.r_[True, (group[begin[1:]] != group[begin[:-1]]) | (begin[1:] > end[:-1])]
        first, last = begin[split], end[np.r_[np.flatnonzero(split)[1:] - 1, len(end) - 1]]
        low, top = (f.reduceat(np.r_[diagonal, diagonal[-1]], np.column_stack([one[first], np.r_[one, len(pair)][last + 1]]).ravel())[::2] for f in (np.minimum, np.maximum))
        rows = np.column_stack([pair[one[first]] // len(self.texts), pair[one[first]] % len(self.texts), band[one[first]] * STEP, last - first + 1, place[one[first]], place[one[last]]])
        # a region whose grams all lie where two bands overlap stands in both
        same = np.lexsort((rows[:, 2], top, low, rows[:, 5], rows[:, 4], rows[:, 1], rows[:, 0]))
        keys = np.column_stack([rows[:, [0, 1, 4, 5]], low, top])[same]
        return rows[same[np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]]]

    def _strips(self, texts: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What rows are aligned on: strips of the text and of the item, the item's first place, the text's place on the lowest diagonal, and the heights."""
        low = np.maximum(rows[:, 4] - ROOM, 0)
        tall = np.array([min(len(self.codes[i]), z + Q + ROOM) for i, z in zip(rows[:, 1], rows[:, 5], strict=True)], np.int64) - low
        most, width = int(tall.max()) if len(rows) else 0, BAND + 2 * MARGIN
        item, base = np.zeros((len(rows), most), np.uint8), rows[:, 2] - MARGIN + low
        text = np.full((len(rows), most + width), 255, np.uint8)
        for k, (t, i) in enumerate(rows[:, :2]):
            item[k, : tall[k]] = self.codes[i][low[k] : low[k] + tall[k]]
            a, z = max(0, base[k]), min(len(texts[t]), base[k] + most + width)
            text[k, a - base[k] : max(a, z) - base[k]] = np.frombuffer(texts[t][a:z].encode(), np.uint8)
        return text, item, low, base, tall

    def scores(self, texts: list[str], rows: np.ndarray) -> np.ndarray:
        """The score of the best local alignment of each row, as in aligned(), without its course."""
        text, item, _, _, tall = self._strips(texts, rows)
        width = BAND + 2 * MARGIN
        item[np.arange(item.shape[1]) >= tall[:, None]] = 254  # equal to no sign
        score, best = np.zeros((len(rows), width), np.int32), np.zeros((len(rows), width), np.int32)
        slope = 2 * np.arange(width, dtype=np.int32)
        for i in range(item.shape[1]):
            new = score + np.where(text[:, i : i + width] == item[:, i][:, None], np.int32(1), np.int32(-2))
            np.maximum(new[:, :-1], score[:, 1:] - 2, out=new[:, :-1])
            score = np.maximum(np.maximum.accumulate(new + slope, axis=1) - slope, 0)
            np.maximum(best, score, out=best)
        return best.max(axis=1) if len(rows) else np.zeros(0, np.int32)

    def aligned(self, texts: list[str], rows: np.ndarray) -> pd.DataFrame:
        """The best local alignment of each row within its band and the margins: start and end in the text and in the item, and edits.

        Equal characters score 1, an edit -2. All rows advance through their items
        together, a character at a time, over a matrix of rows and diagonals. A row
        is aligned from ROOM characters before its first shared gram to ROOM behind
        its last.
        """
        text, item, low, base, tall = self._strips(texts, rows)
        n, width, high = len(rows), BAND + 2 * MARGIN, tall
        tall = int(high.max()) if n else 0
        d, r = np.arange(width), np.arange(n)
        score, edits, from_text, from_item = (np.zeros((n, width), np.int32) for _ in range(4))
        best, span = np.zeros(n, np.int32), np.zeros((n, 5), np.int64)
        for i in range(tall):
            here = text[:, i : i + width]
            ok = (here != 255) & (i < high)[:, None]
            same = ok & (here == item[:, i][:, None])
            fresh = score == 0
            new, new_edits = np.where(same, score + 1, score - 2), np.where(fresh, ~same, edits + ~same)
            new_text, new_item = np.where(fresh, d + i, from_text), np.where(fresh, i, from_item)
            take = score[:, 1:] - 2 > new[:, :-1]  # the item's character is missing in the text: from the diagonal above
            for x, y in ((new, score - 2), (new_edits, edits + 1), (new_text, from_text), (new_item, from_item)):
                x[:, :-1] = np.where(take, y[:, 1:], x[:, :-1])
            # the text has characters more: from a diagonal below in the same row, at 2 for each
            source = np.maximum.accumulate((new + 2 * d) * width + (width - 1 - d), axis=1)
            come = width - 1 - source % width
            new = np.take_along_axis(new, come, 1) - 2 * (d - come)
            new_edits = np.take_along_axis(new_edits, come, 1) + d - come
            from_text, from_item = np.take_along_axis(new_text, come, 1), np.take_along_axis(new_item, come, 1)
            score = np.where(ok, np.maximum(new, 0), 0)
            edits = np.where(score > 0, new_edits, 0)
            top = score.argmax(axis=1)
            better = score[r, top] > best
            if better.any():
                best = np.where(better, score[r, top], best)
                span[better] = np.column_stack([from_text[r, top] + base, base + top + i + 1, from_item[r, top] + low, low + i + 1, edits[r, top]])[better]
        return pd.DataFrame(span, columns=["text_start", "text_end", "item_start", "item_end", "edits"])

    def leaks(self, texts: list[str]) -> pd.DataFrame:
        """(text, item, diagonal, grams, first, last, text_start, …, edits, exact): of each pair that is a leak the first accepted region, by the grams of its band.

        Regions whose best score is below that of any leak end first. The others of a
        pair are aligned one after the other, those with most places first, until one is accepted: a near copy, or in a pair with an exact run a
        region as long as the shortest run. A pair ends without a row after its last region.
        """
        rows = self.candidates(texts)
        brief = [(t, k, text.find(self.texts[k]), 0, 0, len(self.texts[k])) for k in self.short for t, text in enumerate(texts) if self.texts[k] in text]
        rows = np.concatenate([rows, np.array(brief, np.int64).reshape(-1, 6)])
        rows = rows[np.argsort(rows[:, 5] - rows[:, 4], kind="stable")]  # regions of like height are aligned together
        score = np.concatenate([self.scores(texts, rows[a : a + 1000]) for a in range(0, max(len(rows), 1), 1000)])
        rows = rows[score >= np.minimum(_LEAST_SCORE, self.least()[rows[:, 1]])]
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 3], rows[:, 1], rows[:, 0]))]
        begins = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]) if len(rows) else np.empty(0, np.int64)
        ends = np.r_[begins[1:], len(rows)]
        exact = np.array([any(w in texts[t] for w in self.windows[k]) for t, k in rows[begins, :2]], bool)
        least, out = self.least(), []
        while len(begins) or not out:
            order = np.argsort(rows[begins, 5] - rows[begins, 4], kind="stable")
            begins, ends, exact = begins[order], ends[order], exact[order]
            now = rows[begins]
            found = pd.concat([self.aligned(texts, now[a : a + 500]) for a in range(0, max(len(now), 1), 500)], ignore_index=True)
            found = pd.concat([pd.DataFrame(now, columns=["text", "item", "diagonal", "grams", "first", "last"]), found], axis=1).assign(exact=exact)
            length = found["item_end"] - found["item_start"]
            accepted = ((length >= REGION) & (found["edits"] <= EDITS * length) | exact & (length >= least[now[:, 1]])).to_numpy(bool)
            out.append(found[accepted])
            more = ~accepted & (begins + 1 < ends)
            begins, ends, exact = begins[more] + 1, ends[more], exact[more]
        return pd.concat(out, ignore_index=True)

    def least(self) -> np.ndarray:
        """Of each item the characters of its shortest run of RUN tokens: an alignment shorter than that is no leak."""
        return np.array([min(map(len, w)) for w in self.windows], np.int64)


def _search(block: list[tuple[int, str]]):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = GramIndex(block)
        for b in (s for batch in batches for s in slices(batch, "text")):
            found = index.leaks([normal_text(t) for t in b["text"].where(b["text"].notna(), None)])
            out = found.assign(doc_id=b["doc_id"].to_numpy()[found["text"]], item_id=[index.ids[k] for k in found["item"]],
                               item_share=[round(n / len(index.texts[k]), 6) for n, k in zip(found["item_end"] - found["item_start"], found["item"], strict=True)])
            yield out.explode("item_id")[["doc_id", "item_id", "exact", "grams", "edits", "item_start", "item_end", "item_share"]].astype({"item_id": "int64", "exact": bool, "item_share": float})

    return run


def item_blocks(items: DataFrame, chars: int = BLOCK_CHARS) -> list[list[tuple[int, str]]]:
    """The items with tokens as (id, normal text), in blocks of at most `chars` characters or one item.

    Items are the held-out set, not the corpus: 409 at every scale here. They come
    to the driver one at a time, and no index is ever larger than a block.
    """
    blocks, size = [[]], 0
    for row in items.select("item_id", "prompt").filter("prompt IS NOT NULL").distinct().orderBy("item_id", "prompt").toLocalIterator():
        text = normal_text(row["prompt"])
        if text:
            if blocks[-1] and size + len(text) > chars:
                blocks.append([])
                size = 0
            blocks[-1].append((row["item_id"], text))
            size += len(text)
    return blocks


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, exact, grams, edits, item_start, item_end, item_share): documents that hold text of an item's prompt.

    exact: RUN consecutive tokens of the prompt, or all tokens of a shorter prompt,
    stand in a row in the text. The other rows are near copies of at least REGION
    characters. grams is the number of the item's places in the region, and the other columns tell of the
    best aligned region: its edits, its place in the item's normal text and its
    share of that text.

    Null and blank prompts or texts match nothing. A prompt under several ids gives
    a row for each. Repeated documents give one row a pair. The documents are read
    once for each block of items, and no document or pair is shuffled before it is
    found: a prompt in a third of all documents costs no more than another.
    """
    texts = spread(documents.select("doc_id", "text").filter("text IS NOT NULL"), "doc_id")
    schema = "doc_id long, item_id long, exact boolean, grams long, edits long, item_start long, item_end long, item_share double"
    out = None
    for block in item_blocks(items):
        found = texts.mapInPandas(_search(block), schema)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item with a leak: suite, documents, and documents per source in order of the source."""
    pairs = leaks(documents, items).filter("exact").join(documents.select("doc_id", "source").distinct(), "doc_id")
    per = pairs.groupBy("item_id", F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count_distinct("doc_id").alias("documents"))
    return per.join(items.groupBy("item_id").agg(F.max("suite").alias("suite")), "item_id").select("item_id", "suite", "source", "documents")
