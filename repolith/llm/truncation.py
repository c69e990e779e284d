"""Texts that were cut off by a field limit or during transfer.

Intact texts are cut artificially, and a logistic regression over hashed features of
the ending, of its punctuation and of the distance to the source's length limit
learns to tell cut from intact. Every text is then scored, and copies share the
highest score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolith.session import cut, slices, spread

#: Texts, about, that the regression is fitted on.
SAMPLE = 20_000
#: Bits of the table of word counts; words that share a slot are counted together.
WORD_BITS = 20
#: Texts with a word are counted as a share of all texts, in steps that double; below the first step it is unknown.
WORD_SHARE = 2.0**-12
#: Characters of a text at most that the regression is fitted on; longer ones are scored, but not fitted on.
SAMPLE_CHARS = 8_000
BITS = 18
#: Score from which a text counts as cut.
CUT = 0.5
#: Texts taken for intact that a first fit scores above this are left out of the second: some of them were cut.
DOUBT = -1.0
#: Length below the limit, in characters or bytes, that still counts as at the limit.
NEAR = 4

_WORD = r"\p{Lu}?\p{Ll}+|\p{Lu}+|\p{Lo}+"
_PART = re.compile(r"[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+|[^\W\d_]+")
_MARK = re.compile(r"(?:\.\.\.|…|\[(?:\.\.\.|…|truncated|cut|more)\]|\((?:more|continued)\)|�+)\s*\Z", re.I)
_KINDS = [(k, re.compile(p)) for k, p in (
    ("fence", r"\s*```"), ("trailer", r"(?:[A-Z][a-z]+(?:-[a-z]+)*): \S"), ("sign", r"\s*[—–-]{1,2} ?the "), ("dash", r"\s*[—–]"), ("head", r"#+ "), ("row", r"\s*\|"), ("item", r"\s*(?:[-*+•]|\d+[.)]) "),
    ("quote", r"\s*>"), ("comment", r"\s*(?://|/?\*|#)"), ("indent", r"(?:\s{2,}|\t)\S"), ("brace", r"\s*[{}()\[\]]"), ("speaker", r"\w+: "), ("plain", r""))]


def char_class(c: str) -> str:
    """What a character says of an ending."""
    if not c:
        return "none"
    if c in ".!?。！？؟।":
        return "end"
    if c in ",;:，；：、":
        return "pause"
    if c in ")]}»”’\"'`*|>":
        return "close"
    if c in "([{«“‘<":
        return "open"
    if c == "�":
        return "broken"
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "latin" if c.isascii() else "letter" if c.lower() != c.upper() else "script"
    return "space" if c.isspace() else "sign"


def _kind(line: str) -> str:
    return next(k for k, p in _KINDS if p.match(line))


def _slot(word: str) -> int:
    return zlib.crc32(word.lower().encode(errors="replace")) & ((1 << WORD_BITS) - 1)


def _df(word: str, known: np.ndarray) -> int:
    return min(8, int(known[_slot(word)])) if word else 0


def features(text: str, doc_type: str | None, short: tuple[int, int], known: np.ndarray) -> list[str]:
    """What the ending of a whole text shows.

    short: characters and bytes that it is below its source's limits, -1 where the
    source has none. known: by slot of a word, the step of the share of texts in which it occurs before the end.
    """
    whole = text.rstrip()
    mark = _MARK.search(whole)
    body = whole[: mark.start()].rstrip() if mark else whole
    lines = body.split("\n")
    last = lines[-1].rstrip("\r")
    kind = _kind(last) if last else "empty"
    before = next((x.rstrip() for x in reversed(lines[:-1]) if x.strip()), "")
    before_kind = _kind(before) if before else "none"
    c = char_class(body[-1:])
    fenced = sum(x.lstrip().startswith("```") for x in lines) % 2
    words = last.split()
    word = words[-1] if words else ""
    parts = _PART.findall(word)
    part = parts[-1] if parts else ""
    df = _df(part, known)
    first = _df(parts[0], known) if len(parts) > 1 else 9
    at_end = part != "" and word.endswith(part)
    like = sum(1 for x in lines[:-1] if _kind(x) == kind and x.strip())
    like_end = sum(1 for x in lines[:-1] if x.strip() and _kind(x) == kind and char_class(x.rstrip()[-1:]) == c)
    agrees = "few" if like < 2 else "most" if like_end * 2 > like else "some" if like_end else "none"
    open_ = "".join(o for o, z in ("()", "[]", "{}", "“”", "«»") if last.count(o) > last.count(z)) + ("'" if last.count("`") % 2 else "") + ('"' if last.count('"') % 2 else "")
    bars = (last.count("|") - before.count("|")) if kind == "row" and before_kind == "row" else 0
    sentence = re.split(r"[.!?]\s", last)[-1]
    length = min(7, len(sentence.split()).bit_length())
    ends = any(char_class(x.rstrip()[-1:]) == "end" for x in lines[:-1])
    single = "1" if len([x for x in lines if x.strip()]) == 1 else "n"
    limit = ["at" if 0 <= n < NEAR else "near" if 0 <= n < 16 else "none" if n < 0 else "far" for n in short]
    shape = re.sub(r"\d+", "0", re.sub(r"[a-zß-ÿ]+", "a", re.sub(r"[A-Z]+", "A", word)))[-6:]
    return [
        f"c={c}", f"1={body[-1:]}", f"2={body[-2:]}", f"3={body[-3:]}", f"4={body[-4:]}", f"w={word.lower()}", f"w2={' '.join(words[-2:]).lower()}", f"p={part.lower()}", f"df={df}{at_end}", f"first={first},{df}{at_end}",
        f"mark={mark[0].strip()[:4] if mark else ''}", f"k={kind}", f"kc={kind},{c}", f"kcf={kind},{c},{fenced}", f"kcd={kind},{c},{df},{at_end}", f"kca={kind},{c},{agrees}", f"kb={kind},{before_kind},{c}", f"open={open_}", f"kopen={kind},{c},{open_ != ''}",
        f"fence={fenced}", f"fc={fenced},{kind},{body[-1:]}", f"bars={bars}", f"rowc={kind == 'row'},{last.endswith('|')},{bars}", f"len={length},{c},{kind}", f"shape={shape},{kind}", f"t={doc_type},{kind},{c}", f"ts={doc_type},{single},{c}", f"ss={single},{kind},{c},{df},{at_end}",
        f"nw={min(9, len(words))},{kind},{c},{single}", f"lim={limit[0]}", f"limb={limit[1]}", f"limc={'at' in limit},{c}", f"sp={text != whole and not text[len(whole):].strip(chr(32))},{c}", f"up={sentence[:1].isupper()},{c},{kind}", f"ends={ends},{kind},{c}",
        f"tail={' '.join(x if x.islower() else '^' for x in words[-3:])}", f"begin={words[0][:6] if words else ''},{c}", f"kn={kind},{min(6, len(words))},{df},{at_end}", f"odd={len(part)},{df},{at_end}", f"ab={char_class(before[-1:])},{kind},{c}",
    ]


def _row(example: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(f"{i}{x}".encode()) & ((1 << BITS) - 1) for i, x in enumerate(example)], np.int32)


def fit(rows: np.ndarray, label: np.ndarray, epochs: int = 12, rate: float = 0.15, decay: float = 2e-6, seed: int = 7) -> np.ndarray:
    """Weights of a logistic regression over hashed features, the last being the bias; every step scales by the squared gradients so far."""
    if not len(label):
        return np.zeros((1 << BITS) + 1)
    used, rows = np.unique(np.column_stack([rows, np.full(len(rows), 1 << BITS, rows.dtype)]), return_inverse=True)
    rows, rng = rows.reshape(len(label), -1), np.random.default_rng(seed)
    w, g2 = np.zeros(len(used)), np.full(len(used), 1e-4)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), 256):
            part = order[a : a + 256]
            x = rows[part]
            error = 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30))) - label[part]
            g = np.bincount(x.ravel(), np.repeat(error, x.shape[1]), len(w)) / len(part) + decay * w
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
    out = np.zeros((1 << BITS) + 1)
    out[used] = w
    return out


def cut_at_random(text: str, rng: np.random.Generator) -> str | None:
    """A text cut inside a word or sentence, sometimes with a mark at the cut; None if it is too short to have such a place."""
    body = text.rstrip()
    for _ in range(8):
        n = int(rng.integers(max(12, len(body) // 8), max(13, len(body) - 2))) if len(body) > 24 else 0
        if not n:
            return None
        if rng.random() < 0.12:  # some cuts fall into the last line, where forms without a full stop end
            n = int(rng.integers(max(12, body.rfind("\n") + 4), len(body) - 1)) if body.rfind("\n") + 6 < len(body) else n
        kept, rest = body[:n], body[n:]
        if rest.startswith(("\n", "\r")) or kept.endswith("\n") or not rest.strip():
            continue
        if char_class(kept.rstrip()[-1:]) == "end" and rest[:1].isspace():
            continue
        way = rng.random()
        if way < 0.2:
            kept = kept.rstrip() + ("..." if rng.random() < 0.7 else "…")
        elif way < 0.26:
            kept += "�"
        return kept
    return None


def limits(documents: DataFrame) -> DataFrame:
    """(source, max_chars, max_bytes): the length limits of each source, null where it has none.

    A length is a limit where at least three different texts, and a hundredth of
    the source's, are less than NEAR shorter, and at most a quarter as many are longer; of
    several the greatest is taken. Only lengths and hashes are
    shuffled, and texts of one length are counted before they meet those of others.
    """
    lengths = documents.filter("text IS NOT NULL").select("source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("h")).distinct()
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("length")) for k in ("chars", "bytes"))))
    counts = lengths.groupBy("source", "chars", "bytes").agg(F.count("*").alias("n")).select("source", "n", kinds.alias("l")).groupBy("source", "l.kind", "l.length").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("source", "kind").orderBy("length")
    sums = counts.select("source", "kind", "length", F.sum("n").over(of.rangeBetween(1 - NEAR, 0)).alias("near"), F.sum("n").over(of.rangeBetween(1, Window.unboundedFollowing)).alias("longer"),
                         F.sum("n").over(Window.partitionBy("source", "kind")).alias("all"))
    limit = F.when((F.col("near") >= 3) & (F.col("near") * 100 >= F.col("all")) & (F.coalesce("longer", F.lit(0)) * 4 <= F.col("near")), F.col("length"))
    return sums.groupBy("source").agg(*(F.max(F.when(F.col("kind") == k, limit)).alias(f"max_{k}") for k in ("chars", "bytes")))


def word_shares(documents: DataFrame) -> tuple[np.ndarray, int]:
    """By slot of a word the step of the share of texts in which a word of that slot occurs other than at the end, and the number of texts.

    All words of all texts are counted. A slot's share is all that reaches the
    driver, so what does is bounded by WORD_BITS, and it means the same at every size of the corpus.
    """
    words = F.transform(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), F.lower)
    inner = F.array_distinct(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))))
    slots = F.transform(inner, lambda x: F.crc32(x.cast("binary")).bitwiseAND((1 << WORD_BITS) - 1).cast("int"))
    counts = documents.filter("text IS NOT NULL").select(F.explode(F.array_append(slots, F.lit(-1))).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    found = counts.toPandas()
    n = int(found.loc[found["slot"] == -1, "n"].sum())
    found = found[found["slot"] >= 0]
    out = np.zeros(1 << WORD_BITS, np.uint8)
    out[found["slot"].to_numpy(np.int64)] = np.log2(np.maximum(found["n"].to_numpy(float) / max(n, 1) / WORD_SHARE, 0.5)).astype(int) + 1
    return out, n


def _examples(seed: int, shared):  # noqa: ANN001, ANN202
    """Rows of features of each text as it is and cut, as bytes; label 1 for a cut text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, top = shared.value
        for b in batches:
            b, out = b.astype(object).where(b.notna(), None), []
            for text, source, doc_type, h in zip(b["text"], b["source"], b["doc_type"], b["h"], strict=True):
                rng = np.random.default_rng([seed, h & (2**63 - 1)])
                c, z = top.get(source, (None, None))
                short = below(text, c, z)
                if not any(0 <= n < NEAR for n in short):
                    out.append((h, 0, _row(features(text, doc_type, short, known)).tobytes()))
                if cut := cut_at_random(text, rng):
                    at = (0 if c and rng.random() < 0.6 else 40 if c else -1, 0 if z and rng.random() < 0.6 else 40 if z else -1)
                    out.append((h, 1, _row(features(cut, doc_type, at, known)).tobytes()))
            yield pd.DataFrame(out, columns=["h", "label", "row"])

    return run


def model(documents: DataFrame, sample: int = SAMPLE, seed: int = 11) -> tuple[np.ndarray, np.ndarray, dict[str | None, tuple[int | None, int | None]], float]:
    """Weights, word shares, limits by source, and the share of held-out examples that are told right.

    The regression is fitted on about `sample` texts of at most SAMPLE_CHARS
    characters, those whose hash lies below that share of all: as they are, if not
    at their source's limit, and cut; a text of the first kind that looks cut to a
    fit on the other half of the texts is left out. A tenth is held out. Words and limits are counted over all
    documents; limits are as many as sources. The executors make the features;
    only rows of hashes reach the driver.
    """
    known, n = word_shares(documents)
    top = {r["source"]: (r["max_chars"], r["max_bytes"]) for r in limits(documents).toLocalIterator()}
    shared = documents.sparkSession.sparkContext.broadcast((known, top))
    chosen = documents.filter(F.col("text").rlike(r"\S") & (F.length("text") <= SAMPLE_CHARS)).select("text", "source", "doc_type", F.xxhash64("text", F.lit(seed)).alias("h"))
    if n > sample:
        chosen = chosen.filter(F.col("h") < int(2**64 * (sample / n)) - 2**63)
    made = spread(chosen, "h").mapInPandas(_examples(seed, shared), "h long, label int, row binary").toPandas().sort_values(["h", "label", "row"])
    if made["label"].nunique() < 2:
        return np.zeros((1 << BITS) + 1), known, top, 1.0
    rows, y = np.frombuffer(b"".join(made["row"]), np.int32).reshape(len(made), -1), made["label"].to_numpy(float)
    test = made["h"].to_numpy(np.int64) % 10 == 0
    half, doubtful = made["h"].to_numpy(np.int64) // 10 % 2 == 0, np.zeros(len(y), bool)
    for fold in (half, ~half):  # a text is doubted by a fit that has not seen it
        w = fit(rows[~fold & ~test], y[~fold & ~test])
        doubtful[fold] = (y[fold] == 0) & (w[rows[fold]].sum(axis=1) + w[-1] > DOUBT)
    w = fit(rows[~test & ~doubtful], y[~test & ~doubtful])
    test &= ~doubtful
    right = float(((w[rows[test]].sum(axis=1) + w[-1] > 0) == (y[test] > 0)).mean()) if test.any() else 1.0
    return w, known, top, right


def below(text: str, chars: int | None, nbytes: int | None) -> tuple[int, int]:
    """Characters and bytes that a text is below the limits, -1 where there is none."""
    return (-1 if chars is None else chars - len(text), -1 if nbytes is None else nbytes - len(text.encode()))


def scored(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, source, score): the probability that a text was cut, of every document with text other than blanks.

    Equal texts have the highest score that one of them gets, so a copy under
    another source is judged with its original; only hashes and scores meet, and
    a text of which there are many copies is reduced before they do. Scores are
    made once and kept in the shared checkpoint folder.
    Null, empty and blank texts have no row; null source and doc_type are values
    like others. A table without texts, or only of texts too short to cut, gives
    score 0.5 to each. Weights and word shares are broadcast; they are bounded by
    BITS and WORD_BITS, and the limits by the number of sources.
    """
    w, known, top, _ = model(documents, sample)
    shared = documents.sparkSession.sparkContext.broadcast((w, known, top))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, known, top = shared.value
        for b in (s for batch in batches for s in slices(batch, "text")):
            b = b.astype(object).where(b.notna(), None)
            rows = [_row(features(t, k, below(t, *top.get(s, (None, None))), known)) for t, s, k in zip(b["text"], b["source"], b["doc_type"], strict=True)]
            z = w[np.array(rows)].sum(axis=1) + w[-1] if rows else np.empty(0)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("int64"), "source": b["source"], "copy": b["copy"], "score": [1 / (1 + exp(-max(-30.0, min(30.0, x)))) for x in z]})

    texts = documents.filter(F.col("text").rlike(r"\S")).select("doc_id", "text", "source", "doc_type", F.md5("text").alias("copy"))
    each = cut(spread(texts, "doc_id").mapInPandas(run, "doc_id long, source string, copy string, score double"))
    best = each.groupBy("copy").agg(F.max("score").alias("score"))
    return each.select("doc_id", "source", "copy").join(best, "copy").select("doc_id", "source", F.round("score", 6).alias("score")).distinct()


def cut_share(documents: DataFrame, least: float = CUT) -> DataFrame:
    """Per source: documents with text, those that are cut, and their share."""
    return scored(documents).groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= least).alias("cut"),
                                                  F.round(F.avg((F.col("score") >= least).cast("double")), 6).alias("share"))
