from __future__ import annotations

import random
import re
import unicodedata

from repolith.llm import leakage as L


def toks(t):
    return [x.lower() for x in re.findall("[A-Za-z0-9_]+", unicodedata.normalize("NFKC", t or ""))]


def leaked(text, prompt) -> bool:
    a, b = toks(text), toks(prompt)
    n = min(len(b), L.RUN)
    return n > 0 and any(a[i : i + n] == b[j : j + n] for i in range(len(a) - n + 1) for j in range(len(b) - n + 1))


DOC, ITEM = "doc_id long, text string, source string, item_id int, exact string", "item_id long, prompt string, suite string, doc_id int"


def tables(spark, docs, items):
    return spark.createDataFrame([(i, t, s, 0, "x") for i, t, s in docs], DOC), spark.createDataFrame([(i, p, s, 0) for i, p, s in items], ITEM)


def test_against_brute_force(spark):
    r = random.Random(9)
    word = lambda: r.choice(["a", "b", "the", "Index", "x_1", "größe", "ｆｕｌｌ", "42"]) + ("" if r.random() < 0.5 else str(r.randrange(30)))
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 8, 11, 12, 14, 40]))), "s") for i in range(40)] + [(100, None, "s"), (101, "  \n", "s"), (102, "…", "s")]
    items.append((200, items[5][1].upper(), "s"))
    docs = []
    for d in range(120):
        text = [word() for _ in range(r.randrange(5, 80))]
        for _ in range(r.randrange(3)):
            p = (r.choice(items)[1] or "").split()
            a = r.randrange(len(p) + 1)
            text[r.randrange(len(text)) : 0] = p[a : a + r.choice([5, 11, 12, 30])]
        docs.append((d, r.choice([" ", "\n", " - "]).join(text), None))
    docs += [(900, None, "s"), (901, "", "s"), (902, "!", "s"), (5, docs[5][1], None)]
    want = {(d, i) for d, t, _ in docs for i, p, _ in items if leaked(t, p)}
    assert {(x["doc_id"], x["item_id"]) for x in L.leaks(*tables(spark, docs, items)).filter("exact").collect()} == want and len(want) > 30
    blocks = L.item_blocks(tables(spark, docs, items)[1], chars=60)
    assert len(blocks) > 5 and sorted(i for b in blocks for i, _ in b) == sorted(i for i, p, _ in items if toks(p))


def test_near_copies_and_alignment(spark):
    prompt = "Given a tracker tree of depth six whose leaves hold eight frontiers determine how often sync ranking must defer the root when every cluster is renamed"
    near = prompt.replace("leaves hold", "leafs hold").replace("often", "oftn")
    docs, items = tables(spark, [(1, "Intro. " + near + " End.", "a"), (2, "unrelated text " * 30, "a"), (3, "x " * 5000 + prompt.upper() + " y" * 5000, "b")], [(7, prompt, "s")])
    got = {x["doc_id"]: x for x in L.leaks(docs, items).collect()}
    assert set(got) == {1, 3} and got[3]["exact"] and got[3]["edits"] == 0 and got[3]["item_share"] > 0.99
    assert got[1]["edits"] == 3 and not got[1]["exact"]
    assert [tuple(x) for x in L.leaked_items(docs, items).collect()] == [(7, "s", "b", 1)]


def test_empty(spark):
    docs, items = tables(spark, [(1, "some text", None)], [(1, "some text", None)])
    assert L.leaks(docs, items).filter("exact").count() == 1
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0
    assert L.leaked_items(docs, items).first()["source"] == "unknown"


def test_leak_outside_the_band_with_most_grams(spark):
    r = random.Random(3)
    words = lambda n: ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(5)) for _ in range(n)]
    run, rule = words(12), "_" * 40
    text, docs, items = " ".join(run), [], []
    near = text[:20] + "z" + text[21:50] + "z" + text[51:]
    for i, part in enumerate([text, near, " ".join(run[:9]), "0x" + "0" * 40 + " " + text]):
        items.append((i, " ".join([*words(6), text, *words(9), rule, *words(3)]), "s"))
        docs.append((i, " ".join([*words(30), rule, *words(17), part, *words(30)]), "a"))
    docs, items = tables(spark, docs, items)
    got = {(x["doc_id"], x["item_id"]): x for x in L.leaks(docs, items).collect()}
    assert {d for d, _ in got} == {0, 1, 3} and len(got) == 12
    assert all(x["exact"] == (d != 1) and x["edits"] == (2 if d == 1 else 0) and x["item_end"] - x["item_start"] >= L.REGION for (d, _), x in got.items())


def test_adversarial_texts_against_brute_force():
    """Long words that share most grams beside a run of short ones, repetition, and regions at both ends of a text."""
    r = random.Random(4)
    long_, short = lambda: "".join(r.choice("abcdefgh") for _ in range(14)), lambda: "".join(r.choice("ijkl") for _ in range(3))
    items, texts = [], []
    for i in range(12):
        words, run = [long_() for _ in range(60)], [short() for _ in range(12)]
        items.append((i, " ".join(words + run)))
        every_second = " ".join(w if k % 2 else long_() for k, w in enumerate(words))
        texts += [every_second + " " + long_() + " " + " ".join(run), every_second + " " + " ".join(run[:11]), " ".join(run) + " " + every_second,
                  "0" * 300 + " " + " ".join(words[:6]) + " " + "ab " * 90 + " ".join(run), " ".join(words[5:17]), " ".join(words[5:16])]
    items += [(50, "ab " * 40), (51, "ab " * 11 + "zz"), (52, "0" * 300)]
    index = L.GramIndex([(i, L.normal_text(t)) for i, t in items])
    found = index.leaks([L.normal_text(t) for t in texts])
    got = {(t, i) for t, k in zip(found["text"][found["exact"]], found["item"][found["exact"]], strict=True) for i in index.ids[k]}
    want = {(t, i) for t, text in enumerate(texts) for i, p in items if leaked(text, p)}
    assert got == want and len(want) > 60


def test_scores_are_those_of_the_alignment():
    r = random.Random(8)
    base = " ".join("".join(r.choice("abcde") for _ in range(r.randrange(1, 9))) for _ in range(60))
    index = L.GramIndex([(1, L.normal_text(base))])
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(r.randrange(9)):
            k = r.randrange(len(t))
            t[k : k + r.randrange(2)] = r.choice(["", "x", "yz"])
        texts.append(L.normal_text("".join(t)[r.randrange(40) :]))
    rows = index.candidates(texts)
    found = index.aligned(texts, rows)
    length = found["item_end"] - found["item_start"]
    assert len(rows) >= 60 and (index.scores(texts, rows) >= length - 3 * found["edits"]).all()
    assert (index.scores(texts, rows) <= length).all()
