from __future__ import annotations

import random

import pytest

from repolith.llm import generated as G


def hand(seed: int, n: int = 12) -> str:
    r, out = random.Random(seed), []
    for _ in range(n):
        name = "".join(r.choice("abcdefghij") for _ in range(8))
        out.append(f"def {name}(a, b):")
        for _ in range(r.randrange(2, 6)):
            v = "".join(r.choice("klmnopqrst") for _ in range(7))
            out.append(r.choice([f"    {v} = a + {r.randrange(99)}", f"    log.info('{v}')", f"    for {v} in range(b):\n        a -= {v}", f"    if a > {r.randrange(99)}:\n        return [{v} for {v} in b]", f"    {v} = {{'{v}': a}}"]))
        out.append("    return a\n")
    return "\n".join(out)


TABLE = "LIMITS = {\n" + "".join(f"    'key{i}': {i * 7 % 91},\n" for i in range(80)) + "}\n" + hand(1, 4)


@pytest.mark.parametrize(("text", "kind"), [
    ("", None), (hand(1), None), (hand(2).replace("    ", "\t"), None), (TABLE, None), ("x", None), ("# not generated, edit freely\n" + hand(3), None), (hand(4) + "\nlog.info('DO NOT EDIT')\n", None), ("# " + "words about it " * 90 + "\n" + hand(5), None),
    ("# Code generated by tool v1. DO NOT EDIT.\n" + hand(6), "generated"), ("package a\n\n// @generated by x\nfunc f() {}\n", "generated"), ("// <auto-generated>\nclass A {}\n", "generated"),
    ("class A {\n" + "".join(f"  private int f{i}_;\n  public int get{i}() {{\n    return f{i}_;\n  }}\n" for i in range(20)) + "}\n", "generated"), ("".join(f"const K_{i} = {i * 3};\n" for i in range(40)), "generated"),
    ("!function(e,t){" + "".join(f"var a{i}={i};for(var b{i}=0;b{i}<9;b{i}++)s(b{i});" for i in range(60)) + "}()", "minified"), ("var x = [" + ", ".join(str(i * 7919 % 65536) for i in range(300)) + "];\n", "data"), ('DATA = "' + "aB3+/x9Q" * 100 + '"\n', "data"),
    ("// lib v1 | (c) the Lib authors | released under the Free licence\n" + hand(7), None), ("// Copyright the Own team. Licensed for internal use.\n" + hand(8), None),
])
def test_composition(text, kind):
    assert G.composition(text) == kind


WORDS = [f"{a}{b}" for a in ("al", "be", "ga", "de", "ep") for b in ("pha", "ta", "mma", "lta", "silon", "chi", "psi", "ron")]
JUNIT = "class OrderTest {\n" + "".join(f"  @Test\n  void {w}IsKept() {{\n    assertEquals(order(\"{w}\"), kept(\"{w}\"));\n  }}\n\n" for w in WORDS[:12]) + "}\n"


@pytest.mark.parametrize("text", [
    "// Copyright (c) 2021 The Foo Project contributors\n// Released under the MIT license\n" + hand(20), '"""Report generated by the nightly job."""\n' + hand(21), "# Do not edit concurrently.\n" + hand(22), "# Code generated by the old tool is read here, DO NOT EDIT its output.\n" + hand(23),
    JUNIT, "NAMES = [\n" + "".join(f'    "{w}",\n' for w in WORDS) + "]\n", "".join(f'app.get("/{w}", {w}Page);\n' for w in WORDS[:20]), "".join(f'    "{w}": "{w[::-1]}",\n' for w in WORDS), "".join(f"    case {len(w) * 7 % 13}: return {w};\n" for w in WORDS),
])
def test_hand_written_files_that_look_made(text):
    assert G.composition(text) is None


def edited(text: str, seed: int) -> str:
    lines = text.split("\n")
    lines.insert(seed % len(lines), f"# local change {seed}")
    return "\n".join(lines)


def test_copies(spark):
    lib, lone = hand(50), hand(51)
    rows = [(f"r{i}", f"vendorless/lib{i}.py", edited(lib, i)) for i in range(6)] + [("r0", "own.py", hand(60)), ("r1", "own.py", hand(61)), ("r0", "twice.py", lone), ("r0", "again.py", lone), ("r1", "short.py", "import something_long_enough\n"), ("r2", "short.py", "import something_long_enough\n"), ("r3", "n.py", None), ("r3", "e.py", ""), ("r4", "lib.txt", lib), (None, "lost.py", lib), ("r0", None, lib)]
    files = spark.createDataFrame([(*r, "x", 1) for r in rows + rows[:1]], "csc_id string, path string, text string, cls string, repo int")
    got = {(r["csc_id"], r["path"]) for r in G.copies_across_repositories(files).collect()}
    assert got == {(f"r{i}", f"vendorless/lib{i}.py") for i in range(6)} | {(None, "lost.py")}
    kinds = {(r["csc_id"], r["path"]): r["kind"] for r in G.not_hand_written(files).collect()}
    assert kinds == {k: "vendored" for k in got}
    assert G.not_hand_written(files.limit(0)).count() == 0
    report = {(r["csc_id"], r["language"]): (r["files"], r["vendored"]) for r in G.kind_report(files).collect()}
    assert report["r0", "python"] == (4, 1) and report[None, "python"] == (1, 1)


def test_hot_line_and_hot_copy(spark):
    lib = hand(70)
    files = spark.createDataFrame([(f"r{i}", "lib.py", lib) for i in range(150)] + [(f"r{i}", f"own{i}.py", hand(1000 + i) + "\nshared_line_of_all_files()\n") for i in range(150)], "csc_id string, path string, text string")
    got = [tuple(r) for r in G.copies_across_repositories(files).collect()]
    assert len(got) == 150 and {p for _, p, _ in got} == {"lib.py"}


def test_containment_equals_brute_force(spark):
    r, base = random.Random(4), hand(80, 20).split("\n")
    files = []
    for i in range(25):
        keep = [x for x in base if r.random() < (0.95 if i % 2 else 0.55)]
        files.append((f"r{i}", "f.py", "\n".join(keep + hand(900 + i, 3 if i % 3 else 1).split("\n"))))
    lines = [{x for y in t.split("\n") if len(x := "".join(y.split(" "))) >= G.LINE} for _, _, t in files]
    want = {files[i][0] for i, a in enumerate(lines) if any(len(a & b) >= G.CONTAINMENT * len(a) for j, b in enumerate(lines) if i != j)}
    got = {x["csc_id"] for x in G.copies_across_repositories(spark.createDataFrame(files, "csc_id string, path string, text string")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def brute(files: list[tuple[str, str, str]]) -> dict[tuple[str, str], float]:
    """Of each file the greatest share of its lines in one file of another repository, if it reaches the bound."""
    sets = [{x for y in t.split("\n") if len(x := "".join(y.split(" "))) >= G.LINE} for _, _, t in files]
    best = {(r, p): max(len(a & b) / len(a) for (q, _, _), b in zip(files, sets, strict=True) if q != r) for (r, p, _), a in zip(files, sets, strict=True)}
    return {k: round(v, 6) for k, v in best.items() if v >= G.CONTAINMENT}


def copies(spark, files: list[tuple[str, str, str]]) -> dict[tuple[str, str], float]:
    return {(x["csc_id"], x["path"]): x["containment"] for x in G.copies_across_repositories(spark.createDataFrame(files, "csc_id string, path string, text string")).collect()}


@pytest.mark.parametrize("hot", [1000, 3])
def test_library_with_many_editions(spark, monkeypatch, hot):
    monkeypatch.setattr(G, "HOT", hot)
    lib, files = [f"library_line_number_{i}()" for i in range(100)], []
    for e in range(40):
        own = set(random.Random(e).sample(range(100), 14))
        files.append((f"r{e}", "lib.py", "\n".join(f"edition_{e}_has_line_{i}()" if i in own else x for i, x in enumerate(lib))))
    files += [("origin", "lib.py", "\n".join(lib)), ("part", "lib.py", "\n".join(lib[:50] + [f"another_line_of_part_{i}()" for i in range(12)])), ("less", "lib.py", "\n".join(lib[:50] + [f"another_line_of_less_{i}()" for i in range(13)]))]
    want = brute(files)
    assert {(f"r{e}", "lib.py") for e in range(40)} < set(want) and ("part", "lib.py") in want and ("less", "lib.py") not in want
    assert copies(spark, files) == want


def test_sibling_edition_in_the_own_repository(spark):
    files = []
    for i in range(60):
        lib = [f"line_{n}_of_library_{i}()" for n in range(100)]
        changed = [f"changed_{n}_in_library_{i}()" if n in (20, 50, 80) else x for n, x in enumerate(lib)]
        files += [(f"r{i}", "changed.py", "\n".join(changed)), (f"r{i}", "longer.py", "\n".join(lib + [f"appended_{n}_to_library_{i}()" for n in range(5)])), (f"origin{i}", "lib.py", "\n".join(lib))]
    want = brute(files)
    assert len(want) == 180 and want["r0", "changed.py"] == 0.97
    assert copies(spark, files) == want
