"""Filling containers of fixed capacity with units by multiway differencing."""

from __future__ import annotations

from heapq import heapify, heappop, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
#: Units that one task differences together; a repository of more units is divided evenly into blocks.
BLOCK = 4096
#: Windows at most whose units are differenced together again.
TOGETHER = 4
TOKEN = "[A-Za-z0-9_]+"


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window of each unit when k windows are made near-equal by Karmarkar-Karp differencing.

    Every unit begins as a partition in which one window holds it and k-1 are
    empty. The two partitions of the largest spread are merged, largest window
    with smallest, until one is left. Windows that hold no more than the smallest
    are not stored while a partition has fewer than k filled ones. Ties go by the
    order of the units.
    """
    n = len(sizes)
    sums: list[np.ndarray] = [np.array([s], np.int64) for s in sizes.tolist()]
    trees: list[list] = [[(i,)] for i in range(n)]  # of each filled window the units, as a tree that is read at the end
    heap = [(-int(s), i) for i, s in enumerate(sizes.tolist())]
    heapify(heap)
    while len(heap) > 1:
        _, a = heappop(heap)
        b = heap[0][1]
        x, y, tx, ty = sums[a], sums[b], trees[a], trees[b]
        both = max(0, len(x) + len(y) - k)  # windows in which both partitions hold something
        joined = np.concatenate([x[: len(x) - both], x[len(x) - both :] + y[::-1][:both], y[: len(y) - both]])
        trees_joined = [*tx[: len(x) - both], *((tx[len(x) - both + j], ty[len(y) - 1 - j]) for j in range(both)), *ty[: len(y) - both]]
        order = np.argsort(-joined, kind="stable")
        sums[a], trees[a] = joined[order], [trees_joined[j] for j in order]
        sums[b], trees[b] = None, None
        spread = int(sums[a][0]) - (int(sums[a][-1]) if len(joined) == k else 0)
        heapreplace(heap, (-spread, a))
    out = np.zeros(n, np.int64)
    for w, tree in enumerate(trees[heap[0][1]] if n else []):
        stack = [tree]
        while stack:
            node = stack.pop()
            if len(node) == 1:
                out[node[0]] = w
            else:
                stack.extend(node)
    return out


def within_capacity(window: np.ndarray, sizes: np.ndarray, k: int, capacity: int) -> tuple[np.ndarray, int]:
    """The windows after those above capacity are differenced again with emptier ones, and the tokens that stay above.

    The fullest window meets the windows below capacity from the emptiest on, first
    one of them, then two, and so on up to TOGETHER windows in all; their units are
    differenced into as many windows. The first group that then is above capacity by less
    stays, so the tokens above capacity fall until none is left or no group helps the fullest window.
    """
    load = np.bincount(window, sizes, k).astype(np.int64)
    if (load <= capacity).all():
        return window, 0
    members, stuck = [np.flatnonzero(window == w) for w in range(k)], False
    while not stuck and load.max() > capacity:
        a, order = int(load.argmax()), np.argsort(load, kind="stable")
        near = order[load[order] < capacity].tolist()
        for group in ((a, *near[i : i + more]) for more in range(1, TOGETHER) for i in range(len(near) - more + 1)):
            units = np.concatenate([members[w] for w in group])
            part = differencing(sizes[units], len(group))
            loads = np.bincount(part, sizes[units], len(group)).astype(np.int64)
            if (loads - capacity).clip(0).sum() < load[a] - capacity:
                for i, w in enumerate(group):
                    members[w], load[w] = units[part == i], loads[i]
                break
        else:
            stuck = True
    window = np.empty(len(sizes), np.int64)
    for w, units in enumerate(members):
        window[units] = w
    return window, int((load - capacity).clip(0).sum())


def fewest_windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each unit, all windows within capacity; sizes are at most capacity.

    Differencing begins with the least number of windows that could do: what the
    total needs, and what units above half of the capacity need, which share no
    window with each other. Windows above capacity are differenced again with
    emptier ones. While one stays above capacity the count rises by
    the overflow that is left, at least one; the last failure and the first
    success are then bisected, down to one.
    """
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int64)
    low = max(1, -(-int(sizes.sum()) // capacity), int((sizes * 2 > capacity).sum()))

    def tried(k: int) -> tuple[np.ndarray, int]:
        window, over = within_capacity(differencing(sizes, k), sizes, k, capacity)
        return window, -(-over // capacity)

    k, failed, step = low, low - 1, 1
    best, over = tried(k)
    while over:
        failed, k, step = k, min(n, k + max(step, over)), step * 2
        best, over = tried(k)
    while k - failed > 1:
        middle = (k + failed) // 2
        window, over = tried(middle)
        if over:
            failed = middle
        else:
            k, best = middle, window
    return best


def _pack(capacity: int):  # noqa: ANN202
    def run(keys: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "source_path", "line_start", "part"], ascending=[False, True, True, True], kind="stable", na_position="first").reset_index(drop=True)
        block["container"] = fewest_windows(block["size"].to_numpy(np.int64), capacity)
        return block[["csc_id", "block", "container", "source_path", "line_start", "part", "parts", "size"]]

    return run


def counted_units(units: DataFrame, files: DataFrame) -> DataFrame:
    """(csc_id, source_path, line_start, token_count): distinct units with their tokens.

    A null token_count is the count of tokens in the file's text, 0 where the file
    or its text is missing. Of repeated keys the largest count stays. Only counts
    of texts travel, never texts.
    """
    known = units.groupBy("csc_id", "source_path", "line_start").agg(F.max("token_count").alias("told"))
    counts = files.select(F.col("csc_id").alias("f_csc"), F.col("path").alias("f_path"), F.regexp_count("text", F.lit(TOKEN)).alias("counted"))
    unknown = known.filter("told IS NULL")
    found = unknown.join(counts, (F.col("csc_id") == F.col("f_csc")) & (F.col("source_path") == F.col("f_path")), "left").groupBy("csc_id", "source_path", "line_start").agg(
        F.coalesce(F.max("counted"), F.lit(0)).alias("token_count"))
    return known.filter("told IS NOT NULL").select("csc_id", "source_path", "line_start", F.col("told").alias("token_count")).unionByName(found)


def unit_parts(counted: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Units as parts of at most capacity: (…, part, parts, size). Only units above capacity have several, all full but the last."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("token_count") / capacity)).cast("int")
    out = counted.withColumn("parts", parts).select("csc_id", "source_path", "line_start", "token_count", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return out.select("csc_id", "source_path", "line_start", "part", "parts",
                      F.greatest(F.lit(0), F.least(F.lit(capacity), F.col("token_count") - F.col("part") * capacity)).cast("int").alias("size"))


def pack_units(units: DataFrame, files: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(csc_id, container, source_path, line_start, part, parts, size): every part of every unit in one container.

    Containers, named `block-window`, belong to one csc_id and hold at most
    capacity tokens. Units of at most capacity stay whole (parts = 1); a larger one
    is cut into full parts, each a container of its own, and a rest. Units of no
    tokens are packed too. Null csc_id is one group, null line_start a value like
    others; empty tables give no rows.

    The units of a csc_id are differenced in blocks of about `block` parts, by a
    hash of their key, so a repository of any size spreads over tasks; a block
    leaves less than one container free beyond what differencing leaves. Only
    counts per csc_id are gathered to know the number of blocks.
    """
    parts = unit_parts(counted_units(units, files), capacity)
    full = parts.filter(F.col("size") == capacity).select("csc_id", F.concat_ws("-", F.lit("full"), F.xxhash64("source_path", "line_start"), "part").alias("container"), "source_path", "line_start", "part", "parts", "size")
    rest = parts.filter(F.col("size") < capacity)
    blocks = rest.groupBy("csc_id").agg(F.ceil(F.count("*") / block).alias("blocks")).select(F.col("csc_id").alias("b_csc"), "blocks")
    placed = rest.join(blocks, F.col("csc_id").eqNullSafe(F.col("b_csc"))).withColumn("block", F.pmod(F.xxhash64("source_path", "line_start", "part"), F.col("blocks")))
    packed = placed.groupBy("csc_id", "block").applyInPandas(
        _pack(capacity), "csc_id string, block long, container long, source_path string, line_start int, part int, parts int, size int")
    return packed.select("csc_id", F.concat_ws("-", "block", "container").alias("container"), "source_path", "line_start", "part", "parts", "size").unionByName(full)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per csc_id: containers, the fewest that the tokens could need, tokens, and the share of room that is filled."""
    per = packed.groupBy("csc_id", "container").agg(F.sum("size").alias("load")).groupBy("csc_id").agg(
        F.count("*").alias("containers"), F.sum("load").alias("tokens"))
    return per.select("csc_id", "containers", F.ceil(F.col("tokens") / capacity).alias("least"), "tokens", F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("filled"))
