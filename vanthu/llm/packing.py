"""Problem 8: filling fixed-capacity containers with documents.

Method: Karmarkar-Karp multiway differencing. Documents longer than the capacity give full containers and one rest; all
other items are spread over blocks by a hash of their id. In a block the two partial partitions with the largest spread
are merged with opposing imbalances (largest windows of one with the smallest of the other) until one partition into k
near-equal windows is left, k being the lower bound of what is to be packed. Windows that are exactly full are closed; the
others, of which about half exceed the capacity, are differenced again among themselves, and with each of these rounds
the number of windows in all rises where the capacity was exceeded. When a round closes hardly any window, what is left
goes, largest first, to the fullest window that holds it, and the imbalances between two windows are then used once more:
items are exchanged so that a window with little room is filled from one with more, until windows become empty or no exchange fills any.

Defined cases: null and empty texts have no token and are in no container; a text of exactly the capacity fills one; only
longer texts are divided; repeated ids are packed once; extra columns are ignored; an empty table gives an empty result.
A block has a bounded expected number of items whatever the size of the table, so a task's work is bounded; measured on
uniform and log-normal sizes, a block needs at most as many containers as best-fit decreasing over the same items.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vanthu.llm.tokenizer import DEFAULT_VOCABULARY, count_tokens
from vanthu.runtime import cut

CAPACITY = 2048
ITEMS_IN_BLOCK = 5000
#: Differencing is repeated while it closes at least one window in so many.
LEAST_CLOSED = 200


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0..k-1) of each item by multiway differencing of ``sizes`` into ``k`` windows.

    A partial partition is held as its non-zero windows, ascending: (imbalance, items). All others count as zero, so
    merging two small partitions only joins their lists.
    """
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = [(-int(s), i, [(int(s), [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    stamp = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        free = k - len(a)
        # opposing imbalances: the largest of b meet the empty windows of a, the others the smallest of a
        over = len(b) - free
        if over <= 0:
            merged = sorted(a + b, key=lambda x: x[0])
        else:
            met = [(a[i][0] + b[over - 1 - i][0], a[i][1] + b[over - 1 - i][1]) for i in range(over)]
            if over == 1:
                merged = a[1:]
                for one in met + b[over:]:
                    bisect.insort(merged, one, key=lambda x: x[0])
            else:
                merged = sorted(met + a[over:] + b[over:], key=lambda x: x[0])
        if len(merged) == k and merged[0][0] > 0:  # only differences count from here on
            low = merged[0][0]
            merged = [(s - low, items) for s, items in merged]
        spread = merged[-1][0] - (merged[0][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, stamp, merged))
        stamp += 1
    out = np.zeros(len(sizes), dtype=np.int64)
    for w, (_, items) in enumerate(heap[0][2]):
        out[items] = w
    return out


def _best_fit(sizes: np.ndarray, items: np.ndarray, capacity: int, first: int) -> tuple[dict[int, int], int]:
    """(item -> window, next free window): items, largest first, each in the fullest window that holds it."""
    window: dict[int, int] = {}
    room: list[tuple[int, int]] = []  # ascending: the first that is large enough is the fullest
    for i in sorted(items.tolist(), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(room, (int(sizes[i]), -1))
        if at == len(room):
            left, w, first = capacity, first, first + 1
        else:
            left, w = room.pop(at)
        window[i] = w
        bisect.insort(room, (left - int(sizes[i]), w))
    return window, first


def _exchange(sizes: np.ndarray, items: np.ndarray, window: np.ndarray, load: np.ndarray, capacity: int) -> int:
    """One pass over the windows of ``items``, those with least room first: each takes, in exchange for one of its items or
    for none, the item of a window with at least as much room that fills it best. Returns the number of exchanges."""
    size = sizes[items]
    members: dict[int, list[int]] = {}
    for i in items.tolist():
        members.setdefault(int(window[i]), []).append(i)
    moved = 0
    for w in sorted(members, key=lambda w: (capacity - load[w], w)):
        room = int(capacity - load[w])
        if room <= 0 or not load[w]:
            continue
        held = window[items]
        others = np.flatnonzero((capacity - load[held] >= room) & (held != w))
        if not len(others):
            continue
        gain, out, into = 0, -1, -1
        for b in (*members[w], -1):
            d = size[others] - (sizes[b] if b >= 0 else 0)
            d = np.where(d <= room, d, 0)
            j = int(np.argmax(d))
            if d[j] > gain:
                gain, out, into = int(d[j]), b, int(items[others[j]])
            if gain == room:
                break
        if not gain:
            continue
        from_w = int(window[into])
        members[from_w].remove(into)
        members[w].append(into)
        window[into] = w
        if out >= 0:
            members[w].remove(out)
            members[from_w].append(out)
            window[out] = from_w
        load[w] += gain
        load[from_w] -= gain
        moved += 1
    return moved


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (0..) of each item; every size is between 1 and ``capacity``."""
    sizes = np.asarray(sizes, dtype=np.int64)
    window = np.full(len(sizes), -1, dtype=np.int64)
    rest, n = np.arange(len(sizes)), 0
    while len(rest):
        s = sizes[rest]
        k = max(int(-(-s.sum() // capacity)), int((2 * s > capacity).sum()))
        part = difference(s, k)
        full = np.bincount(part, weights=s, minlength=k).astype(np.int64) == capacity
        if full.sum() * LEAST_CLOSED < k:
            break
        name, closed = np.cumsum(full) - 1 + n, full[part]
        window[rest[closed]] = name[part[closed]]
        rest, n = rest[~closed], n + int(full.sum())
    placed, n = _best_fit(sizes, rest, capacity, n)
    window[list(placed)] = list(placed.values())
    load = np.bincount(window, weights=sizes, minlength=n).astype(np.int64)
    while _exchange(sizes, rest, window, load, capacity):
        pass
    return np.unique(window, return_inverse=True)[1]


def fill_containers(counts: DataFrame, capacity: int = CAPACITY, items_in_block: int = ITEMS_IN_BLOCK) -> DataFrame:
    """(doc_id, container, token_start, token_end) from (doc_id, n_tokens); the end is exclusive.

    Two shuffles of (id, size): by id, to count repeated ids once, and by block. Full parts of long documents are made without one.
    """
    sized = cut(counts.where("n_tokens > 0 and doc_id is not null").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")))
    full = F.expr(f"n_tokens div {capacity}")
    whole = sized.where(full > 0).select("doc_id", F.explode(F.sequence(F.lit(0), (full - 1).cast("int"))).alias("j")).select(
        "doc_id", F.concat(F.lit("d"), F.col("doc_id"), F.lit("."), F.col("j")).alias("container"), (F.col("j") * capacity).cast("long").alias("token_start"), ((F.col("j") + 1) * capacity).cast("long").alias("token_end")
    )
    rest = sized.select("doc_id", "n_tokens", (full * capacity).alias("token_start"), (F.col("n_tokens") % capacity).alias("size")).where("size > 0")
    blocks = max(1, round(rest.count() / items_in_block))

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("doc_id")
        window = pack(block["size"].to_numpy(), capacity)
        name = f"b{block['block'].iloc[0]}."
        return pd.DataFrame({"doc_id": block["doc_id"], "container": [f"{name}{w}" for w in window], "token_start": block["token_start"], "token_end": block["n_tokens"]})

    # a row is small and its work large, so the number of tasks is told: adaptive execution would join them
    tasks = min(blocks, 16 * counts.sparkSession.sparkContext.defaultParallelism)
    packed = rest.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).repartition(tasks, "block").groupBy("block").applyInPandas(run, "doc_id long, container string, token_start long, token_end long")
    return whole.unionByName(packed)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Containers of all ``documents.text``, measured in tokens of the vocabulary at ``path``."""
    return fill_containers(count_tokens(documents, path=path), capacity)


def report(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers used, tokens held, and the share of unused space."""
    per = containers.groupBy("container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.round(1 - F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("unused"))
