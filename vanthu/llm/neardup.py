"""Problem 6: near-duplicate records with small edits.

The method named for this problem, vantage-point trees over Hamming fingerprints, cannot carry the search here, and is
replaced: at a similarity of one half two versions differ in a quarter of their bits and unrelated records in 49 % of them,
with hardly any spread, so the triangle inequality leaves no branch whatever the length of the fingerprint (the README has
the figures). What carries the search are overlapping shards: records get Hamming fingerprints (one bit of each of 96
min-hash slots over runs of three words) and are in one shard for each band of slots, so two versions that lie on both
sides of one shard's boundary meet in another. Inside a shard of more than a few members a vantage-point tree answers the
range query, since there, among versions of one text, branches do end; the pairs found are checked exactly.

Runs that at least a tenth of all records hold (letterheads, set phrases) are left out of the slots where enough others are
left; a record of which they make up a fifth or more is placed with them as well. Exact copies are one record until the end.

Words are the pieces of the lower-cased text split at white space. Two records are a pair if the number of different runs
of three words in both is at least half the number in either, both have 50 words or more, and their ids differ. Defined
cases: null, empty and short texts are in no pair; equal texts are a pair; repeated rows of one id count once; null ids
are left out; texts of any length count whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vanthu.runtime import cut

MIN_WORDS, RUN = 50, 3
SLOTS = 96
#: (bands, slots in a band) without the common runs, and with them
BANDS = ((48, 3), (24, 4))
COMMON = 0.1
RADIUS = (41, 33)  # of 96 bits, without the common runs and with them: a pair at one half differs in 24 bits on average, unrelated ones in 48, with deviations of 4 to 5
ALONE, TWICE = 28, 35  # the radius for pairs that meet in one or two shards only
#: Records are placed without the common runs if at least the first share of their runs is left, and with them if less than the second is.
RARE_FROM, WHOLE_BELOW = 0.3, 0.8
LEAF = 32
SHARD_LIMIT = 8192  # members of one shard compared in one task; the pairs of a larger shard are spread over tiles of half that size
#: One record in so many tells, before anything is placed, which shards are large. The result does not depend on it.
SAMPLE = 64
COPIES_BROADCAST = 1_000_000  # rows that are copies of others are broadcast up to so many, else all rows are grouped by copy
HOT_BROADCAST = 100_000  # large shards are broadcast up to so many, else joined
#: Bits of the table of records in a pair: the least, the most (128 megabytes), and how many a record.
BLOOM_BITS, BLOOM_MOST, BLOOM_EACH = 1 << 24, 1 << 30, 16
TASK_BYTES, ROW_BYTES = 96 << 20, 48  # rows of a shard task in memory
_rng = np.random.default_rng(20240607)
_MULTIPLIERS = (_rng.integers(1, 1 << 32, SLOTS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_LAYOUT = [np.concatenate([_rng.permutation(SLOTS).reshape(-1, r) for _ in range(-(-b * r // SLOTS))])[:b] for b, r in BANDS]
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Codes(dict):
    """word -> 64-bit code, the same in every worker."""

    def __missing__(self, word: str) -> int:
        code = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(word) < 40:
            self[word] = code
        return code


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_of(codes: np.ndarray) -> np.ndarray:
    """64-bit keys of all runs of three consecutive words."""
    return _mix(_mix(codes[:-2] * _M1 + codes[1:-1]) * _M2 + codes[2:] * _M3)


def _blocks(batches: Iterator[pa.RecordBatch], words_in_block: int = 400_000, codes: _Codes | None = None) -> Iterator[tuple[list, list]]:
    """Rows of enough words, several at a time: ([(t, id)], [words]), or their codes, which take less memory than the words."""
    rows, words, held = [], [], 0
    for batch in batches:
        for t, i, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if text is None or i is None:
                continue
            w = text.lower().split()
            if len(w) < MIN_WORDS:
                continue
            rows.append((t, i))
            words.append(w if codes is None else np.fromiter(map(codes.__getitem__, w), dtype=np.uint64, count=len(w)))
            held += len(w)
            if held >= words_in_block:
                yield rows, words
                rows, words, held = [], [], 0
    if rows:
        yield rows, words


def _flat(words: list, codes: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the runs of all rows one after the other, where each row's runs begin)."""
    if len(codes) > 400_000:
        codes.clear()
    sizes = np.array([len(w) for w in words])
    flat = np.concatenate(words) if isinstance(words[0], np.ndarray) else np.fromiter((c for w in words for c in map(codes.__getitem__, w)), dtype=np.uint64, count=int(sizes.sum()))
    ends = np.cumsum(sizes)
    keep = np.ones(len(flat) - 2, dtype=bool)
    for back in (2, 1):  # runs that would reach into the next row
        keep[ends[:-1] - back] = False
    return runs_of(flat)[keep], np.concatenate([[0], np.cumsum(sizes - 2)[:-1]])


def common_runs(rows: DataFrame) -> np.ndarray:
    """Keys of the runs that occur, repeats within a record included, ``COMMON`` times as often as there are records.

    Each block of rows reports the runs that are common in it, with counts; a run common in all rows is common in some
    block. As a record holds a few hundred runs, at most a few hundred times 1 / COMMON keys reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, sums = _Codes(), 0, {}
        for ids, words in _blocks(batches, 2_000_000, codes):
            flat, _ = _flat(words, codes)
            keys, counts = np.unique(flat, return_counts=True)
            big = counts >= max(2, COMMON / 4 * len(ids))
            for k, c in zip(keys[big].tolist(), counts[big].tolist()):
                sums[k] = sums.get(k, 0) + c
            n += len(ids)
        sums = {k: c for k, c in sums.items() if c >= COMMON / 4 * n}
        yield pa.RecordBatch.from_arrays([pa.array([0, *np.array(list(sums), dtype=np.uint64).view(np.int64).tolist()], pa.int64()), pa.array([n, *sums.values()], pa.int64())], names=["run", "n"])

    total = rows.mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    total = cut(total)
    records = (total.where("run = 0").first() or [0, 0])[1]
    got = total.where((F.col("run") != 0) & (F.col("n") >= max(3, COMMON * records))).select("run").collect()
    return np.sort(np.array([r[0] for r in got], dtype=np.int64).view(np.uint64))


def _slots(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Min-hash slots of each row, 16 bits kept: (rows, SLOTS)."""
    low = (keys >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), SLOTS), dtype=np.uint16)
    for s, a in enumerate(_MULTIPLIERS):
        out[:, s] = _fold(np.minimum.reduceat(low * a, starts))
    return out


def _fold(x: np.ndarray) -> np.ndarray:
    """16 mixed bits of a slot's minimum, whose upper bits are nearly all zero."""
    return (_mix(x.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def signatures(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """(t, id, n, copy, sig, sig2): the number of different runs, the copy key of the text, and the slots with and, near the limit, without the common runs."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, common = _Codes(), shared.value
        for ids, words in _blocks(batches):
            flat, starts = _flat(words, codes)
            if len(common):
                rare = common[np.minimum(np.searchsorted(common, flat), len(common) - 1)] != flat
            else:
                rare = np.ones(len(flat), dtype=bool)
            share = np.add.reduceat(rare.astype(np.int64), starts) / np.diff(np.append(starts, len(flat)))
            sizes = np.diff(np.append(starts, len(flat)))
            first: list[bytes | None] = [None] * len(ids)
            second: list[bytes | None] = [None] * len(ids)
            for use_rare, into in ((True, first), (False, second)):
                rows_in = np.flatnonzero(share >= RARE_FROM) if use_rare else np.flatnonzero(share < WHOLE_BELOW)
                if not len(rows_in):
                    continue
                mask = np.repeat(np.isin(np.arange(len(ids)), rows_in), sizes)
                if use_rare:
                    mask &= rare
                kept = np.add.reduceat(mask.astype(np.int64), starts)[rows_in]
                sig = _slots(flat[mask], np.concatenate([[0], np.cumsum(kept)[:-1]]))
                for r, s in zip(rows_in.tolist(), sig):
                    into[r] = s.tobytes()
            different = [len(np.unique(flat[e : e + k])) for e, k in zip(starts.tolist(), sizes.tolist())]
            copies = [hashlib.blake2b(" ".join(w).encode("utf-8", "surrogatepass"), digest_size=16).digest() for w in words]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in ids], pa.int32()), pa.array([i for _, i in ids], pa.int64()), pa.array(different, pa.int32()), pa.array(copies, pa.binary()), pa.array(first, pa.binary()), pa.array(second, pa.binary())], names=["t", "id", "n", "copy", "sig", "sig2"]
            )

    return rows.mapInArrow(run, "t int, id long, n int, copy binary, sig binary, sig2 binary")


def _to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, id, bits, tail): every record in one shard for each band.

    tail holds, from the lowest bit, 32 more bits of the fingerprint, t, whether common runs count, and the number of different runs.
    """
    for batch in batches:
        t = np.asarray(batch.column(0), dtype=np.uint64)
        i = np.asarray(batch.column(1), dtype=np.int64)
        n = np.asarray(batch.column(2), dtype=np.int32)
        for whole, kind in enumerate((3, 4)):
            layout = _LAYOUT[whole]
            bands = len(layout)
            at = np.flatnonzero([v is not None for v in batch.column(kind).to_pylist()])
            if not len(at):
                continue
            sig = np.frombuffer(b"".join(batch.column(kind).take(pa.array(at)).to_pylist()), dtype=np.uint16).reshape(len(at), SLOTS)
            bits = np.packbits((sig & 1).astype(np.uint8), axis=1)
            b0, b1 = np.ascontiguousarray(bits[:, :8]).view(np.int64).ravel(), np.ascontiguousarray(bits[:, 8:]).view(np.uint32).ravel().astype(np.int64)
            tail = (np.minimum(4 * n[at].astype(np.int64) + 2 * whole + t[at].astype(np.int64), (1 << 31) - 1) << 32) | b1
            for lo in range(0, len(at), 2000):
                s = slice(lo, lo + 2000)
                packed = np.zeros((len(sig[s]), bands), dtype=np.uint64)
                for c in range(layout.shape[1]):
                    packed = (packed << np.uint64(16)) | sig[s][:, layout[:, c]]
                keys = _mix(_mix(packed) + (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * _M1 + t[at[s], None] * _M2 + np.uint64(kind) * _M3)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), *(pa.array(np.repeat(v, bands)) for v in (i[at[s]], b0[s], tail[s]))],
                    names=["shard", "id", "bits", "tail"],
                )


def hamming(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of fingerprints along the last axis."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int16)


class VantageTree:
    """A vantage-point tree over fingerprints (rows of 64-bit words) with Hamming distance."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.root = self._build(np.arange(len(bits)))

    def _build(self, at: np.ndarray):
        if len(at) <= LEAF:
            return at
        d = hamming(self.bits[at], self.bits[at[0]])
        mid = int(np.median(d))
        inside = d <= mid
        if inside.all():
            inside = d < mid
        if not inside.any() or inside.all():
            return at  # all at one distance: nothing to prune
        return at[0], int(d[inside].max()), int(d[~inside].min()), self._build(at[inside]), self._build(at[~inside])

    def pairs(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All index pairs within ``radius``; queries go down the tree together and leave a branch by the triangle inequality."""
        left, right = [], []
        todo = [(self.root, np.arange(len(self.bits)))]
        while todo:
            node, q = todo.pop()
            if not len(q):
                continue
            if isinstance(node, np.ndarray):
                for lo in range(0, len(q), 4096):
                    part = q[lo : lo + 4096]
                    a, b = np.nonzero(hamming(self.bits[part][:, None], self.bits[node][None, :]) <= radius)
                    keep = part[a] < node[b]
                    left.append(part[a][keep])
                    right.append(node[b][keep])
                continue
            vantage, far_in, near_out, inside, outside = node
            d = hamming(self.bits[q], self.bits[vantage])
            todo.append((inside, q[d - far_in <= radius]))
            todo.append((outside, q[near_out - d <= radius]))
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(left), np.concatenate(right)


def _shard_pairs(batches: Iterator[pa.RecordBatch], limit: int | None = SHARD_LIMIT) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of rows sorted by shard: (t, a, b, d). Small shards are compared together.

    A fifth column, where there is one, is the side of a row: in a tile of two sides, between which pairs are sought, its
    number; -1 in a tile of one side; -2 in a whole shard. A whole shard beyond ``limit`` gives one row (-1, shard, members,
    0) instead; no more than ``limit`` of its rows are held.
    """

    def out(ids, bits, tn, side, x, y) -> pa.RecordBatch:
        n, m = tn[x] >> 2, tn[y] >> 2
        keep = (ids[x] != ids[y]) & ((side[x] < 0) | (side[x] != side[y])) & (tn[x] & 1 == tn[y] & 1) & (2 * np.minimum(n, m) >= np.maximum(n, m))
        x, y = x[keep], y[keep]
        a, b = ids[x], ids[y]
        return pa.RecordBatch.from_arrays([pa.array(tn[x] & 1), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(hamming(bits[x], bits[y]))], names=["t", "a", "b", "d"])

    def work(shard, ids, bits, tn, side):
        edge = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        size = np.diff(np.append(edge, len(shard)))
        small = np.repeat(size, size) <= LEAF
        for off in range(1, min(LEAF, int(size.max(initial=1)))):
            a = np.flatnonzero((shard[:-off] == shard[off:]) & small[:-off])
            a = a[hamming(bits[a], bits[a + off]) <= np.where(tn[a] & 2, RADIUS[1], RADIUS[0])]
            if len(a):
                yield out(ids, bits, tn, side, a, a + off)
        for e, n in zip(edge[size > LEAF].tolist(), size[size > LEAF].tolist()):
            if limit and n > limit and side[e] == -2:
                yield large(shard[e], n)
                continue
            s = slice(e, e + n)
            a, b = VantageTree(bits[s]).pairs(RADIUS[(int(tn[e]) >> 1) & 1])
            yield out(ids, bits, tn, side, a + e, b + e)

    def large(shard, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([shard], pa.int64()), pa.array([n], pa.int64()), pa.array([0], pa.int16())], names=["t", "a", "b", "d"])

    held: list[list[np.ndarray]] = []  # parts of the last shard, which may go on in the next batch
    members = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, ids, bits, tail = (np.asarray(batch.column(k)) for k in range(4))
        side = np.asarray(batch.column(4)) if batch.num_columns > 4 else np.full(len(ids), -2, dtype=np.int32)
        cols = [shard, ids, np.stack([bits, tail & 0xFFFFFFFF], axis=1).view(np.uint64), (tail >> 32).astype(np.int32), side]
        start = 0
        if held and held[0][0][0] == shard[0]:  # the held shard goes on
            start = int(np.searchsorted(shard, shard[0], side="right"))
            if not (limit and members > limit and side[0] == -2):
                held.append([c[:start] for c in cols])
            members += start
            if start == len(shard):
                continue
        last = int(np.searchsorted(shard, shard[-1]))
        if held and limit and members > limit and held[0][4][0] == -2:
            yield large(held[0][0][0], members)
            held = []
        if held or last > start:
            yield from work(*(np.concatenate([*(h[k] for h in held), c[start:last]]) for k, c in enumerate(cols)))
        held, members = [[c[last:] for c in cols]], len(shard) - last
    if held and limit and members > limit and held[0][4][0] == -2:
        yield large(held[0][0][0], members)
    elif held:
        yield from work(*(np.concatenate([h[k] for h in held]) for k in range(5)))


def _tiles(placed: DataFrame, large: DataFrame, others: bool) -> DataFrame:
    """``placed`` with the shards of ``large`` (shard, p) spread over p * (p + 1) / 2 tiles; with ``others``, all other shards whole."""
    few = large.count() <= HOT_BROADCAST
    rows = placed.join(F.broadcast(large) if few else large, "shard", "left" if others else "inner")
    i = F.pmod(F.xxhash64("id"), F.col("p")).cast("int")
    tile = lambda j: F.struct(F.xxhash64("shard", F.least(F.col("i"), j), F.greatest(F.col("i"), j)).alias("shard"), F.when(F.col("i") == j, -1).otherwise(F.col("i")).alias("side"))
    whole = F.array(F.struct(F.col("shard"), F.lit(-2).alias("side")))
    at = F.when(F.col("p").isNull(), whole).otherwise(F.transform(F.sequence(F.lit(0), F.col("p") - 1), tile))
    return rows.withColumn("i", i).select(F.explode(at).alias("s"), "id", "bits", "tail").select("s.shard", "id", "bits", "tail", "s.side")


def candidates(sigs: DataFrame) -> DataFrame:
    """(t, a, b): pairs of representatives within the radius that meet in several shards, or within a smaller one in few.

    A sample of the records tells which shards are large; these are placed in tiles from the start, so that no task gets
    one whole. A shard that turns out large all the same is tiled afterwards.
    """

    def place(rows: DataFrame) -> DataFrame:
        return rows.select("t", "id", "n", "sig", "sig2").mapInArrow(_to_shards, "shard long, id long, bits long, tail long")

    placed, limit = place(sigs), SHARD_LIMIT
    parts = lambda n: F.ceil(n * 2 / SHARD_LIMIT).cast("int").alias("p")
    key = ["t", "copy" if "copy" in sigs.columns else "id"]  # a filter on the copy key reaches the table below the grouping by it
    seen = place(sigs.where(F.pmod(F.xxhash64(*key), F.lit(SAMPLE)) == 0)).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    hot = cut(seen.where(F.col("n") * SAMPLE > SHARD_LIMIT).select("shard", parts(F.col("n") * SAMPLE)))

    # few large tasks: the rows of one record that go to the same task lie together and are packed well in the shuffle
    size = sigs.count() * sum(b for b, _ in BANDS) * ROW_BYTES
    tasks = max(2 * sigs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))

    def met(rows: DataFrame) -> DataFrame:
        """(t, a, b, k, d): how often a pair meets and its distance; a whole shard beyond the limit as (-1, shard, members, 1, 0)."""
        by_shard = rows.repartition(tasks, "shard").sortWithinPartitions("shard")
        near = by_shard.mapInArrow(lambda it: _shard_pairs(it, limit), "t int, a long, b long, d short")
        return cut(near.groupBy("t", "a", "b").agg(F.count(F.lit(1)).alias("k"), F.min("d").alias("d")))

    near = met(placed if hot.isEmpty() else _tiles(placed, hot, True))
    large = near.where("t = -1").select(F.col("a").alias("shard"), parts(F.col("b")))
    if not large.isEmpty():
        # a pair meets in shards of both kinds: the radius depends on all of them
        near = near.where("t >= 0").unionByName(met(_tiles(placed, large, False))).groupBy("t", "a", "b").agg(F.sum("k").alias("k"), F.min("d").alias("d"))
    return cut(near.where(F.col("d") <= F.when(F.col("k") == 1, ALONE).when(F.col("k") == 2, TWICE).otherwise(RADIUS[0])).select("t", "a", "b"))


def _bloom(ids: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """A bit table of the hashes in ``ids`` (h), which are below ``bits``."""
    words = ids.select((F.col("h") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(h % 64 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 64, dtype=np.int64)
    table[words["w"].to_numpy()] = words["bits"].to_numpy()
    return table.view(np.uint64)


def _hash(t, i, bits: int):
    return F.pmod(F.xxhash64(t, i), F.lit(bits))


def exact_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (t, a, b) whose shared runs are at least half of all their runs.

    Only records that are in a pair are sent on with their runs; a bit table of bounded size keeps the others out of the shuffle.
    """
    ends = pairs.select("t", F.explode(F.array("a", "b")).alias("id"))
    bits = min(BLOOM_MOST, max(BLOOM_BITS, 1 << (BLOOM_EACH * 2 * pairs.count()).bit_length()))
    shared = rows.sparkSession.sparkContext.broadcast(_bloom(ends.select(_hash("t", "id", bits).alias("h")), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, table = _Codes(), shared.value
        for batch in batches:
            h = np.asarray(batch.column(3), dtype=np.uint64)
            hit = (table[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1)
            part = batch.take(pa.array(np.flatnonzero(hit)))
            t, i, sets = [], [], []
            for tt, ii, text in zip(*(part.column(k).to_pylist() for k in range(3))):
                w = (text or "").lower().split()
                if len(w) >= MIN_WORDS:
                    t.append(tt)
                    i.append(ii)
                    sets.append(np.unique(runs_of(np.fromiter(map(codes.__getitem__, w), dtype=np.uint64, count=len(w)))).tobytes())
            if len(codes) > 400_000:
                codes.clear()
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(i, pa.int64()), pa.array(sets, pa.binary())], names=["t", "id", "runs"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                n, m = len(x) // 8, len(y) // 8
                if 2 * min(n, m) < max(n, m):
                    continue
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")
                if 3 * int((both[1:] == both[:-1]).sum()) >= n + m:
                    keep.append(k)
            yield batch.select([0, 1, 2]).take(pa.array(keep, pa.int64()))

    sets = rows.withColumn("h", _hash("t", "id", bits)).mapInArrow(run, "t int, id long, runs binary")
    sets = cut(sets)  # rows delivered twice are here twice; the pairs are made distinct
    a = sets.select("t", F.col("id").alias("a"), F.col("runs").alias("x"))
    b = sets.select("t", F.col("id").alias("b"), F.col("runs").alias("y"))
    return pairs.join(a, ["t", "a"]).join(b, ["t", "b"]).select("t", "a", "b", "x", "y").mapInArrow(check, "t int, a long, b long").distinct()


TABLES = ("documents", "chunks")


def texts_of(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(t, id, text) of both tables."""
    return documents.select(F.lit(0).alias("t"), F.col("doc_id").alias("id"), F.col("content_markdown").alias("text")).unionByName(chunks.select(F.lit(1).alias("t"), F.col("id"), F.col("text")))


def versions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): (t, id, rep) of every record of enough words, and (t, a, b) between representatives of copies."""
    sigs = cut(signatures(rows, common_runs(rows)).withColumn("row", F.monotonically_increasing_id()))
    first = sigs.groupBy("t", "copy").agg(F.min(F.struct("id", "row")).alias("m"), F.count(F.lit(1)).alias("rows"))
    members = cut(sigs.select("t", "id", "row", "copy").join(first, ["t", "copy"]).select("t", "id", "row", F.col("m.id").alias("rep"), (F.col("row") != F.col("m.row")).alias("more")))
    # the slots stay where they are where few rows are copies, which is known by then; else they move once, by copy
    more = members.where("more").select("row")
    if more.count() <= COPIES_BROADCAST:
        reps = sigs.join(F.broadcast(more), "row", "left_anti")
    else:
        reps = sigs.groupBy("t", "copy").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sig2").alias("sig2"))
    found = candidates(reps.select("t", "copy", "id", "n", "sig", "sig2"))
    members = members.select("t", "id", "rep").distinct()
    return members, cut(exact_pairs(rows, found))


def pairs(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(table_name, id_a, id_b) of all pairs, copies included."""
    members, links = versions(texts_of(documents, chunks))
    m1 = members.select("t", F.col("rep").alias("a"), F.col("id").alias("x"))
    m2 = members.select("t", F.col("rep").alias("b"), F.col("id").alias("y"))
    between = links.join(m1, ["t", "a"]).join(m2, ["t", "b"]).select("t", "x", "y")
    several = members.groupBy("t", "rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", F.col("rep").alias("a"))
    inner = several.join(m1, ["t", "a"]).join(m2.withColumnRenamed("b", "a"), ["t", "a"]).where("x < y").select("t", "x", "y")
    name = F.when(F.col("t") == 0, TABLES[0]).otherwise(TABLES[1])
    return between.unionByName(inner).select(name.alias("table_name"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(links: DataFrame) -> DataFrame:
    """(t, id, root): connected components of (t, a, b) by alternating large-star and small-star steps until no edge changes."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("t", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select("t", F.col("b").alias("u"), F.col("a").alias("v")))
        near = both.where("v > u" if large else "v < u")
        low = both.groupBy("t", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = near.join(low, ["t", "u"]).select("t", F.col("m").alias("a"), F.col("v").alias("b"))
        if not large:
            moved = moved.unionByName(low.select("t", F.col("m").alias("a"), F.col("u").alias("b")))
        return moved.where("a <> b").distinct()

    edges, last = cut(links.select("t", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None
    while True:
        edges = cut(star(star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("t", "a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return edges.select("t", F.col("b").alias("id"), F.col("a").alias("root"))


def groups(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(table_name, id, group_id, links) of every record that has another version; links counts the versions (copies of one text as one) it is directly linked to."""
    members, links = versions(texts_of(documents, chunks))
    roots = components(links)
    degree = links.select("t", F.explode(F.array("a", "b")).alias("rep")).groupBy("t", "rep").agg(F.count(F.lit(1)).alias("links"))
    copies = members.groupBy("t", "rep").agg(F.count(F.lit(1)).alias("copies"))
    rows = members.join(roots.select("t", F.col("id").alias("rep"), "root"), ["t", "rep"], "left").join(degree, ["t", "rep"], "left").join(copies, ["t", "rep"])
    name = F.when(F.col("t") == 0, TABLES[0]).otherwise(TABLES[1])
    return rows.where("links is not null or copies > 1").select(name.alias("table_name"), "id", F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
