import random

import numpy as np
import pytest

from vanthu.llm import neardup as N

RNG = random.Random(11)
VOCAB = [f"từ{i}" for i in range(3000)]


def corpus():
    texts, i = {}, 0
    for _ in range(60):
        base = [RNG.choice(VOCAB) for _ in range(RNG.randint(52, 200))]
        for _ in range(RNG.randint(1, 4)):
            w = list(base)
            for _ in range(RNG.randint(0, max(1, len(w) // 14))):
                w[RNG.randrange(len(w))] = RNG.choice(VOCAB)
            i += 1
            texts[i] = " ".join(w)
    texts[900], texts[901], texts[902] = texts[1], texts[1].upper(), "ngắn quá"
    return texts


def brute(texts):
    runs = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        if len(w) >= 50:
            runs[i] = set(zip(w, w[1:], w[2:]))
    ids = sorted(runs)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 2 * len(runs[a] & runs[b]) >= len(runs[a] | runs[b])}


@pytest.mark.parametrize("limit", [N.SHARD_LIMIT, 2])
def test_pairs_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(N, "SHARD_LIMIT", limit)
    monkeypatch.setattr(N, "COPIES_BROADCAST", N.COPIES_BROADCAST if limit > 2 else 0)
    if limit == 2:
        monkeypatch.setattr(N, "LEAF", 2)
    texts = corpus()
    chunks = spark.createDataFrame([*texts.items(), (1, texts[1]), (950, None), (951, "")], "id long, text string")
    docs = spark.createDataFrame([], "doc_id long, content_markdown string")
    want = brute(texts)
    got = {(r.id_a, r.id_b) for r in N.pairs(docs, chunks).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_groups_and_empty(spark):
    w = [RNG.choice(VOCAB) for _ in range(80)]
    v, u = list(w), list(w)
    v[10], u[60] = "khác", "nữa"
    chunks = spark.createDataFrame([(5, " ".join(w)), (6, " ".join(v)), (7, " ".join(u)), (8, " ".join(w)), (9, " ".join(RNG.choice(VOCAB) for _ in range(80)))], "id long, text string")
    docs = spark.createDataFrame([], "doc_id long, content_markdown string")
    got = {r.id: (r.group_id, r.links) for r in N.groups(docs, chunks).collect()}
    assert got == {5: (5, 2), 6: (5, 2), 7: (5, 2), 8: (5, 2)}
    assert N.pairs(docs, chunks.limit(0)).count() == 0


def test_vantage_tree_is_exact():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (40, 2), dtype=np.uint64)
    bits = np.concatenate([base, base ^ np.uint64(0b1011), base ^ np.uint64(1 << 40), np.repeat(base[:1], 50, 0)])
    a, b = N.VantageTree(bits).pairs(6)
    want = {(i, j) for i in range(len(bits)) for j in range(i + 1, len(bits)) if N.hamming(bits[i], bits[j]) <= 6}
    got = [(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())]
    assert set(got) == want and len(got) == len(want)


def test_limit_does_not_change_the_candidates(spark, monkeypatch):
    """The radius follows from all meetings of a pair, in shards on either side of the limit."""
    monkeypatch.setattr(N, "ALONE", -1)
    monkeypatch.setattr(N, "TWICE", -1)
    rng = random.Random(7)
    base, rows = [rng.choice(VOCAB) for _ in range(150)], []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        rows.append((1, i, " ".join(w)))
    sigs = N.cut(N.signatures(spark.createDataFrame(rows, "t int, id long, text string"), np.zeros(0, np.uint64)))
    got = []
    for limit, sample in ((N.SHARD_LIMIT, N.SAMPLE), (40, N.SAMPLE), (40, 1), (12, 1)):
        monkeypatch.setattr(N, "SHARD_LIMIT", limit)
        monkeypatch.setattr(N, "SAMPLE", sample)
        got.append({(r.a, r.b) for r in N.candidates(sigs.select("t", "id", "n", "sig", "sig2")).collect()})
    assert got[0] and all(g == got[0] for g in got)


def test_a_large_shard_is_not_held(spark):
    """A whole shard beyond the limit that comes in several batches is told by its size, the ones around it are compared."""
    import pyarrow as pa

    rows = [(1, 10), (1, 11)] + [(5, 100 + i) for i in range(90)] + [(7, 20), (7, 21)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([s for s, _ in part], pa.int64()), pa.array([i for _, i in part], pa.int64()), pa.array([0] * len(part), pa.int64()), pa.array([(4 * 60) << 32] * len(part), pa.int64())], names=["shard", "id", "bits", "tail"])
    for step in (1, 7, 94):
        got = [tuple(r.values()) for b in N._shard_pairs(iter([batch(rows[k : k + step]) for k in range(0, len(rows), step)]), 50) for r in b.to_pylist()]
        assert sorted(got) == [(-1, 5, 90, 0), (0, 10, 11, 0), (0, 20, 21, 0)], step


def test_repeated_passages_count_once(spark):
    w = [RNG.choice(VOCAB) for _ in range(100)]
    texts = {1: " ".join(w), 2: " ".join(w * 3)}
    docs = spark.createDataFrame([], "doc_id long, content_markdown string")
    got = {(r.id_a, r.id_b) for r in N.pairs(docs, spark.createDataFrame([*texts.items()], "id long, text string")).collect()}
    assert got == brute(texts) == {(1, 2)}
