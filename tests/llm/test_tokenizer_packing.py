
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from vanthu.llm import packing, tokenizer


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(tokenizer.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab \n\t'stlre1.,–đ̉ệ<|endoftx>", max_size=120))
def test_same_ids_and_round_trip(text):
    public = Tokenizer.from_file(tokenizer.DEFAULT_VOCABULARY) if not hasattr(test_same_ids_and_round_trip, "t") else test_same_ids_and_round_trip.t
    test_same_ids_and_round_trip.t = public
    public.encode_special_tokens = True
    e = tokenizer.encoder(tokenizer.DEFAULT_VOCABULARY)
    ids = e.encode(text)
    assert ids == public.encode(text, add_special_tokens=False).ids
    assert e.automaton.decode(ids).decode() == text and e.count(text) == len(ids)


def test_long_runs(public):
    e = tokenizer.encoder(tokenizer.DEFAULT_VOCABULARY)
    for text in ["a" * 3000, " " * 200 + "y", "đ" * 500, "<|endoftext|>" * 3]:
        assert e.encode(text) == public.encode(text, add_special_tokens=False).ids


def test_frames(spark):
    df = spark.createDataFrame([(1, "giếng khoan", 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in tokenizer.encode_texts(df).collect()}
    assert got[2] == got[3] == [] and len(got[1]) == next(r.n_tokens for r in tokenizer.count_tokens(df).collect() if r.doc_id == 1)
    assert tokenizer.encode_texts(df.limit(0)).count() == 0


def brute(sizes, capacity):
    best = len(sizes)

    def go(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(sizes):
            best = len(loads)
            return
        for k in range(len(loads)):
            if loads[k] + sizes[i] <= capacity:
                loads[k] += sizes[i]
                go(i + 1, loads)
                loads[k] -= sizes[i]
        go(i + 1, [*loads, sizes[i]])

    go(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_packing_against_brute_force(sizes):
    w = packing.pack(np.array(sizes, dtype=np.int64), 20)
    assert len(w) == len(sizes)
    if sizes:
        assert np.bincount(w, weights=sizes).max() <= 20 and w.max() + 1 <= brute(sorted(sizes, reverse=True), 20) + 1


def best_fit_decreasing(sizes, capacity):
    return len(set(packing._best_fit(sizes, np.arange(len(sizes)), capacity, 0)[0].values()))


def test_packing_is_tight():
    """At most half a percent above the bound, and never above best-fit decreasing, for even and for skewed sizes."""
    rng = np.random.default_rng(3)
    even = rng.integers(1, 2049, 3000)
    skewed = np.clip(rng.lognormal(6.5, 1.0, 3000).astype(np.int64), 1, 2048)
    narrow = np.clip(rng.lognormal(6.8, 0.6, 3000).astype(np.int64), 1, 2048)
    for sizes in (even, skewed, narrow):
        w = packing.pack(sizes, 2048)
        bound = max(-(-sizes.sum() // 2048), (2 * sizes > 2048).sum())
        assert np.bincount(w, weights=sizes).max() <= 2048 and w.min() == 0
        assert w.max() + 1 <= best_fit_decreasing(sizes, 2048) and w.max() + 1 <= 1.006 * bound


def test_containers(spark):
    rows = [(1, 5000), (2, 2048), (3, 0), (4, 100), (5, 100), (5, 100), (6, 2049)]
    got = [tuple(r) for r in packing.fill_containers(spark.createDataFrame(rows, "doc_id long, n_tokens long")).collect()]
    covered = {}
    for doc, _, a, b in got:
        covered.setdefault(doc, []).append((a, b))
    assert {d: sorted(v) for d, v in covered.items()} == {1: [(0, 2048), (2048, 4096), (4096, 5000)], 2: [(0, 2048)], 4: [(0, 100)], 5: [(0, 100)], 6: [(0, 2048), (2048, 2049)]}
    assert len({c for _, c, _, _ in got}) == 5
