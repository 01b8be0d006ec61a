import random

from hypothesis import given, settings, strategies as st

from vanthu.llm import splitting as P


def text_of(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append(rng.choice(["đất", "kho", "nước", "phí."]) + ("\n" if rng.random() < 0.03 else ""))
    return " ".join(out)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 1700), st.integers(0, 50))
def test_pieces_hold_all_words(n, seed):
    text = text_of(n, seed)
    words, pieces = text.split(), P.pieces_of(text, 3, None)
    assert bool(pieces) == (len(words) > 500)
    new = []
    for k, p in enumerate(pieces):
        w = p["text"].split()
        assert len(w) == p["n_words"] <= 500
        assert p["overlap_words"] == (50 if k else 0) and (not k or w[:50] == previous[-50:])
        new += w[p["overlap_words"] :]
        previous = w
    assert not pieces or new == words


def test_article_and_clause_are_carried():
    text = "mở đầu " + "kho " * 290 + "\nĐiều 7. Thu phí\n1. " + "đất " * 250 + "\n2. " + "nước " * 300
    pieces = P.pieces_of(text, 6, 4)
    assert (pieces[0]["dieu"], pieces[0]["khoan"]) == (6, 4) and 7 in pieces[0]["dieu_inside"] + pieces[1]["dieu_inside"]
    assert pieces[-1]["dieu"] == 7 and any(p["begins_at"] in ("article", "clause") for p in pieces[1:])


def test_an_edit_alters_neighbours_only():
    text = text_of(6000, 5)
    words = text.split(" ")
    edited = " ".join(words[:3000] + ["sửa"] + words[3000:])
    a, b = ({p["text"] for p in P.pieces_of(t, None, None)} for t in (text, edited))
    assert len(a - b) < len(a) / 2


def test_without_boundaries_and_exact_limit():
    assert P.pieces_of("x " * 500, None, None) == [] and len(P.pieces_of("x " * 501, None, None)) == 2


def test_found(spark):
    rows = [(1, "x " * 501, None, None), (1, "x " * 501, None, None), (2, "x " * 500, 1, 2), (3, None, None, None), (4, "", None, None)]
    df = spark.createDataFrame(rows, "id long, text string, dieu int, khoan int")
    assert [r.id for r in P.found(df).collect()] == [1] and P.split_oversized(df.limit(0)).count() == 0
