import unicodedata

from vanthu.llm import lookalike as L


def rewriter(texts=("a b c điều ề",)):
    counts = {}
    for t in texts:
        for c in t:
            counts[c] = counts.get(c, 0) + 1
    return L.Rewriter(L.representatives(L._classes(), counts))


def test_rewrites_what_imitates():
    r = rewriter()
    for bad, good in [("Đіều", "Điều"), ("Ｋｉｎｈ　phí", "Kinh phí"), ("Ɖiều Ðiều", "Điều Điều"), ("về", "về"), ("về", "về"), ("ệ", "ệ"), ("ﬁeld", "field"), ("quý Ⅲ", "quý III"), ("a​b\xadc", "abc"), ("x y\xa0z", "x y z"), ("TT‑CMG", "TT-CMG"), ("Ｖｅ̂̀", "Về"), ("е̂̀ x", "ề x"), ("34С", "34C"), ("a\x07b", "ab"), ("\U0001d400BC \U0001d7d9\U0001d7da", "ABC 12"), ("x\U000e0100y", "xy")]:
        assert r(bad) == good, (bad, r(bad), good)


def test_keeps_what_does_not():
    r = rewriter()
    for text in ["m² – α = 0,7 Ω Δ", "nhãn Заря", "СССР", "хор", "РОСТ", "hội СССР 1990", "a\tb\nc\r\n", "hoà hòa", "", "ABC abc 123 [[PAGE_1]]", "…"]:
        assert r(text) == text


def test_spellings_are_equivalent():
    for letter in "ệấũỡợậ":
        for s in L.spellings(letter):
            assert unicodedata.normalize("NFC", s) == letter or sorted(unicodedata.normalize("NFD", s)) == sorted(unicodedata.normalize("NFD", letter))


def test_classes_are_transitive_and_frequency_decides():
    c = L.Classes()
    for a, b in [("x", "y"), ("y", "z"), ("p", "q")]:
        c.union(a, b)
    assert c.find("x") == c.find("z") != c.find("p")
    assert L.representatives(c, {"x": 1, "y": 5, "z": 2, "q": 1}) == {"x": "y", "z": "y", "p": "q"}


def test_found_and_canonical(spark):
    docs = spark.createDataFrame([(1, "Đіều 1", "x"), (2, "Điều 1", "x"), (3, None, "x"), (4, "", "x")], "doc_id long, title string, text string")
    chunks = spark.createDataFrame([(7, "a\xa0b", "s"), (7, "a\xa0b", "s"), (8, "a b", "s"), (9, None, "s")], "id long, text string, title string")
    assert {tuple(r) for r in L.found(docs, chunks).collect()} == {("documents", 1), ("chunks", 7)}
    rows, mapping = L.titles_and_chunks(docs, chunks)
    got = {(r.table_name, r.id): r.text for r in L.canonical(rows, mapping).collect()}
    assert got[("documents", 1)] == got[("documents", 2)] and got[("documents", 3)] is None and got[("chunks", 7)] == "a b"
    assert L.found(docs.limit(0), chunks.limit(0)).count() == 0


def test_words_of_another_alphabet(spark, monkeypatch):
    """A word wholly of twins imitates a Latin one only if the corpus has that more often; broadcast and joined alike."""
    titles = ["hợp tác xã", "co sở co", "со sở", "thuyền СССР", "hát хор", "CCCP", "Cao СССР", "ΗΟ", "HO HO"]
    docs = spark.createDataFrame(list(enumerate(titles)), "doc_id long, title string")
    chunks = spark.createDataFrame([], "id long, text string")
    for most in (L.BROADCAST_WORDS, 0):
        monkeypatch.setattr(L, "BROADCAST_WORDS", most)
        assert {r.id for r in L.found(docs, chunks).collect()} == {2, 7}
        got = {r.id: r.text for r in L.canonical(*L.titles_and_chunks(docs, chunks)).collect()}
        assert got[2] == "co sở" and got[3] == titles[3] and got[7] == "HO"
