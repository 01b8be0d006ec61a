from vanthu.llm import scans, truncation

WORDS = "phòng kế hoạch tổng hợp phải gia hạn có điều kiện phương án di dời trước ngày sáp nhập cho đơn vị cung ứng hóa chất tại kho vật tư dự phòng chưa nghiệm thu không quá mức".split()
CLEAN = "Điều 1. Lưu trữ\n1. " + " ".join(WORDS * 4) + "."


def frames(spark, texts):
    docs = spark.createDataFrame([(100 + i, CLEAN) for i in range(60)] + list(enumerate(texts)), "doc_id long, content_markdown string")
    return docs, spark.createDataFrame([], "id long, text string")


def test_noise_kinds(spark):
    texts = [
        "1. phòng kế hoạch tổng hợp phải gia h-\nạn có điều kiện phương án di dời.",
        "1. phòng kế hoạch tổng hợp phải gia hạn\ntr. 8\n[[PAGE_9]]\ncó điều kiện phương án di dời.",
        "1. phòng kế h'oạch tổng hợp phải gia hạn.",
        "1. phòng kế hoạch tổng hợp phải gia h-\nBỘ BẾN BÃI | Lưu hành nội bộ\nạn có điều kiện phương án.",
        "1. phòng kế hoạch tổng hợp phải g-\nBỘ KHO | Lưu hành nội bộ\nia hạn có điều kiện phương án.",
        CLEAN.replace("hạn có", "hạn\ncó"),
        None,
        "",
    ]
    got = {}
    for r in scans.found(*frames(spark, texts)).collect():
        got.setdefault(r.id, set()).add(r.noise)
    assert got == {0: {"line_hyphen"}, 1: {"page_number"}, 2: {"misread"}, 3: {"line_hyphen", "running_header"}, 4: {"line_hyphen", "running_header"}}


def test_paragraphs(spark):
    texts = ["1. phòng kế h'oạch tổng hợp phải gia h-\ntr. 8\n[[PAGE_9]]\nạn có điều kiện\nphương án di dời.\n2. kho vật tư\ndự phòng."]
    rows = [r for r in scans.paragraphs(*frames(spark, texts)).collect() if r.id == 0]
    assert [r.text for r in sorted(rows, key=lambda r: r.paragraph)] == ["1. phòng kế hoạch tổng hợp phải gia hạn có điều kiện phương án di dời.", "2. kho vật tư dự phòng."]


def test_paragraphs_of_repeated_rows(spark):
    """Rows delivered twice give their paragraphs once; of different texts under one id one is kept whole."""
    docs, none = frames(spark, ["1. phòng kế hoạch\ntổng hợp.\n2. kho vật tư.", "x"])
    again = docs.unionByName(docs).unionByName(spark.createDataFrame([(1, "y z")], docs.schema)).withColumn("text", docs["content_markdown"])
    got = {(r.id, r.paragraph): r.text for r in scans.paragraphs(again, none).collect() if r.id < 100}
    assert len(got) == 3 and got[(0, 1)] == "1. phòng kế hoạch tổng hợp." and got[(0, 2)] == "2. kho vật tư." and got[(1, 1)] in ("x", "y z")


def test_skeletons_meet():
    for bad, good in [("riăm", "năm"), ("kliu", "khu"), ("fhiểu", "thiểu"), ("dich", "dịch"), ("s@o", "sao"), ("ốn9", "ống"), ("g|ữ", "giữ"), ("đồrig", "đồng")]:
        assert scans.skeleton(bad) == scans.skeleton(good)


def test_truncated(spark):
    whole = CLEAN + "\n" + CLEAN
    rows = [(i, "a", whole) for i in range(40)]
    rows += [(100, "a", whole + " phòng kế hoạch tổng hợp phải gia hạn có điều kiện phương án di dời trước ngày sáp nhập cho đơn vị cung ứng hó"), (101, "a", whole + " kho vật tư…"), (102, "a", whole + " kho vật t\\u1e"), (103, "b", None), (104, "b", " \n"), (105, None, whole.rstrip(".")), (106, "a", "Các khoản khác gồm kho vật tư, v.v...")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.evidence for r in truncation.truncated(df).collect()}
    assert set(got) == {100, 101, 102} and got[100] == "word"
    by = {r.source: r.share for r in truncation.by_source(df).collect()}
    assert by["b"] == 0 and by[None] == 0 and by["a"] > 0
    assert truncation.found(df.limit(0)).count() == 0


def test_trie(spark):
    words = spark.createDataFrame([("quản",), ("quản lý",), ("quả",), ("x",)], "word string")
    ends = spark.createDataFrame([("qu",), ("quản",), ("x",), ("y",)], "node string")
    assert sorted(tuple(r) for r in truncation.trie(words, ends).collect()) == [("qu", "quả"), ("qu", "quản"), ("qu", "quản lý"), ("quản", "quản lý")]


def test_long_residues_and_words():
    assert truncation.core_of("kho vật tư" + "." * 300) == ("kho vật tư", True)
    assert truncation.core_of("kho vật tư" + " " * 300) == ("kho vật tư", False)
    assert truncation.core_of("a" * 500 + "…") == ("a" * 500, True)


def test_several_forms_are_chosen_by_their_neighbours(spark):
    clean = "Điều 1. Lưu trữ\n1. " + "giao dịch điện tử có hiệu lực. " * 3 + "quân địch tấn công trước."
    docs = spark.createDataFrame([(100 + i, clean) for i in range(60)] + [(0, "1. quân d'ich tấn công trước."), (1, "1. giao d'ich điện tử"), (2, "1. lưu d1ch\ntấn công trước.")], "doc_id long, content_markdown string")
    got = {r.id: r.text for r in scans.paragraphs(docs, spark.createDataFrame([], "id long, text string")).collect() if r.id < 100}
    assert got == {0: "1. quân địch tấn công trước.", 1: "1. giao dịch điện tử", 2: "1. lưu địch tấn công trước."}


def spoil(text, rng):
    """A clean text as a scan would give it: words misread and divided over line ends, heads and page numbers in between."""
    out = []
    for n, line in enumerate(text.split("\n")):
        words = line.split(" ")
        for k, w in enumerate(words):
            if len(w) > 3 and w.isalpha() and w.islower() and rng.random() < 0.04:
                words[k] = rng.choice([w[:2] + "'" + w[2:], w.replace("i", "1", 1), w.replace("o", "0", 1), w.replace("u", "ii", 1), w[:1] + "|" + w[1:]])
        if len(words) > 12 and not line.startswith(("#", "|")):
            k = next((k for k in range(5, len(words) - 3) if words[k].isalpha() and words[k].islower() and len(words[k]) > 3), None)
            if k and rng.random() < 0.7:
                head = rng.choice(["", "\nBỘ BẾN BÃI | Lưu hành nội bộ", f"\n{rng.randint(2, 90)}\n[[PAGE_3]]"])
                words[k] = words[k][:2] + "-" + head + "\n" + words[k][2:]
        out.append(" ".join(words))
    return "\n".join(out)


def test_repair_restores_what_was_written(spark):
    """Of the words of planted scans, nearly all come out as they were before the noise, many more than without repair."""
    import random
    from collections import Counter

    from pyspark.sql import functions as F

    folder = "/root/testdata/sf0.01"
    docs, chunks = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "chunks"))
    noisy = scans.found(docs, chunks.limit(0)).select(F.col("id").alias("doc_id")).distinct()
    clean = {r.doc_id: r.content_markdown for r in docs.join(noisy, "doc_id", "left_anti").where("content_markdown is not null").select("doc_id", "content_markdown").collect()}
    rng = random.Random(5)
    planted = {i: spoil(t, rng) for i, t in clean.items() if i % 4 == 0}
    rows = spark.createDataFrame([(i, planted.get(i, t)) for i, t in clean.items()], "doc_id long, content_markdown string")
    out = {}
    for r in scans.paragraphs(rows, chunks.limit(0).select("id", "text")).where("table_name = 'documents'").collect():
        if r.id in planted:
            out.setdefault(r.id, []).append(r.text)

    def share(texts):
        same = total = 0
        for i in planted:
            want, got = Counter(clean[i].split()), Counter(texts[i].split())
            same, total = same + sum((want & got).values()), total + sum(want.values())
        return same / total

    before, after = share(planted), share({i: " ".join(out[i]) for i in planted})
    print(f"words as written: {before:.4f} before, {after:.4f} after repair")
    assert len(planted) > 50 and after > 0.985 and 1 - after < (1 - before) / 2
