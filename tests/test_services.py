"""The store, uploads, model hooks, sessions and drafts, with their defined cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from vanthu.api import Engine
from vanthu.operators import chat, ingest, models, uploads
from vanthu.runtime import cut
from vanthu.sources.store import Conflict, Store


def test_commits_are_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.version() == 0 and store.read("chunks").count() == 0
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    assert store.commit(append={"chunks": rows}) == 1
    with pytest.raises(AttributeError):
        store.commit(append={"chunks": rows, "documents": None})
    assert store.version() == 1 and store.read("chunks").count() == 2
    store.commit(append={"chunks": rows}, replace={"doc_sections": rows.select("id")})
    assert store.read("chunks").count() == 4 and store.read("chunks", version=1).count() == 2
    store.commit(replace={"chunks": rows.limit(1)})
    assert store.read("chunks").count() == 1 and store.read("doc_sections").count() == 2
    with pytest.raises(Conflict):
        store._publish(3, {})
    assert store.vacuum() == 2 and store.read("chunks").count() == 1 and store.version() == 3


def test_upload_states(spark):
    rows = [("x/a.PDF", b"1"), ("x/b.docx", b"1"), ("x/c.doc", b"1"), ("x/d.pdf", b""), ("x/e.pdf", b"2"), ("x/noext", b"3")]
    known = spark.createDataFrame([(7, "7/X", "d4735e3a265e16eee03f59718b9b5d03019c07d8b6c51f90da3a666eec13ab35")], "doc_id long, doc_number string, file_hash string")
    got = {r.file_name: (r.state, r.document_id) for r in uploads.validate(spark.createDataFrame(rows, "path string, content binary"), known).collect()}
    assert got == {"a.PDF": ("validating", None), "b.docx": ("duplicate", None), "c.doc": ("failed", None), "d.pdf": ("failed", None), "e.pdf": ("duplicate", 7), "noext": ("failed", None)}
    assert uploads.validate(spark.createDataFrame([], "path string, content binary"), known).count() == 0


def test_models_that_fail_or_ramble(spark):
    rows = spark.createDataFrame([(1, "x" * 60), (2, "y" * 60), (3, "ngắn"), (4, None)], "id long, t string")

    def model(_i, text):
        if text[0] == "y":
            raise RuntimeError
        return 'so: {"fields": ["thuế"], "confidence": 0.5} end'

    got = {r.id: (r.fields, r.confidence, r.auto_applied) for r in models.auto_tag(rows, "id", "t", model).collect()}
    assert got == {1: (["thuế"], 0.5, False), 2: ([], 0.0, False), 3: ([], 0.0, False), 4: ([], 0.0, False)}
    assert {r.id: r.text for r in models.normalise(rows, "id", "t", lambda _i, t: t.upper() if t[0] == "x" else "").collect()} == {1: "X" * 60, 2: "y" * 60, 3: "ngắn", 4: None}
    assert models.form_values("q", "a", ["ho_ten", "ngay"], lambda _i, _t: 'x {"ngay": 5}') == {"ho_ten": "[Ho Ten]", "ngay": "5"}
    assert models.form_values("q", "a", ["x"], lambda _i, _t: "no") == {} == models.form_values("q", "a", ["x"], None)


def test_summaries_after_a_restart(spark):
    m = spark.createDataFrame([("a", k, "user", f"câu hỏi số {k} về đất", datetime.datetime(2024, 1, 1)) for k in range(6)], "session_id string, seq long, role string, content string, timestamp timestamp")
    s = lambda summary, n: spark.createDataFrame([("a", "u", datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 1), summary, n)], "session_id string, user_id string, created_at timestamp, updated_at timestamp, summary string, summarised long")
    assert [chat.due_now(s(*x), m).first().due for x in ((None, None), ("cũ", None), ("cũ", 2), ("cũ", 3))] == [True, False, True, False]
    told = chat.summarise(s(None, None), m, lambda _i, t: f"{t.count(chr(10))} dòng").first()
    assert (told.summary, told.summarised) == ("6 dòng", 6) and chat.summarise(s(None, None), m, None).first().summary is None


def test_articles_with_huge_numbers(spark):
    df = spark.createDataFrame([(1, "Điều 99999999999999. Quá lớn để đếm\n88888888888888. khoản quá lớn nữa")], "id long, t string")
    assert [(r.dieu, r.khoan) for r in ingest.parse_and_chunk(df, "id", "t").collect()] == [(None, None)]


def test_size_estimates_stay_bounded(spark):
    df = spark.range(4).withColumn("k", F.col("id") % 2)
    for _ in range(6):
        df = cut(df.join(df.select(F.col("id").alias("k"), F.col("k").alias("j")), "k").select("id", F.col("j").alias("k")))
    assert df.count() == 4 and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64


def test_requests_that_change_tables_need_a_store(spark, small):
    with pytest.raises(ValueError):
        Engine(spark, small).create_session()
    hits, total, facets = Engine(spark, small).search_page("khoản", size=5)
    assert hits.count() == 5 <= total and facets.count() > 0
    assert "".join(Engine(spark, small).stream("xin chào")).endswith("data: [DONE]\n\n")


def test_command_line(spark, tmp_path, capsys):
    from vanthu import cli

    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "aaaaaaaaaaaa-1.json").write_text('{"source_id": "s", "chunks": [\n{"index": 0, "text": "QUYẾT ĐỊNH\\nVề việc nạo vét kênh chính", "document_number": "1/QD-X"},\n{"index": 0, "text": "Văn bản khác", "document_number": "2/QD-X"}]}')
    (tmp_path / "corpus" / "bad.json").write_text("{")
    store = str(tmp_path / "store")
    run = lambda *args: cli.main([str(tmp_path / "corpus"), *args, "--store", store], spark)
    run("load"), run("load"), run("compile", "--limit", "1"), run("compile"), run("compile"), run("compile", "--all"), run("lint"), run("status")
    out = capsys.readouterr().out
    assert [line for line in out.split("\n") if ":" in line] == ["loaded: 2", "loaded: 0", "compiled: 1", "compiled: 1", "compiled: 0", "compiled: 2"] and "warn" in out and "wiki_pages" in out


def test_index_of_nothing_and_its_plan(spark, small):
    from vanthu.operators import search, vectors

    docs = spark.read.parquet(f"{small}/documents.parquet")
    empty = search.build_index(docs.limit(0), "doc_id", search.DOC_COLUMNS)
    assert empty.rows == 0 and search.bm25(empty, "giếng khoan").count() == 0 and search.bm25(empty, "!!").count() == 0
    index = search.build_index(docs, "doc_id", ["title"])
    plan = search.phrase_counts(index, "khoan")._jdf.queryExecution().toString()
    assert "StringStartsWith(token,khoan)" in plan and search.phrase_counts(index, "không-có zzz").count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    assert vectors.search(vectors.build(none), none.selectExpr("vec_id as query_id", "embedding"), 3, 1).count() == 0
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [1.0]), (5, None)], "vec_id long, embedding array<float>")
    got = vectors.search(vectors.build(few, cells=2), few.where("vec_id = 1").selectExpr("vec_id as query_id", "embedding"), 3, 2)
    assert [(r.vec_id, r.score) for r in got.orderBy("vec_id").collect()] == [(1, 1.0), (2, 0.0), (3, 1.0)]
