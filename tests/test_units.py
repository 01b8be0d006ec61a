"""Text functions, sources, drafts and streaming on literal inputs."""

import datetime
import io
import sqlite3
import zipfile

from pyspark.sql import functions as F

from vanthu.api import Engine
from vanthu.functions import dims, text as T
from vanthu.operators import chat, docgen, ingest, rag, search
from vanthu.sources import files
from vanthu.streaming import incremental


def test_full_text_matches_sqlite(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", *search.DOC_COLUMNS).collect()]
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE VIRTUAL TABLE t USING fts5({', '.join(search.DOC_COLUMNS)}, tokenize='unicode61')")
    con.executemany("INSERT INTO t(rowid, doc_number, title, content_markdown, issuing_authority) VALUES (?,?,?,?,?)", rows)
    index = search.build_index(docs.unionByName(docs), "doc_id", search.DOC_COLUMNS)  # rows delivered twice count once
    for query in ["giếng khoan", "quản lý", "nghiem thu", "QĐ-TTLT", "kho vật tư dự phòng"]:
        match = " ".join(f'"{w}"*' for w in query.split())
        want = {i: s for i, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
        got = {r["id"]: r["score"] for r in search.bm25(index, query).collect()}
        assert set(got) == set(want) and all(abs(got[i] - want[i]) <= 1e-9 + 1e-6 * abs(want[i]) for i in want)


def test_rerank_and_tag_goldens(spark):
    rows = spark.createDataFrame([(1, 1.0, "con_hieu_luc", "luat"), (2, 1.0, "het_hieu_luc", "nghi_dinh"), (3, 1.0, "x", "bao_cao_tong_hop"), (4, 1.0, "", "")], "chunk_id int, score double, st string, ty string")
    got = {r.chunk_id: r.tag for r in rows.select("chunk_id", rag.tag(F.col("ty"), F.col("st")).alias("tag")).collect()}
    assert got[1] == "[🟢 | LUẬT | Hiệu lực pháp lý: 14/15]" and got[2] == "[🔴 | NGHỊ ĐỊNH | Hiệu lực pháp lý: 11/15]"
    assert "9/15" in got[3] and "BAO_CAO_TONG_HOP" in got[3] and "VĂN BẢN" in got[4] and "⚪" in got[4]
    assert len(dims.HIERARCHY) == 24 and all(1 <= r <= 15 for _, r, _ in dims.HIERARCHY) and len(set(dims.STATUS_ICON.values())) == 4


def test_chunking(spark):
    df = spark.createDataFrame([(1, "mở đầu dài dòng\nĐiều 1. A theo luật\nĐiều 2. B\n1. khoản thứ nhất\n2. khoản thứ hai"), (2, "x " * 1200), (3, None), (4, "")], "id long, t string")
    got = [tuple(r) for r in ingest.parse_and_chunk(df, "id", "t").where("id = 1").orderBy("index").select("text", "dieu", "khoan").collect()]
    # an article's own number begins a clause, and pieces of under ten characters are dropped
    assert got == [("mở đầu dài dòng", None, None), ("1. A theo luật", 1, 1), ("1. khoản thứ nhất", 2, 1), ("2. khoản thứ hai", 2, 2)]
    assert [r.token_count for r in ingest.parse_and_chunk(df, "id", "t").where("id = 2").orderBy("index").collect()] == [1200]  # windows serve only texts without a piece
    assert ingest.parse_and_chunk(df, "id", "t").where("id in (3, 4)").count() == 0


def test_corpus_and_docx(spark, tmp_path):
    (tmp_path / "aaaaaaaaaaaa-1.json").write_text('{"source_id": "s", "chunks": [{"index": 0, "text": "QUYẾT ĐỊNH\\nVề việc nạo vét kênh chính", "document_number": "1/QD-X"}, {"index": 1, "text": "Điều khoản", "dieu": 1, "document_number": "1/QD-X"}, {"index": 2, "text": "Điều  khoản", "document_number": "1/QD-X"}]}')
    (tmp_path / "bad.json").write_text("{")
    d, s, c = Engine(spark, str(tmp_path)).ingest(str(tmp_path))
    one = d.collect()
    assert len(one) == 1 and one[0].title == "Quyết định số 1/QD-X: Về việc nạo vét kênh chính" and one[0].n_chunks == 2 and [r.title for r in s.collect()] == ["Dieu 1"]
    rows = [r.asDict() for r in docgen.blocks(spark.createDataFrame([(0, "# A\nHà Nội, ngày 1 tháng 2 năm 2024\n- x")], "id int, text string")).orderBy("n").collect()]
    assert [(r["style"], r["align"]) for r in rows] == [("heading1", "left"), ("body", "right"), ("bullet", "left")]
    data = files.write_docx(rows)
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None and files.docx_text(data).split("\n")[0] == "A" and files.docx_text(b"x") is None
    (tmp_path / "u.docx").write_bytes(data)
    (tmp_path / "v.pdf").write_bytes(b"%PDF")
    up = files.read_uploads(spark, f"{tmp_path}/*.[dp]*")
    assert {(r.path.rsplit("/")[-1], r.status) for r in files.extract_text(up).collect()} == {("u.docx", "parsing"), ("v.pdf", "failed")}


def test_strict_search_orders_before_the_page(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = search.search_documents(docs, "khoản", size=5, strict=True).orderBy("rank").collect()
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_session_memory_stream(spark, tmp_path):
    rows = [(1, "user")] * 5 + [(2, "user"), (2, "system")]
    spark.createDataFrame(rows, "session_id long, role string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("session_id long, role string").parquet(f"{tmp_path}/in")
    q = incremental.session_memory(stream).writeStream.outputMode("update").format("memory").queryName("memory_out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("memory_out").collect()} == {(1, 5, True), (2, 1, False)}


def test_sessions(spark):
    a = spark.createDataFrame([("s1", "u", datetime.datetime(2024, 1, 1))], "session_id string, user_id string, created_at timestamp")
    b = spark.createDataFrame([("s1", "v", datetime.datetime(2024, 1, 2)), ("s2", "v", datetime.datetime(2024, 1, 2))], a.schema)
    assert {(r.session_id, r.user_id) for r in chat.create_sessions(a, b).collect()} == {("s1", "u"), ("s2", "v")}


def test_highlight_is_sequential(spark):
    one = spark.createDataFrame([("abc mark xyz",)], "t string")
    assert one.select(T.highlight(F.col("t"), "abc mark")).first()[0] == "<<mark>mark</mark>>abc</<mark>mark</mark>> <mark>mark</mark> xyz"
