"""Queries of uploads, the store, sinks, streams, sessions and model hooks."""

from __future__ import annotations

import datetime
import io
import zipfile

from pyspark.sql import functions as F

from vanthu.functions import formats
from vanthu.operators import chat, guard, ingest, models, relations
from vanthu.plans import pipeline as P, sqltext as S, textsql as TX, wikisql as X
from vanthu.runtime import scratch, table
from vanthu.sources import files
from vanthu.sources.store import Store
from vanthu.streaming import incremental

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def docs(spark, d):
    return table(spark, d, "documents")


# ---- relations in literal documents: every phrase once, repeats, the own number, and sections
_STATED = [
    (-1, "1/2026/NĐ-CP", "Điều 4. Thay thế Nghị định số 15/2020/NĐ-CP, nay thay thế Nghị định 15/2020/NĐ-CP.", [("15/2020/NĐ-CP", "thay_the", "Điều 4")]),
    (-2, "2/2026/TT-A", "Thông tư số 8/2019/TT-BTC hết hiệu lực từ nay.", [("8/2019/TT-BTC", "thay_the", "")]),
    (-3, "3/2026/TT-A", "Điều 7\nSửa đổi, bổ sung một số điều của Thông tư số 9/2018/TT-BYT.", [("9/2018/TT-BYT", "sua_doi", "Điều 7")]),
    (-4, "4/2026/TT-A", "Sửa đổi Điều 3, Điều 5 của Nghị định số 10/2017/NĐ-CP", [("10/2017/NĐ-CP", "sua_doi", "")]),
    (-5, "5/2026/TT-A", "Hướng dẫn thi hành một số điều của Nghị định số 11/2016/NĐ-CP", [("11/2016/NĐ-CP", "huong_dan", "")]),
    (-6, "6/2026/TT-A", "Quy định chi tiết thi hành Nghị định số 12/2015/NĐ-CP", [("12/2015/NĐ-CP", "huong_dan", "")]),
    (-7, "7/2026/TT-A", "Bãi bỏ Điều 2 của Quyết định số 13/2014/QĐ-UBND", [("13/2014/QĐ-UBND", "bai_bo", "")]),
    (-8, "8/2026/TT-A", "BÃI BỎ Quyết định số 14/2013/QĐ-UBND", [("14/2013/QĐ-UBND", "bai_bo", "")]),
    (-9, "9/2026/TT-A", "Căn cứ Nghị định số 16/2012/NĐ-CP; căn cứ Nghị định số 9/2026/TT-A;", [("16/2012/NĐ-CP", "vien_dan", "")]),
    (-10, "10/2026/TT-A", "theo quy định tại Điều 5 Nghị định số 17/2011/NĐ-CP", [("17/2011/NĐ-CP", "vien_dan", "")]),
    (-11, "11/2026/TT-A", None, []),
    (-12, None, "Căn cứ Quyết định số 698/QĐ-TTg", [("698/QĐ-", "vien_dan", "")]),
]
_STATED_ROWS = ", ".join(f"({i}, {S.quote(n)}, {S.quote(k)}, {S.quote(s)})" for i, _, _, found in _STATED for n, k, s in found)
_STATED_SQL = f"SELECT source_doc_id, target_doc_number, relation_type, source_section FROM (VALUES {_STATED_ROWS}) t(source_doc_id, target_doc_number, relation_type, source_section)"


def _stated(spark):
    return spark.createDataFrame([(i, n, t) for i, n, t, _ in _STATED], "doc_id long, doc_number string, content_markdown string")


def _extract_sql() -> str:
    """Common table expressions up to ex (source_doc_id, target_doc_number, relation_type, source_section) over all documents."""
    legs = []
    for k, (kind, pattern) in enumerate(relations.PHRASES):
        p = pattern.replace(r"[,\s]", "[,WS]").replace(r"[^\s,;\.]", "[^WS,;\\.]").replace(r"[^\s,;]", "[^WS,;]").replace(r"\s", "[WS]").replace("WS", X.WS[1:-1])
        legs.append(f"SELECT doc_id, doc_number, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, {S.quote(p)}, 0, 'i') AS ms, regexp_split_to_array(t, {S.quote('(?i)' + p)}) AS sp FROM src")
    number = r"(?:^|[^\p{L}\p{N}_])(\d+(?:/\d+)?(?:/[A-ZĐ\-]+)*/(?:[A-ZĐ\-]*-|[A-ZĐ\-]*[A-ZĐ](?:$|[^\p{L}\p{N}_])))"
    return (
        "src AS (SELECT doc_id, doc_number, content_markdown AS t FROM documents WHERE content_markdown IS NOT NULL), legs AS (" + " UNION ALL ".join(legs) + "), "
        "mm AS (SELECT doc_id, doc_number, k, kind, i, ms[i] AS m, right(array_to_string(list_transform(range(1, i + 1), lambda j: coalesce(sp[j], '') || CASE WHEN j < i THEN ms[j] ELSE '' END), ''), 500) AS bef FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM legs WHERE len(ms) > 0)), "
        f"nn AS (SELECT *, regexp_replace(n0, '[^\\p{{L}}\\p{{N}}_\\-]+$', '') AS n FROM (SELECT *, unnest(regexp_extract_all(m, {S.quote(number)}, 1)) AS n0 FROM mm)), "
        "ex AS (SELECT doc_id AS source_doc_id, n AS target_doc_number, kind AS relation_type, CASE WHEN regexp_matches(bef, '(?i)Điều\\s+\\d') THEN 'Điều ' || regexp_extract(bef, '(?i)Điều\\s+(\\d+)', 1) ELSE '' END AS source_section FROM nn WHERE n IS DISTINCT FROM doc_number QUALIFY row_number() OVER (PARTITION BY doc_id, kind, n ORDER BY k, i) = 1)"
    )


_EXTRACTED = _extract_sql()
P.ORACLE_SQL["q_extract_relations"] = f"WITH {_EXTRACTED} SELECT * FROM ex"
P.ORACLE_SQL["q_store_relations"] = f"WITH {_EXTRACTED}, st AS (SELECT DISTINCT source_doc_id, target_doc_number, relation_type FROM doc_relations) SELECT ex.*, (SELECT min(doc_id) FROM documents d WHERE d.doc_number = ex.target_doc_number) AS target_doc_id FROM ex WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.source_doc_id = ex.source_doc_id AND st.target_doc_number = ex.target_doc_number AND st.relation_type = ex.relation_type)"


@query(_STATED_SQL)
def fn_relation_phrases(spark, _d):
    """Relations of literal documents that state each phrase."""
    return relations.extract(_stated(spark))


@query("SELECT relation_type, detected_by, target_doc_number FROM (VALUES ('vien_dan', 'regex', '698/QĐ-'), ('thay_the', 'llm', '5/X')) t(relation_type, detected_by, target_doc_number)")
def set_union_relations(spark, _d):
    """The relations of a document by rule and by a model; what both say counts once, as the rule's."""
    one = _stated(spark).where("doc_id = -12").withColumn("content_markdown", F.concat("content_markdown", F.lit(" về việc phê duyệt kế hoạch nạo vét kênh")))
    told = models.relations_told(one, lambda _i, _t: '[{"type": "vien_dan", "target": "698/QĐ-"}, {"type": "thay_the", "target": "5/X"}]')
    return relations.merge_model_relations(relations.extract(one), told).select("relation_type", "detected_by", "target_doc_number")


@query("SELECT count(DISTINCT id)::BIGINT AS relations, count(DISTINCT source_doc_id)::BIGINT AS documents FROM doc_relations")
def agg_sum_counts(spark, d):
    """The sum of what each document gave."""
    per = table(spark, d, "doc_relations").groupBy("source_doc_id").agg(F.count_distinct("id").alias("n"))
    return per.agg(F.sum("n").alias("relations"), F.count("source_doc_id").alias("documents"))


# ---- streams over files, whose results are the store's
@query(f"WITH {_EXTRACTED} SELECT source_doc_id, target_doc_number, relation_type, source_section, 'regex' AS detected_by FROM ex UNION ALL SELECT *, 'regex' FROM ({_STATED_SQL})")
def str_incremental_relations(spark, d):
    """Relations stored by runs of the incremental job: over all documents, over literal ones that came later, and over all again after a reset."""
    folder = scratch(spark, "relations")
    store, glob, seen = Store(spark, f"{folder}/store"), f"{folder}/in/*", f"{folder}/seen"
    columns = docs(spark, d).select("doc_id", "doc_number", "content_markdown")
    columns.write.parquet(f"{folder}/in/a")
    incremental.relations_of_new(spark, columns.schema, glob, store, seen)
    _stated(spark).write.parquet(f"{folder}/in/b")
    incremental.relations_of_new(spark, columns.schema, glob, store, seen)
    incremental.reset(spark, seen)
    incremental.relations_of_new(spark, columns.schema, glob, store, seen)
    return store.read("doc_relations").select("source_doc_id", "target_doc_number", "relation_type", "source_section", "detected_by")


@query(
    f"WITH {X.PAGES}, w AS (SELECT slug, coalesce(min(document_id) FILTER (WHERE document_id % 2 = 0), min(document_id)) AS document_id, coalesce(max(document_id) FILTER (WHERE document_id % 2 <> 0), max(document_id)) AS filled_by FROM comp GROUP BY 1) "
    "SELECT w.slug, w.document_id, c.title, c.doc_number FROM w JOIN comp c ON c.slug = w.slug AND c.document_id = w.filled_by"
)
def str_incremental_wiki(spark, d):
    """Pages stored by two runs of the incremental job, over half of the documents each: a page keeps its first document and is filled by the last."""
    folder = scratch(spark, "wiki")
    store, glob, seen = Store(spark, f"{folder}/store"), f"{folder}/in/*", f"{folder}/seen"
    store.commit(append={"chunks": table(spark, d, "chunks")})
    for k in (0, 1):
        docs(spark, d).where((F.col("doc_id") % 2) == k).write.parquet(f"{folder}/in/{k}")
        incremental.pages_of_new(spark, docs(spark, d).schema, glob, store, seen, today=datetime.date.fromisoformat(X.TODAY))
    return store.read("wiki_pages").select("slug", "document_id", "title", "doc_number")


@query("WITH " + P._MSG + ", c AS (SELECT session_id, count(*) FILTER (WHERE role <> 'system') AS n FROM m GROUP BY 1) SELECT session_id, n, n >= 4 AS due FROM c")
def str_chat_memory(spark, d):
    """What the stateful stream of messages says of each session after one micro-batch."""
    folder = scratch(spark, "memory")
    P._messages(spark, d).select("session_id", "role").coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("session_id long, role string").parquet(f"{folder}/in")
    out = incremental.session_memory(stream).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/seen").trigger(availableNow=True)
    out.foreachBatch(lambda batch, n: batch.write.parquet(f"{folder}/out/{n}")).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out/*")


@query("SELECT 1::BIGINT AS documents, 1::BIGINT AS again, 3::BIGINT AS indexed, 2::BIGINT AS relations")
def str_startup_bg(spark, _d):
    """What a new service does: seeds from its corpus folder, indexes, extracts relations; a second start adds nothing."""
    from vanthu.api import Engine

    folder = scratch(spark, "start")
    text = ["QUYẾT ĐỊNH\nVề việc nạo vét kênh chính", "Căn cứ Nghị định số 16/2012/NĐ-CP, căn cứ Luật số 3/2011/QH-X", "Bãi bỏ điều khoản khác"]
    one = F.array(*[F.struct(F.lit(str(k)).alias("id"), F.lit(k).alias("index"), F.lit(t).alias("text"), F.lit(k or None).cast("int").alias("dieu"), F.lit("1/2026/QD-X").alias("document_number")) for k, t in enumerate(text)])
    spark.range(1).select(F.lit("s").alias("source_id"), one.alias("chunks")).coalesce(1).write.json(f"{folder}/data")
    engine = Engine(spark, folder, store=Store(spark, f"{folder}/store"))
    first = engine.start(folder)
    engine.start(folder)
    again = engine.store.read("documents").count()
    return spark.createDataFrame([(first["documents"], again, first["indexed"], engine.store.read("doc_relations").count())], "documents long, again long, indexed long, relations long")


@query("SELECT doc_id AS n, CASE WHEN answer IS NULL THEN 'data: {\"type\":\"progress\",\"node\":\"retrieve\"}' ELSE 'data: {\"type\":\"answer\",\"node\":\"guard\",\"content\":\"' || answer || '\"}' END || chr(10) || chr(10) AS data FROM (" + TX.ROUTE + ") UNION ALL SELECT max(doc_id) + 1, 'data: [DONE]' || chr(10) || chr(10) FROM documents")
def str_sse(spark, d):
    """Event lines of a stream of questions: the canned answer, or that the retrieval has begun."""
    folder = scratch(spark, "sse")
    asked = docs(spark, d).select("doc_id", F.col("title").alias("question"))
    asked.write.parquet(f"{folder}/in")

    def step(batch, n):
        routed = guard.route(batch)
        known = F.col("answer").isNotNull()
        events = routed.select(F.col("doc_id").alias("n"), F.when(known, "answer").otherwise("progress").alias("type"), F.when(known, "guard").otherwise("retrieve").alias("node"), F.col("answer").alias("content"))
        incremental.sse(events).write.parquet(f"{folder}/out/{n}")

    incremental.new_rows(spark, asked.schema, f"{folder}/in", step, f"{folder}/seen")
    return spark.read.parquet(f"{folder}/out/*")


# ---- uploads
def _docx(text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        paragraphs = "".join(f"<w:p><w:r><w:t>{s}</w:t></w:r></w:p>" for s in text.split("\n"))
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{paragraphs}</w:body></w:document>')
    return out.getvalue()


_LETTER = "CỘNG HÒA XÃ HỘI\nSố: 7/2026/TT-X\nTHÔNG TƯ\nVề việc nạo vét kênh chính\nĐiều 1. Phạm vi áp dụng\nĐiều 2. Căn cứ Nghị định số 16/2012/NĐ-CP"


@query(
    "SELECT file_name, state, steps, message FROM (VALUES ('a.docx', 'done', 'pending,validating,parsing,ingesting,indexing,extracting,compiling,done', NULL), ('b.docx', 'duplicate', 'pending,validating,duplicate', 'File trùng với'), ('c.txt', 'failed', 'pending,validating,failed', 'Định dạng không hỗ trợ: .txt. Chỉ chấp nhận .pdf và .docx'), "
    "('d.pdf', 'failed', 'pending,validating,failed', 'File rỗng.'), ('e.pdf', 'failed', 'pending,validating,failed', 'OCR thất bại'), ('f.docx', 'failed', 'pending,validating,failed', 'Không đọc được file'), ('g.pdf', 'done', 'pending,validating,ocr_running,parsing,ingesting,indexing,extracting,compiling,done', NULL)) t(file_name, state, steps, message)"
)
def q_upload(spark, _d):
    """The states of uploaded files of each kind, and with them all that an upload does to the tables."""
    from vanthu.api import Engine

    folder = scratch(spark, "upload")
    fs = Store(spark, folder).fs
    kept = {"a.docx": _docx(_LETTER), "b.docx": _docx(_LETTER), "c.txt": b"x", "d.pdf": b"", "e.pdf": b"%PDF?", "f.docx": b"no zip", "g.pdf": b"%PDF ok"}
    for name, data in kept.items():
        out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/up/{name}"), True)
        out.write(bytearray(data))
        out.close()
    engine = Engine(spark, folder, store=Store(spark, f"{folder}/store"), ocr=lambda data, _p: "Số: 8/2026/TT-X\nĐiều 1. Nội dung quét được" if data.endswith(b"ok") else None)
    ended = engine.upload(f"{folder}/up/*")
    steps = engine.store.read("ingest_status").groupBy("file_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "state"))), lambda x: x["state"]), ",").alias("steps"))
    return ended.join(steps, "file_name").select("file_name", "state", "steps", F.regexp_replace("error_message", r"(trùng với).*", "$1").alias("message"))


@query("WITH " + TX.PIECES + " SELECT id AS doc_id, 'upload' AS source, i AS index, md5(text) AS h FROM pc")
def snk_chunks_json(spark, d):
    """The pieces of every document's text written as JSON, one folder each, and read again."""
    out = scratch(spark, "chunks")
    pieces = ingest.parse_and_chunk(docs(spark, d).select(F.col("doc_id").cast("string").alias("file_hash"), "text"), "file_hash", "text").withColumnRenamed("id", "file_hash")
    rows = pieces.withColumn("doc_number", (F.expr("cast(file_hash as long)") % 16).cast("string"))
    files.write_chunks(rows, docs(spark, d).select(F.col("doc_id").cast("string").alias("file_hash"), F.col("source").alias("file_name")), out)
    back = spark.read.schema("file_hash string, source string, chunks array<struct<index:int,text:string>>, safe string").json(out)
    return back.select("file_hash", "source", F.explode("chunks").alias("c")).select(F.col("file_hash").cast("long").alias("doc_id"), "source", "c.index", F.md5("c.text").alias("h"))


@query("SELECT '- [' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || '] Compiled wiki for ' || coalesce(doc_number, '') AS line FROM documents WHERE created_at IS NOT NULL")
def snk_log(spark, d):
    """Two runs that each add lines to the log, read again."""
    folder = scratch(spark, "log")
    lines = docs(spark, d).where("created_at is not null").select("doc_id", F.col("created_at").alias("at"), F.concat(F.lit("Compiled wiki for "), F.coalesce("doc_number", F.lit(""))).alias("message"))
    for k in (0, 1):
        files.append_log(spark, folder, lines.where((F.col("doc_id") % 2) == k))
    return spark.read.text(f"{folder}/log").select(F.col("value").alias("line"))


@query("SELECT base, folder FROM (VALUES ('one', 'chunks'), ('two', 'data')) t(base, folder)")
def src_select_dir(spark, _d):
    folder = scratch(spark, "bases")
    spark.range(1).write.parquet(f"{folder}/one/chunks")
    spark.range(1).write.parquet(f"{folder}/one/data")
    spark.range(1).write.parquet(f"{folder}/two/data")
    return spark.createDataFrame([(b, files.select_folder(spark, f"{folder}/{b}").rsplit("/", 1)[1]) for b in ("one", "two")], "base string, folder string")


@query("SELECT ext, n FROM (VALUES ('md', 20), ('docx', 2), ('pdf', 4)) t(ext, n)")
def snk_draft(spark, _d):
    """A draft kept as md, docx and, by a converter's stand-in, pdf, and read by its id: length of the text, lines of the docx, bytes of the pdf."""
    from vanthu.api import Engine

    engine = Engine(spark, scratch(spark, "drafts"), pdf=lambda data: b"%PDF" if zipfile.ZipFile(io.BytesIO(data)).testzip() is None else None)
    got = engine.save_draft("hỏi", "đáp", "to_trinh_mau", "# Tờ trình\n{{ dia_danh }} {{ngay}}", datetime.date(2026, 4, 15))
    read = {ext: engine.download(got["draft_id"], ext) for ext in ("md", "docx", "pdf")}
    return spark.createDataFrame([("md", len(read["md"].decode())), ("docx", files.docx_text(read["docx"]).count("\n") + 1), ("pdf", len(read["pdf"]))], "ext string, n int")


@query("SELECT found, refused FROM (VALUES (false, true)) t(found, refused)")
def src_download(spark, _d):
    """A draft that is not there, and one of a kind that is not kept."""
    folder = scratch(spark, "drafts")
    files.write_draft(spark, folder, "draft_1", "x", b"y")
    try:
        files.read_draft(spark, folder, "../draft_1", "md")
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(files.read_draft(spark, folder, "draft_2", "md") is not None, refused)], "found boolean, refused boolean")


# ---- the store
@query("SELECT (SELECT count(*) FROM documents)::BIGINT AS documents, (SELECT count(DISTINCT id) FROM chunks)::BIGINT AS chunks, 1::BIGINT AS commits, true AS failed")
def dml_txn(spark, d):
    """A commit of two tables, then one of which the second table cannot be written: nothing of it remains."""
    store = Store(spark, scratch(spark, "txn"))
    chunks = table(spark, d, "chunks").dropDuplicates(["id"])
    store.commit(append={"documents": docs(spark, d), "chunks": chunks})
    try:
        store.commit(append={"documents": docs(spark, d), "chunks": None})
        failed = False
    except Exception:  # noqa: BLE001
        failed = True
    left = store.read("documents").agg(F.count(F.lit(1)).alias("documents")).withColumn("k", F.lit(1)).join(store.read("chunks").agg(F.count(F.lit(1)).alias("chunks")).withColumn("k", F.lit(1)), "k").drop("k")
    return left.withColumns({"commits": F.lit(store.version()).cast("long"), "failed": F.lit(failed)})


@query("SELECT doc_id, doc_number, NULL::VARCHAR AS summary FROM documents")
def ddl_migrate(spark, d):
    """Rows written before a column was added have null in it; columns that the schema does not name are left out."""
    store = Store(spark, scratch(spark, "ddl"))
    store.commit(append={"documents": docs(spark, d).select("doc_id", "doc_number", F.col("lang"))})
    return store.read("documents").select("doc_id", "doc_number", "summary")


@query("SELECT DISTINCT id, document_id, md5(text) AS h FROM chunks")
def dml_insert(spark, d):
    """Chunks appended in two commits and read again."""
    store = Store(spark, scratch(spark, "insert"))
    c = table(spark, d, "chunks").dropDuplicates(["id"])
    for k in (0, 1):
        store.commit(append={"chunks": c.where((F.col("id") % 2) == k)})
    return store.read("chunks").select("id", "document_id", F.md5("text").alias("h"))


@query(f"WITH {X.LINT} SELECT slug, lint_status FROM ls")
def dml_update_lint(spark, d):
    """The compiled pages stored, linted, and their status kept with them."""
    from vanthu.api import Engine

    store = Store(spark, scratch(spark, "lint"))
    store.commit(append={"documents": docs(spark, d), "wiki_pages": P._pages(spark, d)})
    Engine(spark, "", store=store).lint_stored()
    return store.read("wiki_pages").select("slug", "lint_status")


# ---- sessions
@query("WITH " + P._MSG + " SELECT session_id, 'sum ' || count(*) FILTER (WHERE role <> 'system') AS summary FROM m GROUP BY 1 HAVING count(*) FILTER (WHERE role <> 'system') >= 4 AND length(string_agg(content, '')) >= 1")
def q_chat_summarise(spark, d):
    """Sessions with four or more messages get the summary that the model, here the count of lines, writes."""
    m = P._messages(spark, d).withColumn("content", F.rpad("content", 60, "."))
    s = m.where("role <> 'system'").groupBy("session_id").agg(F.min("timestamp").alias("created_at")).withColumns({"summary": F.lit(None).cast("string"), "summarised": F.lit(None).cast("long"), "updated_at": F.col("created_at")})
    told = chat.summarise(s, m.where("role <> 'system'"), lambda _i, text: f"sum {text.count(chr(10))}")
    return told.where("summary is not null").select("session_id", "summary")


@query("WITH " + P._MSG + ", s AS (SELECT session_id, count(*) FILTER (WHERE role <> 'system') AS n FROM m GROUP BY 1) SELECT session_id, CASE WHEN session_id % 2 = 0 THEN greatest(0, n - 2) ELSE 0 END AS last, n >= 4 AND (session_id % 2 <> 0) AS due FROM s")
def q_chat_due(spark, d):
    """Which sessions are due after a restart; every second has a summary from before."""
    m = P._messages(spark, d)
    s = m.select("session_id").distinct().withColumns({"summary": F.when(F.col("session_id") % 2 == 0, "cũ"), "summarised": F.lit(None).cast("long")})
    return chat.due_now(s, m).select("session_id", "last", "due")


@query("SELECT step, n FROM (VALUES ('created', 2), ('kept', 2), ('messages', 2), ('oldest', 1), ('listed', 1), ('left', 1), ('left_messages', 0)) t(step, n)")
def q_chat_sessions(spark, _d):
    """Create (an id twice), save (an unknown role is left out), list by user, read, and delete with all messages."""
    from vanthu.api import Engine

    e = Engine(spark, "", store=Store(spark, scratch(spark, "chat")))
    a, b = e.create_session("u1"), e.create_session("u2", "sess_2")
    e.create_session("u3", "sess_2")
    rows = [("created", len({a, b})), ("kept", e.save_messages(a, [("user", "hỏi"), ("robot", "x"), ("assistant", "đáp")]))]
    rows += [("messages", e.messages(a).count()), ("oldest", e.messages(a, 1).where("content = 'hỏi'").count()), ("listed", e.sessions("u2").count())]
    e.delete_session(a)
    rows += [("left", e.store.read("chat_sessions").count()), ("left_messages", e.store.read("chat_messages").count())]
    return spark.createDataFrame(rows, "step string, n int")


# ---- model hooks
_LONG = "content_markdown is not null"


@query("SELECT doc_id, CASE WHEN length(content_markdown) % 2 = 0 THEN ['thuế'] ELSE [] END AS fields, CASE WHEN length(content_markdown) % 2 = 0 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS confidence, length(content_markdown) % 2 = 0 AS auto_applied FROM (SELECT doc_id, substring(content_markdown, 1, 3000) AS content_markdown FROM documents WHERE content_markdown IS NOT NULL AND length(trim(regexp_replace(content_markdown, '" + X.WS + "+', ' ', 'g'))) >= 50)")
def fn_auto_tag(spark, d):
    """Labels by a stand-in for a model that answers for every second text, with thoughts around its answer, and fails for the others."""

    def model(_i: str, text: str) -> str:
        if len(text) % 2:
            raise RuntimeError("no answer")
        return '<thought>x</thought>{"fields": ["thuế"], "confidence": 0.9}'

    rows = docs(spark, d).where(_LONG).where(F.length(F.trim(F.regexp_replace("content_markdown", r"(?U)\s+", " "))) >= 50)
    return models.auto_tag(rows, "doc_id", "content_markdown", model)


@query("SELECT doc_id, '' AS summary FROM documents WHERE content_markdown IS NOT NULL")
def fn_auto_summarize(spark, d):
    """Without a model a summary is empty."""
    return models.auto_summarise(docs(spark, d).where(_LONG), "doc_id", "content_markdown", None)


@query("SELECT doc_id, title AS text FROM documents WHERE title IS NOT NULL")
def fn_text_normalizer(spark, d):
    """Without a model a text stays as it is."""
    return models.normalise(docs(spark, d).where("title is not null"), "doc_id", "title", None)


@query("SELECT keys, available FROM (VALUES ('none', false), ('ollama', false), ('gemini', true)) t(keys, available)")
def fn_ai_available(spark, _d):
    return spark.createDataFrame([(k, models.available({k: "x"} if k != "none" else {"gemini": None})) for k in ("none", "ollama", "gemini")], "keys string, available boolean")


@query("SELECT document_id, summary, key_points, legal_fields, qa, confidence FROM (VALUES (1, 'tóm', ['một', 'hai'], ['thuế'], 'h|đ', 0.9::DOUBLE), (2, NULL, NULL, [], NULL, 0.0)) t(document_id, summary, key_points, legal_fields, qa, confidence)")
def fn_wiki_model(spark, _d):
    """The parts of a page by a stand-in for a model, and those of a text too short to be asked about."""
    answers = {"Tóm tắt văn bản": "tóm", "Trích xuất điểm chính": "- một\n\n-  hai", "Sinh cặp hỏi đáp": 'x [{"question": "h", "answer": "đ"}]'}
    rows = spark.createDataFrame([(1, "nội dung " * 10), (2, "ngắn")], "doc_id long, content_markdown string")
    got = models.wiki_parts(rows, lambda i, _t: answers.get(i, '{"fields": ["thuế"], "confidence": 0.9}'))
    return got.select("document_id", "summary", "key_points", "legal_fields", F.array_join(F.transform("suggested_qa", lambda q: F.concat(q["question"], F.lit("|"), q["answer"])), ";").alias("qa"), "confidence")


_CASES = [("id_card", "012345678901", True), ("id_card", "123456789", True), ("id_card", "1234", False), ("phone", "0912345678", True), ("phone", "0112345678", False), ("tax_number", "0123456789-001", True), ("tax_number", "01234", False), ("email", "a.b@c.vn", True), ("email", "a b@c", False), ("date", "29/02/2024", True), ("date", "29/02/2023", False), ("date", "1/2/2024", False)]


@query("SELECT kind, value, ok FROM (VALUES " + ", ".join(f"('{k}', '{v}', {str(ok).lower()})" for k, v, ok in _CASES) + ") t(kind, value, ok)")
def fn_validation_rules(spark, _d):
    rows = spark.createDataFrame([(k, v) for k, v, _ in _CASES], "kind string, value string")
    ok = F.lit(None).cast("boolean")
    for kind in formats.PATTERNS:
        ok = F.when(F.col("kind") == kind, formats.valid(kind, F.col("value"))).otherwise(ok)
    return rows.select("kind", "value", ok.alias("ok"))
