"""The way of an uploaded file: validation, text, parsing, and the states it passes."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from vanthu.functions import text as T
from vanthu.operators import ingest
from vanthu.runtime import cut
from vanthu.sources import files

#: The states of a file in order; the last three end its way.
STATES = ["pending", "validating", "ocr_running", "parsing", "ingesting", "indexing", "extracting", "compiling", "done", "failed", "duplicate"]


def validate(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """(path, file_name, file_type, file_hash, document_id, state, error_message) of (path, content).

    Neither PDF nor DOCX, or empty: failed. Bytes of a document that is there, or of a file before it in the order of
    paths: duplicate. Otherwise validating.
    """
    name = F.regexp_extract("path", r"[^/]+$", 0)
    ext = F.lower(F.regexp_extract(name, r"\.[^.]*$", 0))
    seen = uploads.select("path", name.alias("file_name"), F.substring(ext, 2, 8).alias("file_type"), F.length("content").alias("size"), F.sha2("content", 256).alias("file_hash"))
    known = documents.where("file_hash is not null").groupBy("file_hash").agg(F.min_by(F.struct(F.col("doc_id").alias("document_id"), "doc_number"), "doc_id").alias("d"))
    first = seen.where(F.col("file_type").isin("pdf", "docx")).groupBy("file_hash").agg(F.min("path").alias("first"))
    rows = seen.join(known, "file_hash", "left").join(first, "file_hash", "left")
    wrong = ~F.col("file_type").isin("pdf", "docx")
    state = F.when(wrong | (F.col("size") == 0), "failed").when(F.col("d").isNotNull() | (F.col("path") > F.col("first")), "duplicate").otherwise("validating")
    message = F.when(wrong, F.concat(F.lit("Định dạng không hỗ trợ: "), ext, F.lit(". Chỉ chấp nhận .pdf và .docx"))).when(F.col("size") == 0, "File rỗng.")
    message = message.when(F.col("d").isNotNull(), F.concat(F.lit("File đã tồn tại trong hệ thống. Document ID: "), F.col("d.document_id").cast("string"), F.lit(", Số hiệu: "), F.coalesce("d.doc_number", F.lit(""))))
    message = message.when(F.col("path") > F.col("first"), F.concat(F.lit("File trùng với "), F.col("first")))
    return rows.select("path", "file_name", "file_type", "file_hash", F.col("d.document_id").alias("document_id"), state.alias("state"), message.alias("error_message"))


class Parsed(NamedTuple):
    """What a batch of uploads gives: the last state of each file, and the rows of documents and their pieces by document number."""

    states: DataFrame
    documents: DataFrame
    chunks: DataFrame


def parse(uploads: DataFrame, documents: DataFrame, ocr: Callable[[bytes, str], str | None] | None = None) -> Parsed:
    """Validates, reads and cuts files. A file without text or pieces fails; of files with one number the first makes the document."""
    checked = cut(validate(uploads, documents))
    good = checked.where("state = 'validating'").select("path", "file_hash", "file_name", "file_type")
    bytes_ = uploads.join(good.select("path", "file_hash"), "path").select("file_hash", "path", "content")
    texts = cut(files.extract_text(bytes_, ocr).select("file_hash", "path", "text"))
    number = F.coalesce(ingest.number_in_head(F.col("text")), F.concat(F.lit("UPLOAD_"), F.substring("file_hash", 1, 12)))
    pieces = cut(ingest.parse_and_chunk(texts, "file_hash", "text").withColumnRenamed("id", "file_hash").join(texts.select("file_hash", number.alias("doc_number")), "file_hash"))
    first = pieces.groupBy("file_hash", "doc_number").agg(F.count(F.lit(1)).alias("n_chunks"), F.min_by("text", "index").alias("head"))
    title = ingest.build_title(F.col("doc_number"), ingest.clean_title(F.col("head")))
    made = first.groupBy("doc_number").agg(F.min_by(F.struct("file_hash", "n_chunks", "head"), "file_hash").alias("f")).select("doc_number", "f.*")
    body = pieces.withColumn("line", ingest.markdown_line(F.col("index"), F.col("text"), F.col("dieu"), F.col("khoan"))).groupBy("file_hash").agg(F.array_sort(F.collect_list(F.struct("index", "line"))).alias("ls"))
    content = F.concat(F.lit("# Van ban so "), F.col("doc_number"), F.lit("\n\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    docs = made.join(body, "file_hash").select("doc_number", title.alias("title"), T.parse_doc_type(F.col("doc_number")).alias("doc_type"), content.alias("content_markdown"), "file_hash", F.lit("con_hieu_luc").alias("effectiveness_status"), "n_chunks")
    cuts = first.select("file_hash", "doc_number", "n_chunks")
    later = checked.join(texts.select("path", F.col("text").isNotNull().alias("read")), "path", "left").join(cuts, "file_hash", "left")
    going = F.col("state") == "validating"
    state = F.when(~going, F.col("state")).when(F.col("read") & F.col("n_chunks").isNotNull(), "ingesting").otherwise("failed")
    why = F.when(~going, F.col("error_message")).when(~F.coalesce("read", F.lit(False)), F.when(F.col("file_type") == "pdf", "OCR thất bại").otherwise("Không đọc được file")).when(F.col("n_chunks").isNull(), "Không có chunks để nạp vào database.")
    states = later.select("path", "file_name", "file_type", "file_hash", "document_id", "doc_number", state.alias("state"), why.alias("error_message"))
    return Parsed(states, docs, pieces)


def way(states: DataFrame) -> DataFrame:
    """(file_hash, file_name, step, state, error_message): all states each file of (…, file_type, state) passed, from pending to its last."""
    full = {"pdf": ["pending", "validating", "ocr_running", "parsing", "ingesting", "indexing", "extracting", "compiling", "done"]}
    full["docx"] = [s for s in full["pdf"] if s != "ocr_running"]
    arrays = {k: F.array(*[F.lit(s) for s in v]) for k, v in full.items()}
    start = F.array(F.lit("pending"), F.lit("validating"))
    reached = F.when(F.col("file_type") == "pdf", arrays["pdf"]).otherwise(arrays["docx"])
    upto = F.slice(reached, 1, F.greatest(F.lit(1), F.array_position(reached, F.col("state")).cast("int")))
    parts = F.when(F.col("state") == "duplicate", F.concat(start, F.array(F.lit("duplicate")))).when(F.col("state") == "failed", F.concat(start, F.array(F.lit("failed")))).otherwise(upto)
    steps = states.withColumn("parts", parts).select("*", F.posexplode("parts").alias("step", "at"))
    last = F.col("step") == F.size("parts") - 1
    return steps.select("file_hash", "file_name", "step", F.col("at").alias("state"), F.when(last, F.col("error_message")).alias("error_message"), F.when(last, F.col("document_id")).alias("document_id"))


def latest(events: DataFrame) -> DataFrame:
    """The last state of every file from (file_hash, step, state)."""
    return events.groupBy("file_hash").agg(F.max_by("state", "step").alias("state"))
