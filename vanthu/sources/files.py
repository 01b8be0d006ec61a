"""File sources and sinks: corpus JSON, uploads (bytes, docx), OCR and encoder hooks, markdown and JSON outputs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from vanthu.operators.ingest import CORPUS_SCHEMA


def read_corpus(spark: SparkSession, folder: str, names: str = "*.json") -> DataFrame:
    """All *.json files of a folder, not of those below it, one object or a list of objects each; malformed files are dropped."""
    return spark.read.schema(CORPUS_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{folder}/{names}").select("*", "_metadata")


def read_uploads(spark: SparkSession, glob: str) -> DataFrame:
    """(path, content, file_hash) of PDF and DOCX files."""
    files = spark.read.format("binaryFile").load(glob)
    return files.where(F.lower("path").rlike(r"\.(pdf|docx)$")).select("path", "content", F.sha2("content", 256).alias("file_hash"))


def new_uploads(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """Uploads whose bytes are not known yet, the first path of each."""
    return uploads.groupBy("file_hash").agg(F.min_by(F.struct("path", "content"), "path").alias("u")).select("file_hash", "u.path", "u.content").join(known.select("file_hash").distinct(), "file_hash", "left_anti")


def docx_text(content: bytes) -> str | None:
    """The non-blank paragraphs of a DOCX file, one a line; null if it is none."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    lines = ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))
    return "\n".join(s for s in lines if s.strip())


def extract_text(uploads: DataFrame, ocr: Callable[[bytes, str], str | None] | None = None) -> DataFrame:
    """(file_hash, path, text, status): DOCX by its XML, others by the OCR hook; without one they fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, states = [], []
            for path, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = docx_text(content) if path.lower().endswith(".docx") else ocr(content, path) if ocr else None
                texts.append(text)
                states.append("parsing" if text else "failed")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(states)], names=["file_hash", "path", "text", "status"])

    return uploads.select("file_hash", "path", "content").mapInArrow(run, "file_hash string, path string, text string, status string")


def encode(rows: DataFrame, id_col: str, text_col: str, encoder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(id, embedding) by a pluggable sentence encoder, called with a batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = encoder([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=[id_col, "embedding"])

    return rows.select(id_col, text_col).mapInArrow(run, f"{id_col} long, embedding array<float>")


def write_docx(blocks: list[dict]) -> bytes:
    """A minimal DOCX file of the rows of ``docgen.blocks``."""
    from xml.sax.saxutils import escape

    body = "".join(f'<w:p><w:pPr><w:jc w:val="{b["align"]}"/></w:pPr><w:r><w:rPr>{"<w:b/>" if b["style"].startswith("heading") else ""}<w:sz w:val="{2 * b["size"]}"/></w:rPr><w:t xml:space="preserve">{escape(b["text"])}</w:t></w:r></w:p>' for b in blocks)
    parts = {
        "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def select_folder(spark: SparkSession, base: str) -> str:
    """``base``/chunks where it exists, else ``base``/data."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/chunks")
    return f"{base}/chunks" if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) else f"{base}/data"


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_chunks(chunks: DataFrame, names: DataFrame, folder: str) -> None:
    """The pieces of parsed uploads as JSON, one folder for each document number; a document written again replaces its own only.

    chunks: (file_hash, doc_number, index, text, dieu, khoan, token_count); names: (file_hash, file_name).
    """
    one = F.struct("index", "text", "dieu", "khoan", "token_count")
    safe = F.regexp_replace(F.translate("doc_number", "/-", "__"), r"[^\w.]", "_")
    rows = chunks.groupBy("file_hash", "doc_number").agg(F.array_sort(F.collect_list(one)).alias("chunks")).join(names.select("file_hash", "file_name").dropDuplicates(["file_hash"]), "file_hash")
    rows.select(safe.alias("safe"), F.lit("upload").alias("source"), "file_name", "file_hash", "chunks").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("safe").json(folder)


def write_pages(pages: DataFrame, folder: str) -> None:
    """A snapshot of the wiki: all pages, each with its text, as JSON in a new folder. Any number of pages makes as many files as there are tasks."""
    pages.write.json(f"{folder}/json")


def write_page_files(pages: DataFrame, folder: str) -> None:
    """The texts of pages, each in a folder named by its slug. Pages written before stay, but for those written again. For vaults that a person opens; a large wiki is kept by ``write_pages``."""
    texts = pages.select("slug", F.col("markdown").alias("value"))
    texts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug").text(f"{folder}/tom-tat")


def append_log(spark: SparkSession, folder: str, messages: DataFrame) -> None:
    """Adds lines "- [time] message" of (at, message) to the log, which is never rewritten."""
    line = F.concat(F.lit("- ["), F.date_format("at", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), F.col("message"))
    messages.select(line.alias("value")).write.mode("append").text(f"{folder}/log")


def write_draft(spark: SparkSession, folder: str, draft_id: str, markdown: str, docx: bytes, pdf: Callable[[bytes], bytes | None] | None = None) -> dict[str, str | None]:
    """A draft as md and docx, and as pdf where a converter is given and can do it; the paths by extension."""
    kept = {"md": markdown.encode(), "docx": docx, "pdf": pdf(docx) if pdf else None}
    out: dict[str, str | None] = {}
    for ext, data in kept.items():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{draft_id}.{ext}")
        out[ext] = None
        if data is not None:
            stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
            stream.write(bytearray(data))
            stream.close()
            out[ext] = path.toString()
    return out


def read_draft(spark: SparkSession, folder: str, draft_id: str, ext: str) -> bytes | None:
    """The bytes of a draft, or none where there is no such file. Other kinds than pdf, docx and md, and ids with other characters than letters, digits, _ and -, are refused."""
    if ext not in ("pdf", "docx", "md") or not draft_id.replace("_", "").replace("-", "").isalnum():
        raise ValueError(f"no draft is kept as {draft_id}.{ext}")
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"{draft_id}.{ext}").load(folder).select("content").take(1)
    return bytes(rows[0][0]) if rows else None
