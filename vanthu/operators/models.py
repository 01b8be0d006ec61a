"""What a language model may add, as hooks over whole tables, each with what holds without one.

A model is a function of an instruction and a text that returns a text. It is called in Arrow batches by the executors; an
error, or an answer that cannot be read, counts as no answer.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vanthu.functions import text as T

Model = Callable[[str, str], str]
# Limits of what a model is given, and the confidence from which its labels are applied.
TAG_CHARS, TAG_THRESHOLD, LEAST_CHARS = 3000, 0.85, 50
SUMMARY_CHARS = {1: 6000, 2: 12000}
# The legal fields a text can be labelled with.
LEGAL_FIELDS = ["đất đai", "thuế", "lao động", "dân sự", "hình sự", "hành chính", "thương mại", "môi trường", "xây dựng", "giao thông", "giáo dục", "y tế", "tài chính", "ngân hàng", "bảo hiểm", "sở hữu trí tuệ", "đầu tư", "doanh nghiệp", "hôn nhân gia đình", "quốc phòng an ninh"]


def available(keys: dict[str, str | None]) -> bool:
    """Whether a model can be asked: some provider's key is set; a local server alone does not count."""
    return any(v for k, v in keys.items() if k != "ollama")


def ask(rows: DataFrame, id_col: str, text: str, instruction: str, model: Model | None) -> DataFrame:
    """(id, answer): the model's answer to each text of at least fifty characters, null where there is none."""
    kind = dict(rows.dtypes)[id_col]
    worth = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")) >= LEAST_CHARS
    asked = rows.select(id_col, F.when(worth, F.col(text)).alias("t"))
    if model is None:
        return asked.select(id_col, F.lit(None).cast("string").alias("answer"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = []
            for t in batch.column(1).to_pylist():
                try:
                    answers.append(model(instruction, t) if t is not None else None)
                except Exception:  # noqa: BLE001 - a model that fails gives no answer
                    answers.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string())], names=[id_col, "answer"])

    return asked.mapInArrow(run, f"{id_col} {kind}, answer string")


def auto_tag(rows: DataFrame, id_col: str, text: str, model: Model | None, threshold: float = TAG_THRESHOLD) -> DataFrame:
    """(id, fields, confidence, auto_applied) from an answer {"fields": [...], "confidence": x}; none without an answer."""
    short = rows.select(id_col, F.substring(text, 1, TAG_CHARS).alias("t"))
    told = ask(short, id_col, "t", "Gán nhãn lĩnh vực: " + ", ".join(LEGAL_FIELDS), model)
    got = F.from_json(T.salvage_json(F.col("answer")), "fields array<string>, confidence double")
    rows = told.select(id_col, F.coalesce(got["fields"], F.array().cast("array<string>")).alias("fields"), F.coalesce(got["confidence"], F.lit(0.0)).alias("confidence"))
    return rows.withColumn("auto_applied", (F.size("fields") > 0) & (F.col("confidence") >= threshold))


def auto_summarise(rows: DataFrame, id_col: str, text: str, model: Model | None, level: int = 1) -> DataFrame:
    """(id, summary): short (level 1) or by structure (level 2); empty without an answer."""
    short = rows.select(id_col, F.substring(text, 1, SUMMARY_CHARS[level]).alias("t"))
    return ask(short, id_col, "t", f"Tóm tắt, mức {level}", model).select(id_col, F.coalesce("answer", F.lit("")).alias("summary"))


def normalise(rows: DataFrame, id_col: str, text: str, model: Model | None) -> DataFrame:
    """(id, text) as the model writes it properly; as it is without an answer."""
    told = ask(rows, id_col, text, "Chuẩn hóa văn bản", model)
    return rows.select(id_col, F.col(text).alias("t")).join(told, id_col).select(id_col, F.coalesce(F.nullif("answer", F.lit("")), "t").alias("text"))


def wiki_parts(docs: DataFrame, model: Model | None) -> DataFrame:
    """(document_id, summary, key_points, suggested_qa, legal_fields, confidence) of (doc_id, content_markdown), null or empty where the model said nothing."""
    text = docs.select("doc_id", F.substring("content_markdown", 1, 6000).alias("t"))
    s = ask(text, "doc_id", "t", "Tóm tắt văn bản", model).select("doc_id", F.col("answer").alias("summary"))
    lines = F.filter(F.transform(F.split("answer", "\n"), lambda x: F.regexp_replace(x, r"^[\-\s]+|\s+$", "")), lambda x: x != "")
    k = ask(text, "doc_id", "t", "Trích xuất điểm chính", model).select("doc_id", F.slice(lines, 1, 5).alias("key_points"))
    array = F.from_json(F.regexp_extract("answer", r"(?s)\[.*\]", 0), "array<struct<question:string,answer:string>>")
    q = ask(text, "doc_id", "t", "Sinh cặp hỏi đáp", model).select("doc_id", array.alias("suggested_qa"))
    tags = auto_tag(text, "doc_id", "t", model).select("doc_id", F.col("fields").alias("legal_fields"), "confidence")
    return s.join(k, "doc_id").join(q, "doc_id").join(tags, "doc_id").withColumnRenamed("doc_id", "document_id")


def relations_told(docs: DataFrame, model: Model | None) -> DataFrame:
    """(source_doc_id, relation_type, target_doc_number) from an answer [{"type": …, "target": …}]; no rows without one."""
    told = ask(docs.select("doc_id", "content_markdown"), "doc_id", "content_markdown", "Trích xuất quan hệ", model)
    rows = told.select(F.col("doc_id").alias("source_doc_id"), F.explode(F.from_json(F.regexp_extract("answer", r"(?s)\[.*\]", 0), "array<struct<type:string,target:string>>")).alias("r"))
    return rows.select("source_doc_id", F.col("r.type").alias("relation_type"), F.col("r.target").alias("target_doc_number")).where("target_doc_number is not null").distinct()


def form_values(question: str, answer: str, variables: list[str], model: Model | None) -> dict[str, str]:
    """Values of a form's variables told by the model; those it leaves out are named, as none are without one."""
    if model is None:
        return {}
    try:
        text = model("Điền biểu mẫu: " + ", ".join(variables), f"{question}\n\n{answer}")
        told = json.loads(text[text.index("{") : text.rindex("}") + 1])
    except Exception:  # noqa: BLE001
        return {}
    return {v: str(told[v]) if told.get(v) else f"[{v.replace('_', ' ').title()}]" for v in variables}
