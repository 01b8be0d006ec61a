"""Relations between documents: extraction from text, resolution, storing without repeats, look-up in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vanthu.functions import text as T

# The phrases that state a relation, in the order in which they are tried.
PHRASES = [
    ("thay_the", r"thay\s+thế\s+(Luật|Nghị\s+định|Thông\s+tư|Quyết\s+định|Pháp\s+lệnh)\s+(số\s+)?([^\s,;\.]+)"),
    ("thay_the", r"(Luật|Nghị\s+định|Thông\s+tư|Quyết\s+định)\s+(số\s+)?([^\s,;\.]+)\s+hết\s+hiệu\s+lực"),
    ("sua_doi", r"sửa\s+đổi[,\s]?\s*bổ\s+sung\s+(một\s+số\s+điều\s+)?(của\s+)?(Luật|Nghị\s+định|Thông\s+tư|Quyết\s+định)\s+(số\s+)?([^\s,;\.]+)"),
    ("sua_doi", r"sửa\s+đổi\s+(Điều\s+\d+[,\s]*)+\s*(của\s+)?(Luật|Nghị\s+định|Thông\s+tư|Quyết\s+định)\s+(số\s+)?([^\s,;\.]+)"),
    ("huong_dan", r"hướng\s+dẫn\s+(thi\s+hành\s+)?(một\s+số\s+điều\s+)?(của\s+)?(Luật|Nghị\s+định|Thông\s+tư|Quyết\s+định)\s+(số\s+)?([^\s,;\.]+)"),
    ("huong_dan", r"quy\s+định\s+chi\s+tiết\s+(thi\s+hành\s+)?(một\s+số\s+điều\s+)?(của\s+)?(Luật|Nghị\s+định|Thông\s+tư)\s+(số\s+)?([^\s,;\.]+)"),
    ("bai_bo", r"bãi\s+bỏ\s+(Điều\s+\d+[,\s]*)+\s*(của\s+)?(Luật|Nghị\s+định|Thông\s+tư|Quyết\s+định)\s+(số\s+)?([^\s,;\.]+)"),
    ("bai_bo", r"bãi\s+bỏ\s+(Luật|Nghị\s+định|Thông\s+tư|Quyết\s+định)\s+(số\s+)?([^\s,;\.]+)"),
    ("vien_dan", r"căn\s+cứ\s+(Luật|Nghị\s+định|Thông\s+tư|Quyết\s+định|Bộ\s+luật|Pháp\s+lệnh)\s+(số\s+)?([^\s,;]+)"),
    ("vien_dan", r"theo\s+quy\s+định\s+tại\s+(Điều\s+\d+)?\s*(Luật|Nghị\s+định|Thông\s+tư|Quyết\s+định)\s+(số\s+)?([^\s,;\.]+)"),
]
SECTION_REACH = 500
_HITS = "array<struct<k:int,kind:string,i:int,m:string,before:string>>"


def extract(docs: DataFrame, id_col: str = "doc_id", number_col: str = "doc_number", text_col: str = "content_markdown") -> DataFrame:
    """(source_doc_id, target_doc_number, relation_type, source_section): relations stated in the texts.

    Of the same type and target the first in phrase order counts; a document's own number is no target. A match's section is
    told by the last ``SECTION_REACH`` characters before it, so the work grows with the text, not with its matches. All in the JVM.
    """
    base = docs.select(F.col(id_col).alias("source_doc_id"), F.col(number_col).alias("own"), F.col(text_col).alias("t")).where("t is not null")
    # one pass: the matches of all phrases as (order, type, match number, matched text, text before it)
    found = []
    for k, (kind, pattern) in enumerate(PHRASES):
        java = "(?iuU)" + pattern
        matches = F.regexp_extract_all(F.col("t"), F.lit(java), F.lit(0))
        rest = F.split(F.col("t"), java)
        # one walk over the pieces around the matches, which holds the last characters before the current one
        start = F.struct(F.lit("").alias("tail"), F.lit(0).alias("i"), F.array().cast(_HITS).alias("out"))

        def step(acc, m):
            before = F.right(F.concat(acc["tail"], F.coalesce(F.get(rest, acc["i"]), F.lit(""))), F.lit(SECTION_REACH))
            hit = F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), acc["i"].alias("i"), m.alias("m"), before.alias("before"))
            return F.struct(F.right(F.concat(before, m), F.lit(SECTION_REACH)).alias("tail"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], F.array(hit)).alias("out"))

        item = F.aggregate(matches, start, step, lambda acc: acc["out"])  # built at once, so the names it uses are this phrase's
        found.append(F.when(F.size(matches) > 0, item).otherwise(F.array().cast(_HITS)))
    hits = base.select("source_doc_id", "own", F.explode(F.flatten(F.array(*found))).alias("h"))
    numbered = hits.select("source_doc_id", "own", "h.*", F.posexplode(T.doc_numbers(F.col("h.m"))).alias("p", "target_doc_number"))
    other = numbered.where(~F.col("target_doc_number").eqNullSafe(F.col("own")))
    first = W.partitionBy("source_doc_id", "kind", "target_doc_number").orderBy("k", "i", "p")
    section = F.regexp_extract("before", r"(?iuU)Điều\s+(\d+)", 1)
    return (
        other.withColumn("r", F.row_number().over(first))
        .where("r = 1")
        .select("source_doc_id", "target_doc_number", F.col("kind").alias("relation_type"), F.when(section == "", "").otherwise(F.concat(F.lit("Điều "), section)).alias("source_section"))
    )


def resolve(relations: DataFrame, docs: DataFrame) -> DataFrame:
    """``relations`` with the id of the target, the lowest of a number's documents, or null."""
    ids = docs.where("doc_number is not null").groupBy(F.col("doc_number").alias("target_doc_number")).agg(F.min("doc_id").alias("target_doc_id"))
    return relations.join(ids, "target_doc_number", "left")


def unseen(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Relations not yet stored: same source, target number and type."""
    return found.join(stored.select("source_doc_id", "target_doc_number", "relation_type").distinct(), ["source_doc_id", "target_doc_number", "relation_type"], "left_anti")


def merge_model_relations(by_rule: DataFrame, by_model: DataFrame) -> DataFrame:
    """Rule relations and those of a model that no rule gave (type and target per source)."""
    keys = ["source_doc_id", "relation_type", "target_doc_number"]
    return by_rule.withColumn("detected_by", F.lit("regex")).unionByName(by_model.join(by_rule.select(*keys), keys, "left_anti").withColumn("detected_by", F.lit("llm")), allowMissingColumns=True)


def outgoing(relations: DataFrame, docs: DataFrame, doc_id: int) -> DataFrame:
    meta = docs.select(F.col("doc_id").alias("target_doc_id"), F.col("title").alias("target_title"))
    return relations.where(F.col("source_doc_id") == doc_id).dropDuplicates(["id"]).join(meta, "target_doc_id", "left").select("id", "relation_type", "target_doc_id", "target_doc_number", "target_title")


def incoming(relations: DataFrame, docs: DataFrame, doc_id: int) -> DataFrame:
    meta = docs.select(F.col("doc_id").alias("source_doc_id"), F.col("title").alias("source_title"))
    return relations.where(F.col("target_doc_id") == doc_id).dropDuplicates(["id"]).join(meta, "source_doc_id", "left").select("id", "relation_type", "source_doc_id", "source_title")
