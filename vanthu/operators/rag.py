"""The retrieval chain of grounded answers: retrieve, enrich, rerank, expand, tag, context, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vanthu.functions import dims, text as T
from vanthu.operators.search import CHUNK_COLUMNS, TextIndex, bm25, build_index, cosine
from vanthu.runtime import cut

PREVIEW = 300


def retrieve(chunks: DataFrame, chunk_vectors: DataFrame, question: str, vector: list[float], k: int = dims.RETRIEVE_K, index: TextIndex | None = None) -> DataFrame:
    """The best ``k`` chunks of both legs on one raw scale, first of each (document, article, clause); nulls count as equal.

    The vector leg comes first and holds only the preview of a text. Both legs are cut to ``k`` ids before any text is
    read. (chunk_id, document_id, content, dieu, khoan, score, source)
    """
    near = chunk_vectors.select("chunk_id", F.round(cosine(F.col("embedding"), vector), 6).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)
    hits = bm25(index or build_index(chunks, "id", CHUNK_COLUMNS), question).orderBy("score", "id").limit(k).select(F.col("id").alias("chunk_id"), F.round(F.abs("score"), 6).alias("score"))
    legs = cut(near.withColumn("source", F.lit("vector")).unionByName(hits.withColumn("source", F.lit("bm25"))))
    shown = chunks.where(F.col("id").isin(sorted({r[0] for r in legs.select("chunk_id").collect()}))).select(F.col("id").alias("chunk_id"), "document_id", "text", "dieu", "khoan").dropDuplicates(["chunk_id"])
    content = F.when(F.col("source") == "vector", F.substring("text", 1, PREVIEW)).otherwise(F.col("text")).alias("content")
    both = shown.join(F.broadcast(legs), "chunk_id").select("chunk_id", "document_id", content, "dieu", "khoan", "score", "source")
    first = W.partitionBy("document_id", "dieu", "khoan").orderBy(F.desc("source"), F.desc("score"), "chunk_id")
    return cut(both.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").orderBy(F.desc("score"), "chunk_id").limit(k))


def enrich(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Document columns for each chunk, empty where the document is missing."""
    cols = {"doc_number": "doc_number", "title": "doc_title", "doc_type": "doc_type", "effectiveness_status": "effectiveness_status", "issuing_date": "issuing_date", "issuing_authority": "issuing_authority"}
    meta = docs.select(F.col("doc_id").alias("document_id"), *[F.col(a).alias(b) for a, b in cols.items()])
    joined = rows.join(meta, "document_id", "left")
    return joined.withColumns({b: F.coalesce(b, F.lit("")) for b in cols.values()})


def rerank_score(score: Column, status: Column, doc_type: Column, dieu: Column, khoan: Column) -> Column:
    given = lambda c: F.coalesce(c.cast("string"), F.lit("")).isin("", "0")
    specific = 1.0 + F.when(given(dieu), 0.0).otherwise(0.2) + F.when(given(khoan), 0.0).otherwise(0.1)
    return score * dims.status_factor(status) * (1.0 + dims.rank_of(doc_type, 5) / F.lit(30.0)) * specific


def rerank(rows: DataFrame, k: int = dims.CONTEXT_K) -> DataFrame:
    """The best ``k`` chunks by status, rank and specificity."""
    s = rerank_score(F.col("score"), F.col("effectiveness_status"), F.col("doc_type"), F.col("dieu"), F.col("khoan"))
    return rows.withColumn("rerank_score", F.round(s, 6)).orderBy(F.desc("rerank_score"), "chunk_id").limit(k)


def expand(rows: DataFrame, relations: DataFrame, chunks: DataFrame, docs: DataFrame, cap: int = dims.EXPAND_CAP) -> DataFrame:
    """``rows`` and up to ``cap`` chunks of the documents they guide, one for each new (document, article)."""
    sources = rows.select(F.col("document_id").alias("source_doc_id")).distinct()
    guided = relations.where("relation_type = 'huong_dan' and target_doc_id is not null").join(sources, "source_doc_id", "left_semi").select(F.col("target_doc_id").alias("document_id")).distinct()
    extra = chunks.join(guided, "document_id", "left_semi").select(F.col("id").alias("chunk_id"), "document_id", F.col("text").alias("content"), "dieu", "khoan").distinct()
    have = rows.select(F.col("document_id").alias("_d"), F.col("dieu").alias("_a")).distinct()
    fresh = extra.join(have, F.col("document_id").eqNullSafe(F.col("_d")) & F.col("dieu").eqNullSafe(F.col("_a")), "left_anti")
    one = fresh.withColumn("_r", F.row_number().over(W.partitionBy("document_id", "dieu").orderBy("chunk_id"))).where("_r = 1").drop("_r")
    known = docs.select("doc_id").withColumnRenamed("doc_id", "document_id")
    added = enrich(one.join(known, "document_id", "left_semi").orderBy("document_id", "chunk_id").limit(cap), docs)
    return rows.unionByName(added.withColumn("source", F.lit("context_expansion")), allowMissingColumns=True)


def tag(doc_type: Column, status: Column) -> Column:
    return F.concat(F.lit("["), dims.status_icon(status), F.lit(" | "), dims.label_of(doc_type), F.lit(" | Hiệu lực pháp lý: "), dims.rank_of(doc_type, 9).cast("string"), F.lit("/15]"))


def tag_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tag", tag(F.col("doc_type"), F.col("effectiveness_status")))


def numbered(rows: DataFrame) -> DataFrame:
    """Context chunks with their position: reranked ones first, then the added ones. A few rows, so one window is no burden."""
    order = W.orderBy(F.col("rerank_score").isNull(), F.desc("rerank_score"), "document_id", "chunk_id")
    return rows.withColumn("n", F.row_number().over(order))


def context_string(rows: DataFrame) -> DataFrame:
    """One row (context): the numbered passages with their tags, as a model is given them."""
    have = lambda c, name: F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.concat(F.lit(f", {name} "), F.col(c).cast("string"))).otherwise("")
    head = F.concat(F.lit("Tài liệu ["), F.col("n").cast("string"), F.lit("] "), F.col("tag"), F.lit(" (Số hiệu: "), F.col("doc_number"), F.lit(", Tên: "), F.col("doc_title"), have("dieu", "Điều"), have("khoan", "Khoản"), F.lit("):\n"), F.col("content"))
    return numbered(rows).select("n", head.alias("s")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), "\n\n---\n\n").alias("context"))


def citations(rows: DataFrame) -> DataFrame:
    """One citation for each context chunk, with a preview of 200 characters."""
    return numbered(rows).select("n", F.col("document_id").alias("doc_id"), "doc_number", "doc_title", "dieu", "khoan", F.substring("content", 1, 200).alias("content_preview"))


def fallback_answer(rows: DataFrame) -> DataFrame:
    """One row (answer): the passages listed, for when no model is available."""
    art = F.when(F.coalesce(F.col("dieu"), F.lit(0)) != 0, F.concat(F.lit(" — Điều "), F.col("dieu").cast("string"))).otherwise("")
    part = F.concat(F.lit("**["), F.col("n").cast("string"), F.lit("]** "), F.col("doc_number"), art, F.lit("\n"), F.substring("content", 1, 500), F.lit("\n"))
    body = numbered(rows).select("n", part.alias("s")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), "\n").alias("b"))
    return body.select(F.concat(F.lit("**Các quy định liên quan tìm được:**\n\n"), F.col("b"), F.lit("\n\n*⚠️ AI không khả dụng. Vui lòng cấu hình API key.*")).alias("answer"))


def chain(chunks, chunk_vectors, docs, relations, question: str, vector: list[float], index: TextIndex | None = None) -> DataFrame:
    """Retrieve, enrich, rerank, expand and tag for one question."""
    ranked = rerank(enrich(retrieve(chunks, chunk_vectors, question, vector, index=index), docs))
    return tag_rows(expand(ranked, relations, chunks, docs))
