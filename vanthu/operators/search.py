"""Full-text search, vector search and their fusion.

The text index of a table is kept in the shared folder: one row (token, id, col, pos, d) for each token of each column of a
row, with its positions and the row's number of tokens, sorted by token and id in ranges. A query reads only the pages of its
own tokens; the texts are neither read nor folded again, and those that are shown are fetched by the ids of one page.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vanthu.functions import dims, text as T
from vanthu.runtime import cut, scratch, stored

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
DOC_COLUMNS = ["doc_number", "title", "content_markdown", "issuing_authority"]
CHUNK_COLUMNS = ["text"]
SLICE = 100  # rows whose postings are made at once: their tokens are Python objects meanwhile
_POSTINGS = "token string, id long, col short, pos array<int>, d int"


class TextIndex(NamedTuple):
    """``postings`` (token, id, col, pos, d), the number of rows, and their mean number of tokens."""

    postings: DataFrame
    rows: int
    mean: float


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of (id, index form of each column), and for each row one with an empty token, which holds its length."""
    for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
        ids = batch.column(0).to_pylist()
        columns = [[t.split() for t in batch.column(k).to_pylist()] for k in range(1, batch.num_columns)]
        lengths = [sum(len(c[r]) for c in columns) for r in range(len(ids))]
        tokens, at, cols, positions, d = [""] * len(ids), list(ids), [-1] * len(ids), [[] for _ in ids], list(lengths)
        for k, column in enumerate(columns):
            for i, row, length in zip(ids, column, lengths):
                found: dict[str, list[int]] = {}
                for p, token in enumerate(row):
                    found.setdefault(token, []).append(p)
                tokens += found
                positions += found.values()
                n = len(found)
                at += [i] * n
                cols += [k] * n
                d += [length] * n
        kinds = (pa.string(), pa.int64(), pa.int16(), pa.list_(pa.int32()), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip((tokens, at, cols, positions, d), kinds)], names=["token", "id", "col", "pos", "d"])


def postings(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(token, id, col, pos, d) of all rows with an id; no shuffle. Rows delivered twice are here twice."""
    forms = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), *[T.folded(F.col(c)).alias(f"c{k}") for k, c in enumerate(columns)])
    return forms.mapInArrow(_tokenised, _POSTINGS)


def build_index(df: DataFrame, id_col: str, columns: list[str]) -> TextIndex:
    """The index of ``columns``, written to the shared folder. A token of every row lies in as many files as it needs."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "index")
    stored(postings(df, id_col, columns), "postings").repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.options(**{"parquet.block.size": 16 << 20, "compression": "zstd"}).parquet(path)
    kept = spark.read.schema(_POSTINGS).parquet(path)
    n, mean = kept.where("token = ''").groupBy("id").agg(F.first("d").alias("d")).agg(F.count(F.lit(1)), F.avg("d")).first()
    return TextIndex(kept, n, mean or 1.0)


def phrase_counts(index: TextIndex, phrase: str) -> DataFrame:
    """(id, f, d): how often a phrase, whose last token is a prefix, begins in any column. Only its tokens are read."""
    *exact, last = phrase.split(" ")
    of = lambda cond: index.postings.where(cond).dropDuplicates(["token", "id", "col"])
    found = of(F.col("token").startswith(last))
    if not exact:
        return found.groupBy("id").agg(F.sum(F.size("pos")).alias("f"), F.first("d").alias("d"))
    shifted = lambda c, k: F.transform(c, lambda x: x - k)
    starts = found.groupBy("id", "col").agg(shifted(F.flatten(F.collect_list("pos")), len(exact)).alias("at"), F.first("d").alias("d"))
    for k, token in enumerate(exact):
        there = of(F.col("token") == token).select("id", "col", shifted(F.col("pos"), k).alias("here"))
        starts = starts.join(there, ["id", "col"]).select("id", "col", "d", F.array_intersect("at", "here").alias("at"))
    return starts.groupBy("id").agg(F.sum(F.size("at")).alias("f"), F.first("d").alias("d")).where("f > 0")


def bm25(index: TextIndex, query: str) -> DataFrame:
    """(id, score) of the rows that hold every phrase of ``query``; more negative is better, as the score is ordered ascending.

    idf is clamped to a small positive value, so a phrase in more than half of the rows hardly counts. A query without a
    phrase matches nothing.
    """
    phrases = T.query_phrases(query)
    if not phrases:
        return index.postings.where("false").select("id", F.lit(0.0).alias("score"))
    each = cut(reduce(DataFrame.unionByName, [phrase_counts(index, p).withColumn("i", F.lit(i)) for i, p in enumerate(phrases)]))
    holding = {r["i"]: r["n"] for r in each.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
    every = each.groupBy("id").agg(*[F.sum(F.when(F.col("i") == i, F.col("f"))).alias(f"f{i}") for i in range(len(phrases))], F.first("d").alias("D"))
    score: Column = F.lit(0.0)
    for i in range(len(phrases)):
        f, n = F.col(f"f{i}"), holding.get(i, 0)
        idf = max(LEAST_IDF, math.log((index.rows - n + 0.5) / (n + 0.5)))
        score = score - F.lit(idf) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("D") / F.lit(index.mean)))
    return every.where(reduce(lambda a, b: a & b, [F.col(f"f{i}").isNotNull() for i in range(len(phrases))])).select("id", score.alias("score"))


def with_filters(docs: DataFrame, doc_type=None, authority=None, year=None, status=None) -> DataFrame:
    """Documents that meet the given filters; a filter not given holds for all."""
    if doc_type:
        docs = docs.where(F.col("doc_type") == doc_type)
    if authority:
        docs = docs.where(T.like_ascii(F.col("issuing_authority"), authority))
    if year:
        docs = docs.where(T.in_year(F.col("issuing_date"), year))
    if status:
        docs = docs.where(F.col("effectiveness_status") == status)
    return docs


def facets(docs: DataFrame, authorities: int = 10) -> DataFrame:
    """(facet, value, n) over all documents: type, status, year and the most frequent authorities. One pass, one shuffle of counts."""
    year = T.year_of(F.col("issuing_date"))
    pairs = docs.select(F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), v.alias("value")) for k, v in (("doc_type", F.col("doc_type")), ("status", F.col("effectiveness_status")), ("year", year), ("authority", F.col("issuing_authority")))])).alias("x"))
    counted = pairs.select("x.facet", "x.value").where("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    top = counted.where("facet = 'authority'").orderBy(F.desc("n"), "value").limit(authorities)
    return counted.where("facet <> 'authority'").unionByName(top)


def search_documents(docs: DataFrame, query: str, page: int = 1, size: int = 20, strict: bool = False, index: TextIndex | None = None, **filters) -> DataFrame:
    """One page of full-text hits: cut by the raw score, then ordered by the boosted one inside the page.

    ``strict`` boosts before the page is cut. Without a query: a list by date text, newest first. The texts of the page's
    rows alone are fetched, for their snippets.
    """
    kept = with_filters(docs, **filters)
    cols = ["doc_id", "doc_number", "title", "doc_type", "issuing_date", "effectiveness_status"]
    if not query.strip():
        rows = kept.orderBy(F.desc("issuing_date"), "doc_id").offset((page - 1) * size).limit(size)
        return rows.select(*cols, F.lit(0.0).alias("score"), F.row_number().over(W.orderBy(F.desc("issuing_date"), "doc_id")).alias("rank"))
    hits = bm25(index or build_index(docs, "doc_id", DOC_COLUMNS), query).withColumnRenamed("id", "doc_id")
    joined = kept.select(*cols).join(hits, "doc_id").withColumn("boosted", -F.col("score") * dims.status_factor(F.col("effectiveness_status")))
    first = F.desc("boosted") if strict else F.asc("score")
    rows = cut(joined.orderBy(first, "doc_id").offset((page - 1) * size).limit(size))
    snippet = T.highlight(F.coalesce("content_markdown", F.lit("")), query).alias("snippet")
    shown = docs.where(F.col("doc_id").isin([r[0] for r in rows.select("doc_id").collect()])).select("doc_id", snippet)
    return rows.join(F.broadcast(shown), "doc_id").select(*cols, F.col("boosted").alias("score"), F.row_number().over(W.orderBy(F.desc("boosted"), "score", "doc_id")).alias("rank"), "snippet")


def count_matches(docs: DataFrame, query: str, index: TextIndex | None = None, **filters) -> DataFrame:
    hits = bm25(index or build_index(docs, "doc_id", DOC_COLUMNS), query)
    return with_filters(docs, **filters).join(hits, F.col("doc_id") == F.col("id"), "left_semi").agg(F.count(F.lit(1)).alias("total"))


def fts_leg(docs: DataFrame, query: str, limit: int = dims.LEG_LIMIT, index: TextIndex | None = None, **filters) -> DataFrame:
    """(doc_id, bm25_rank): the best ``limit`` documents by raw score."""
    hits = bm25(index or build_index(docs, "doc_id", DOC_COLUMNS), query).withColumnRenamed("id", "doc_id")
    top = with_filters(docs, **filters).select("doc_id").join(hits, "doc_id").orderBy("score", "doc_id").limit(limit)
    return top.select("doc_id", F.row_number().over(W.orderBy("score", "doc_id")).alias("bm25_rank"))


def cosine(c: Column, vector: list[float]) -> Column:
    """The dot product with a literal vector, accumulated in double precision; vectors are of unit length."""
    lit = F.array(*[F.lit(float(x)) for x in vector])
    return F.aggregate(F.zip_with(c, lit, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)


def nearest(vectors: DataFrame, vector: list[float], k: int, id_col: str = "vec_id") -> DataFrame:
    """(vec_id, score): exact top ``k`` by cosine; filters on ``vectors`` apply before the cut. A top-k needs no shuffle of the vectors."""
    return vectors.select(id_col, F.round(cosine(F.col("embedding"), vector), 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def vector_leg(chunk_vectors: DataFrame, vector: list[float], limit: int = dims.LEG_LIMIT, threshold: float = dims.SCORE_THRESHOLD) -> DataFrame:
    """(doc_id, vec_score, vector_rank) from (vec_id, doc_id, embedding): the best three times ``limit`` chunks above the threshold, one for each document."""
    top = chunk_vectors.select("vec_id", "doc_id", F.round(cosine(F.col("embedding"), vector), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(limit * 3)
    best = top.where(F.col("score") >= threshold).groupBy("doc_id").agg(F.max("score").alias("vec_score"))
    ranked = best.orderBy(F.desc("vec_score"), "doc_id").limit(limit)
    return ranked.select("doc_id", "vec_score", F.row_number().over(W.orderBy(F.desc("vec_score"), "doc_id")).alias("vector_rank"))


def fuse(bm25_leg: DataFrame, vec_leg: DataFrame, mode: str) -> DataFrame:
    """(doc_id, bm25_rank, vector_rank, rrf, sources): reciprocal-rank fusion of both legs."""
    wb, wv = dims.WEIGHTS.get(mode, dims.WEIGHTS["balanced"])
    part = lambda w, r: F.coalesce(F.lit(w) / (dims.RRF_K + F.col(r)), F.lit(0.0))
    both = bm25_leg.join(vec_leg, "doc_id", "full_outer")
    names = F.array_compact(F.array(F.when(F.col("bm25_rank").isNotNull(), "BM25"), F.when(F.col("vector_rank").isNotNull(), "Vector")))
    return both.select("doc_id", "bm25_rank", "vector_rank", (part(wb, "bm25_rank") + part(wv, "vector_rank")).alias("rrf"), F.array_join(names, ",").alias("sources"))


def hybrid_search(docs: DataFrame, chunk_vectors: DataFrame, query: str, vector: list[float], mode: str, page: int = 1, size: int = 20, threshold: float = dims.SCORE_THRESHOLD, index: TextIndex | None = None, **filters) -> DataFrame:
    """One page of fused hits with status, rank and recency boosts. Authority and year filter the text leg only."""
    text_leg = fts_leg(docs, query, index=index, **filters)
    near = with_filters(docs, doc_type=filters.get("doc_type"), status=filters.get("status")).select("doc_id")
    vec_leg = vector_leg(chunk_vectors.join(near, "doc_id", "left_semi"), vector, threshold=threshold)
    fused = fuse(text_leg, vec_leg, mode)
    meta = docs.select("doc_id", F.lit(True).alias("known"), "doc_number", "title", "doc_type", "effectiveness_status", "issuing_date")
    joined = fused.join(meta, "doc_id", "left")
    boost = dims.status_factor(F.col("effectiveness_status")) * (1 + dims.rank_of(F.col("doc_type"), 6) / F.lit(15.0)) * T.recency(F.coalesce("issuing_date", F.lit("")))
    final = F.round(F.col("rrf") * F.when(F.col("known"), boost).otherwise(1.0), 9)
    order = [F.desc("score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("vector_rank")]
    ranked = joined.withColumn("score", final).orderBy(*order).offset((page - 1) * size).limit(size)
    return ranked.select("doc_id", "doc_number", "doc_type", "effectiveness_status", "sources", "score", F.row_number().over(W.orderBy(*order)).alias("rank"))


def similar_documents(docs: DataFrame, doc_vectors: DataFrame, doc_id: int, k: int = 5) -> DataFrame:
    """(doc_id, title, score): nearest other documents by the document's own vector, from (vec_id, doc_id, embedding)."""
    own = doc_vectors.where(F.col("doc_id") == doc_id).orderBy("vec_id").select("embedding").first()
    if own is None:
        return docs.select("doc_id", "title", F.lit(0.0).alias("score")).where(F.lit(False))
    top = doc_vectors.select("vec_id", "doc_id", F.round(cosine(F.col("embedding"), list(own[0])), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k * 3)
    best = top.where(F.col("doc_id") != doc_id).groupBy("doc_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
    return best.join(docs.select("doc_id", "title"), "doc_id")


def list_documents(docs: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    return docs.orderBy(F.desc("issuing_date"), "doc_id").offset((page - 1) * size).limit(size).select("doc_id", "doc_number", "title", "doc_type", "issuing_date", "effectiveness_status")


def document_detail(docs: DataFrame, chunks: DataFrame, sections: DataFrame, doc_id: int) -> DataFrame:
    """One row: the document with its ordered chunks and sections. Both filters reach the scans."""
    c = chunks.where(F.col("document_id") == doc_id).dropDuplicates(["id"]).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "dieu", "khoan"))).alias("chunks"))
    s = sections.where(F.col("document_id") == doc_id).dropDuplicates(["id"]).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("id", "section_type", "number"))).alias("sections"))
    one = docs.where(F.col("doc_id") == doc_id).select("doc_id", "doc_number", "title", "doc_type", "effectiveness_status")
    return one.join(c, one["doc_id"] == c["document_id"], "left").drop("document_id").join(s, one["doc_id"] == s["document_id"], "left").drop("document_id")
