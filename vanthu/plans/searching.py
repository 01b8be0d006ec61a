"""Queries of search, filters, facets, lists and the retrieval chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from vanthu.functions import dims, text as T
from vanthu.operators import rag, search
from vanthu.plans import sqltext as S, textsql as TX
from vanthu.runtime import once, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
TEXT, QUESTION = "giếng khoan tập thể", "quyết toán riêng giếng khoan"
UNIQUE_CHUNKS = "uc AS (SELECT DISTINCT * FROM chunks)"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def docs(spark, d):
    return table(spark, d, "documents")


def doc_index(spark, d):
    """The index of the documents of ``d``, built by the first query that asks for it."""
    return once(spark, ("documents", d), lambda: search.build_index(docs(spark, d), "doc_id", search.DOC_COLUMNS))


def chunk_index(spark, d):
    return once(spark, ("chunks", d), lambda: search.build_index(table(spark, d, "chunks"), "id", search.CHUNK_COLUMNS))


def vectors(spark, d):
    """Vectors bound to documents by id."""
    return table(spark, d, "embeddings").select("vec_id", F.col("vec_id").alias("doc_id"), "embedding")


def vector0(spark, d):
    return list(table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


# ---- filters and projections
@query("SELECT doc_id FROM documents WHERE doc_type = 'quyet_dinh'")
def flt_doc_type(spark, d):
    return search.with_filters(docs(spark, d), doc_type="quyet_dinh").select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(translate(issuing_authority, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'kho v')")
def flt_authority(spark, d):
    return search.with_filters(docs(spark, d), authority="KHO v").select("doc_id")


@query("SELECT doc_id FROM documents WHERE issuing_date LIKE '%/2024' OR issuing_date LIKE '2024%'")
def flt_year(spark, d):
    return search.with_filters(docs(spark, d), year=2024).select("doc_id")


@query("SELECT doc_id FROM documents WHERE effectiveness_status = 'con_hieu_luc'")
def flt_status(spark, d):
    return search.with_filters(docs(spark, d), status="con_hieu_luc").select("doc_id")


@query("SELECT doc_id FROM documents WHERE embedding_indexed = 0 AND length(text) > 10")
def flt_unindexed(spark, d):
    return docs(spark, d).where("embedding_indexed = 0 and length(text) > 10").select("doc_id")


@query("SELECT doc_id FROM documents WHERE relations_extracted = 0")
def flt_unprocessed(spark, d):
    return docs(spark, d).where("relations_extracted = 0").select("doc_id")


@query("SELECT DISTINCT target_doc_number FROM doc_relations WHERE trim(coalesce(target_doc_number, '')) NOT IN ('', 'N/A', 'Trang chu', 'Trang chủ', 'n/a', 'none', 'null', 'Trang') AND length(trim(target_doc_number)) >= 3 AND regexp_matches(target_doc_number, '\\p{Nd}')")
def flt_valid_docnum(spark, d):
    return table(spark, d, "doc_relations").where(T.valid_doc_number(F.col("target_doc_number"))).select("target_doc_number").distinct()


@query("SELECT file_hash, count(*) AS n FROM documents WHERE file_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def flt_hash_lookup(spark, d):
    return docs(spark, d).where("file_hash is not null").groupBy("file_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT vec_id, round(" + S.DOT + ", 6) AS score FROM embeddings WHERE " + S.DOT + " >= 0.2")
def flt_score_threshold(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(search.cosine(F.col("embedding"), vector0(spark, d)), 6).alias("score")).where("score >= 0.2")


@query("WITH " + UNIQUE_CHUNKS + " SELECT id, substring(text, 1, 300) AS preview FROM uc")
def prj_preview(spark, d):
    return table(spark, d, "chunks").dropDuplicates(["id"]).select("id", F.substring("text", 1, 300).alias("preview"))


# ---- lists, counts, facets
@query(
    "SELECT 'doc_type' AS facet, doc_type AS value, count(*) AS n FROM documents WHERE doc_type IS NOT NULL GROUP BY 2 UNION ALL SELECT 'status', effectiveness_status, count(*) FROM documents WHERE effectiveness_status IS NOT NULL GROUP BY 2 "
    "UNION ALL SELECT * FROM (SELECT 'authority', issuing_authority, count(*) AS n FROM documents WHERE issuing_authority IS NOT NULL GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10) "
    "UNION ALL SELECT 'year', y, count(*) FROM (SELECT list_filter(string_split(translate(issuing_date, '-', '/'), '/'), lambda p: regexp_full_match(p, '\\d{4}'))[1] AS y FROM documents) WHERE y IS NOT NULL GROUP BY 2"
)
def agg_facets(spark, d):
    return search.facets(docs(spark, d))


def _facet(name):
    return lambda spark, d: search.facets(docs(spark, d)).where(F.col("facet") == name).select("value", "n")


for _n in ("doc_type", "status", "year", "authority"):
    QUERIES[f"agg_facet_{_n}"] = _facet(_n)
    ORACLE_SQL[f"agg_facet_{_n}"] = f"SELECT value, n FROM ({ORACLE_SQL['agg_facets']}) WHERE facet = '{_n}'"


@query("SELECT doc_id, doc_number, title, doc_type, issuing_date, effectiveness_status FROM documents ORDER BY issuing_date DESC NULLS LAST, doc_id LIMIT 20 OFFSET 20")
def q_list_documents(spark, d):
    return search.list_documents(docs(spark, d), page=2)


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT id) FROM chunks) AS chunks, (SELECT count(DISTINCT id) FROM doc_relations) AS relations")
def agg_system_status(spark, d):
    one = docs(spark, d).agg(F.count(F.lit(1)).alias("documents"), F.lit(1).alias("k"))
    two = table(spark, d, "chunks").agg(F.count_distinct("id").alias("chunks"), F.lit(1).alias("k"))
    three = table(spark, d, "doc_relations").agg(F.count_distinct("id").alias("relations"), F.lit(1).alias("k"))
    return one.join(two, "k").join(three, "k").drop("k")


@query("SELECT count(DISTINCT id) AS chunks, count(DISTINCT document_id) AS documents FROM chunks")
def agg_distinct_doc_ids(spark, d):
    return table(spark, d, "chunks").agg(F.count_distinct("id").alias("chunks"), F.count_distinct("document_id").alias("documents"))


@query("SELECT count(*) AS points, max(len(embedding)) AS dims FROM embeddings")
def src_vector_scan(spark, d):
    return table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("points"), F.max(F.size("embedding")).cast("long").alias("dims"))


@query("SELECT type_code, type_name, hierarchy_rank FROM document_types")
def src_table_scan(spark, d):
    return table(spark, d, "document_types")


@query("SELECT d.doc_id, coalesce(t.hierarchy_rank, 6) AS hierarchy_rank FROM documents d LEFT JOIN document_types t ON d.doc_type = t.type_code")
def join_hierarchy_rank(spark, d):
    types = table(spark, d, "document_types").select(F.col("type_code").alias("doc_type"), "hierarchy_rank")
    return docs(spark, d).select("doc_id", "doc_type").join(types, "doc_type", "left").select("doc_id", F.coalesce("hierarchy_rank", F.lit(6)).alias("hierarchy_rank"))


@query("WITH " + UNIQUE_CHUNKS + " SELECT uc.id, d.doc_number, d.effectiveness_status FROM uc JOIN documents d ON uc.document_id = d.doc_id")
def join_chunks_docs(spark, d):
    return table(spark, d, "chunks").select("id", "document_id").distinct().join(docs(spark, d).select(F.col("doc_id").alias("document_id"), "doc_number", "effectiveness_status"), "document_id").select("id", "doc_number", "effectiveness_status")


@query("WITH " + UNIQUE_CHUNKS + ", s AS (SELECT document_id, try_cast(number AS INTEGER) AS dieu, min(id) AS section_id FROM doc_sections WHERE section_type = 'dieu' AND try_cast(number AS INTEGER) IS NOT NULL GROUP BY ALL) SELECT uc.id, s.section_id FROM uc LEFT JOIN s ON s.document_id = uc.document_id AND s.dieu = uc.dieu")
def join_section_of_chunk(spark, d):
    s = table(spark, d, "doc_sections").where("section_type = 'dieu'").withColumn("dieu", F.expr("try_cast(number as int)")).where("dieu is not null").groupBy("document_id", "dieu").agg(F.min("id").alias("sid"))
    c = table(spark, d, "chunks").select("id", "document_id", "dieu").distinct()
    return c.join(s, ["document_id", "dieu"], "left").select("id", F.col("sid").alias("section_id"))


@query("WITH " + UNIQUE_CHUNKS + " SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY document_id, dieu ORDER BY chunk_index, id) AS r FROM uc WHERE coalesce(dieu, 0) <> 0 AND document_id IS NOT NULL) WHERE r = 1")
def win_first_section(spark, d):
    from pyspark.sql import Window as W

    c = table(spark, d, "chunks").select("id", "document_id", "dieu", "chunk_index").distinct().where("coalesce(dieu, 0) <> 0 and document_id is not null")
    return c.withColumn("r", F.row_number().over(W.partitionBy("document_id", "dieu").orderBy("chunk_index", "id"))).where("r = 1").select("id")


@query("WITH " + UNIQUE_CHUNKS + " SELECT id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, id) - 1 AS new_index FROM uc WHERE document_id IS NOT NULL")
def win_chunk_index(spark, d):
    from pyspark.sql import Window as W

    c = table(spark, d, "chunks").select("id", "document_id", "chunk_index").distinct().where("document_id is not null")
    return c.select("id", (F.row_number().over(W.partitionBy("document_id").orderBy("chunk_index", "id")) - 1).cast("long").alias("new_index"))


@query("SELECT d.doc_id, len(list_distinct(list(c.id))) AS n_chunks FROM documents d JOIN chunks c ON c.document_id = d.doc_id GROUP BY 1")
def agg_chunks_per_doc(spark, d):
    c = table(spark, d, "chunks").select("id", "document_id").distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return docs(spark, d).select("doc_id").join(c, F.col("doc_id") == F.col("document_id")).select("doc_id", "n_chunks")


@query(
    "WITH p AS (SELECT doc_id AS i FROM documents ORDER BY doc_id LIMIT 1) SELECT doc_id, doc_number, title, doc_type, effectiveness_status, "
    "(SELECT list_sort(list({'chunk_index': chunk_index, 'id': id, 'dieu': dieu, 'khoan': khoan})) FROM (SELECT DISTINCT chunk_index, id, dieu, khoan FROM chunks WHERE document_id = (SELECT i FROM p))) AS chunks, "
    "(SELECT list_sort(list({'id': id, 'section_type': section_type, 'number': number})) FROM (SELECT DISTINCT id, section_type, number FROM doc_sections WHERE document_id = (SELECT i FROM p))) AS sections FROM documents WHERE doc_id = (SELECT i FROM p)"
)
def q_document_detail(spark, d):
    one = docs(spark, d).agg(F.min("doc_id")).first()[0]
    return search.document_detail(docs(spark, d), table(spark, d, "chunks"), table(spark, d, "doc_sections"), one)


# ---- full text
_HITS = "WITH " + S.bm25("documents", "doc_id", search.DOC_COLUMNS, TEXT)


@query(_HITS + " SELECT id AS doc_id, round(score, 9) AS score FROM hits")
def fts_bm25(spark, d):
    return search.bm25(doc_index(spark, d), TEXT).select(F.col("id").alias("doc_id"), F.round("score", 9).alias("score"))


@query("WITH " + S.bm25("uc", "id", ["text"], QUESTION).replace("hits_n AS", UNIQUE_CHUNKS + ", hits_n AS", 1) + " SELECT id, round(score, 9) AS score FROM hits")
def fts_bm25_chunks(spark, d):
    return search.bm25(chunk_index(spark, d), QUESTION).select("id", F.round("score", 9).alias("score"))


@query(f"WITH n AS (SELECT doc_id AS id, {S.fold('title')} AS t FROM documents), e AS (SELECT id, unnest(list_filter(string_split(t, ' '), lambda w: w <> '')) AS token FROM n) SELECT id, 'title' AS col, token, count(*) AS tf FROM e GROUP BY ALL")
def fts_postings(spark, d):
    return search.postings(docs(spark, d), "doc_id", ["title"]).where("col = 0").select("id", F.lit("title").alias("col"), "token", F.size("pos").cast("long").alias("tf"))


@query(_HITS + ", j AS (SELECT d.*, score, -score * " + S.factor("effectiveness_status") + " AS b FROM hits JOIN documents d ON d.doc_id = hits.id ORDER BY score, doc_id LIMIT 20) SELECT doc_id, doc_number, title, doc_type, issuing_date, effectiveness_status, round(b, 6) AS score, row_number() OVER (ORDER BY b DESC, j.score, doc_id) AS rank, " + TX.highlight("coalesce(content_markdown, '')", TEXT) + " AS snippet FROM j")
def q_search_documents(spark, d):
    return search.search_documents(docs(spark, d), TEXT, index=doc_index(spark, d)).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@query(_HITS + " SELECT count(*) AS total FROM hits JOIN documents d ON d.doc_id = hits.id WHERE effectiveness_status = 'con_hieu_luc'")
def agg_count_total(spark, d):
    return search.count_matches(docs(spark, d), TEXT, index=doc_index(spark, d), status="con_hieu_luc")


_LEG = _HITS + ", bleg AS (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) AS bm25_rank FROM hits JOIN documents d ON d.doc_id = hits.id QUALIFY bm25_rank <= 200)"


@query(_LEG + " SELECT * FROM bleg")
def q_fts5_search(spark, d):
    return search.fts_leg(docs(spark, d), TEXT, index=doc_index(spark, d)).withColumn("bm25_rank", F.col("bm25_rank").cast("long"))


# ---- vectors
@query("SELECT vec_id, round(" + S.DOT + ", 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 20")
def q_vector_search(spark, d):
    return search.nearest(table(spark, d, "embeddings"), vector0(spark, d), 20)


def _vleg(threshold):
    return (
        "vtop AS (SELECT vec_id, vec_id AS doc_id, round(" + S.DOT + ", 6) AS score FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY 3 DESC, 1 LIMIT 600), "
        f"vbest AS (SELECT doc_id, max(score) AS vec_score FROM vtop WHERE score >= {threshold} GROUP BY 1), vleg AS (SELECT doc_id, vec_score, row_number() OVER (ORDER BY vec_score DESC, doc_id) AS vector_rank FROM vbest QUALIFY vector_rank <= 200)"
    )


def _by_doc(threshold):
    def run(spark, d):
        v = vectors(spark, d).join(docs(spark, d).select("doc_id"), "doc_id", "left_semi")
        return search.vector_leg(v, vector0(spark, d), threshold=threshold).withColumn("vector_rank", F.col("vector_rank").cast("long"))

    return run


for _k, _t in (("q_vector_by_doc", 0.4), ("q_vector_by_doc_low", 0.1)):
    QUERIES[_k], ORACLE_SQL[_k] = _by_doc(_t), "WITH " + _vleg(_t) + " SELECT * FROM vleg"

_FUSED = _LEG + ", " + _vleg(0.1) + ", fused AS (SELECT coalesce(b.doc_id, v.doc_id) AS doc_id, bm25_rank, vector_rank, coalesce(0.5 / (60 + bm25_rank), 0) + coalesce(0.5 / (60 + vector_rank), 0) AS rrf, concat_ws(',', CASE WHEN bm25_rank IS NOT NULL THEN 'BM25' END, CASE WHEN vector_rank IS NOT NULL THEN 'Vector' END) AS sources FROM bleg b FULL JOIN vleg v ON b.doc_id = v.doc_id)"


@query(_FUSED + " SELECT doc_id, bm25_rank, vector_rank, round(rrf, 9) AS rrf, sources FROM fused")
def join_rrf_full_outer(spark, d):
    f = search.fuse(QUERIES["q_fts5_search"](spark, d), QUERIES["q_vector_by_doc_low"](spark, d), "balanced")
    return f.withColumn("rrf", F.round("rrf", 9))


@query(
    _FUSED + ", j AS (SELECT f.doc_id, doc_number, doc_type, effectiveness_status, sources, bm25_rank, vector_rank, round(rrf * CASE WHEN d.doc_id IS NULL THEN 1.0 ELSE " + S.factor("effectiveness_status") + " * (1 + " + S.rank("doc_type", 6) + " / 15.0::DOUBLE) * " + S.recency("issuing_date")
    + " END, 9) AS score FROM fused f LEFT JOIN documents d ON d.doc_id = f.doc_id) SELECT doc_id, doc_number, doc_type, effectiveness_status, sources, score, row_number() OVER (ORDER BY score DESC, bm25_rank NULLS LAST, vector_rank NULLS LAST) AS rank FROM j QUALIFY rank <= 20"
)
def q_hybrid_search(spark, d):
    return search.hybrid_search(docs(spark, d), vectors(spark, d), TEXT, vector0(spark, d), "balanced", threshold=0.1, index=doc_index(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(
    "WITH own AS (SELECT min(doc_id) AS i FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)), top AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = (SELECT i FROM own))), 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 15), "
    "b AS (SELECT vec_id, score FROM top WHERE vec_id <> (SELECT i FROM own) ORDER BY score DESC, vec_id LIMIT 5) SELECT d.doc_id, b.score, d.title FROM b JOIN documents d ON d.doc_id = b.vec_id"
)
def q_similar_documents(spark, d):
    v = vectors(spark, d)
    own = docs(spark, d).join(v.select("doc_id"), "doc_id", "left_semi").agg(F.min("doc_id")).first()[0]
    return search.similar_documents(docs(spark, d), v, own)


# ---- retrieval chain
def _cv(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


_RETR = (
    "WITH " + UNIQUE_CHUNKS + ", vn AS (SELECT vec_id AS chunk_id, round(" + S.DOT + ", 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 20), v AS (SELECT id AS chunk_id, document_id, substring(text, 1, 300) AS content, dieu, khoan, score, 'vector' AS source FROM uc JOIN vn ON vn.chunk_id = uc.id), "
    + S.bm25("uc", "id", ["text"], QUESTION) + ", bt AS (SELECT id, score FROM hits ORDER BY score, id LIMIT 20), b AS (SELECT uc.id AS chunk_id, document_id, text AS content, dieu, khoan, round(abs(score), 6) AS score, 'bm25' AS source FROM uc JOIN bt ON bt.id = uc.id), "
    "u AS (SELECT * FROM v UNION ALL SELECT * FROM b), r AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY document_id, dieu, khoan ORDER BY source DESC, score DESC, chunk_id) = 1), "
    "ret AS (SELECT * FROM r ORDER BY score DESC, chunk_id LIMIT 20), enr AS (SELECT ret.*, coalesce(doc_number, '') AS doc_number, coalesce(title, '') AS doc_title, coalesce(doc_type, '') AS doc_type, coalesce(effectiveness_status, '') AS effectiveness_status, coalesce(issuing_date, '') AS issuing_date, coalesce(issuing_authority, '') AS issuing_authority FROM ret LEFT JOIN documents d ON d.doc_id = ret.document_id), "
    "rer AS (SELECT *, round(score * " + S.factor("effectiveness_status") + " * (1 + " + S.rank("doc_type", 5) + " / 30.0::DOUBLE) * (1.0 + CASE WHEN coalesce(dieu, 0) <> 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN coalesce(khoan, 0) <> 0 THEN 0.1::DOUBLE ELSE 0 END), 6) AS rerank_score FROM enr ORDER BY rerank_score DESC, chunk_id LIMIT 5), "
    "guided AS (SELECT DISTINCT target_doc_id AS g FROM doc_relations WHERE relation_type = 'huong_dan' AND target_doc_id IS NOT NULL AND source_doc_id IN (SELECT document_id FROM rer)), "
    "fresh AS (SELECT uc.id AS chunk_id, document_id, text AS content, dieu, khoan FROM uc WHERE document_id IN (SELECT g FROM guided) AND document_id IN (SELECT doc_id FROM documents) AND NOT EXISTS (SELECT 1 FROM rer WHERE rer.document_id = uc.document_id AND rer.dieu IS NOT DISTINCT FROM uc.dieu) QUALIFY row_number() OVER (PARTITION BY document_id, dieu ORDER BY uc.id) = 1), "
    "added AS (SELECT * FROM fresh ORDER BY document_id, chunk_id LIMIT 4), "
    "expd AS (SELECT chunk_id, document_id, content, dieu, khoan, source, doc_number, doc_title, doc_type, effectiveness_status, rerank_score FROM rer UNION ALL SELECT chunk_id, document_id, content, dieu, khoan, 'context_expansion', coalesce(doc_number, ''), coalesce(title, ''), coalesce(doc_type, ''), coalesce(effectiveness_status, ''), NULL FROM added JOIN documents d ON d.doc_id = added.document_id), "
    "tg AS (SELECT *, '[' || " + S.case(dims.STATUS_ICON, "effectiveness_status", "'⚪'") + " || ' | ' || " + S.case({c: n for c, _, n in dims.HIERARCHY}, "doc_type", "CASE WHEN doc_type = '' THEN 'VĂN BẢN' ELSE upper(doc_type) END") + " || ' | Hiệu lực pháp lý: ' || " + S.rank("doc_type", 9) + " || '/15]' AS tag, row_number() OVER (ORDER BY rerank_score IS NULL, rerank_score DESC, document_id, chunk_id) AS n FROM expd) "
)


def _retrieved(spark, d):
    return rag.retrieve(table(spark, d, "chunks"), _cv(spark, d), QUESTION, vector0(spark, d), index=chunk_index(spark, d))


def _chain(spark, d):
    return rag.chain(table(spark, d, "chunks"), _cv(spark, d), docs(spark, d), table(spark, d, "doc_relations"), QUESTION, vector0(spark, d), index=chunk_index(spark, d))


@query(_RETR + "SELECT chunk_id, document_id, content, dieu, khoan, score, source FROM ret")
def q_retrieve_context(spark, d):
    return _retrieved(spark, d)


@query(_RETR + "SELECT * FROM enr")
def q_enrich(spark, d):
    return rag.enrich(_retrieved(spark, d), docs(spark, d))


@query(_RETR + "SELECT chunk_id, document_id, doc_type, effectiveness_status, rerank_score FROM rer")
def q_rerank(spark, d):
    return rag.rerank(rag.enrich(_retrieved(spark, d), docs(spark, d))).select("chunk_id", "document_id", "doc_type", "effectiveness_status", "rerank_score")


@query(_RETR + "SELECT chunk_id, document_id, dieu, khoan, source, doc_number, rerank_score FROM expd")
def q_expand(spark, d):
    return _chain(spark, d).select("chunk_id", "document_id", "dieu", "khoan", "source", "doc_number", "rerank_score")


@query(_RETR + "SELECT chunk_id, tag FROM tg")
def q_tag(spark, d):
    return _chain(spark, d).select("chunk_id", "tag")


@query(_RETR + "SELECT string_agg('Tài liệu [' || n || '] ' || tag || ' (Số hiệu: ' || doc_number || ', Tên: ' || doc_title || CASE WHEN coalesce(dieu, 0) <> 0 THEN ', Điều ' || dieu ELSE '' END || CASE WHEN coalesce(khoan, 0) <> 0 THEN ', Khoản ' || khoan ELSE '' END || '):' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context FROM tg")
def q_context_end_to_end(spark, d):
    return rag.context_string(_chain(spark, d))


@query(_RETR + "SELECT n, document_id AS doc_id, doc_number, doc_title, dieu, khoan, substring(content, 1, 200) AS content_preview FROM tg")
def fn_citations(spark, d):
    return rag.citations(_chain(spark, d)).withColumn("n", F.col("n").cast("long"))


@query(_RETR + "SELECT '**Các quy định liên quan tìm được:**' || chr(10) || chr(10) || string_agg('**[' || n || ']** ' || doc_number || CASE WHEN coalesce(dieu, 0) <> 0 THEN ' — Điều ' || dieu ELSE '' END || chr(10) || substring(content, 1, 500) || chr(10), chr(10) ORDER BY n) || chr(10) || chr(10) || '*⚠️ AI không khả dụng. Vui lòng cấu hình API key.*' AS answer FROM tg")
def fn_fallback_answer(spark, d):
    return rag.fallback_answer(_chain(spark, d))
