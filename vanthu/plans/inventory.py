"""Smaller queries over parts of the composite operators: joins, ranks, sorts, pages, set operations, updates as new tables."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Window as W, functions as F

from vanthu.functions import text as T
from vanthu.operators import chat, docgen, ingest, search, vectors, wiki
from vanthu.plans import pipeline as P, searching as Q, textsql as TX, wikisql as X
from vanthu.runtime import once, scratch, table
from vanthu.sources import files

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def derived(name: str, base: str, columns: list[str], sql_columns: str | None = None, where: str | None = None):
    """A part of another query, under the name of the operator that makes it."""
    module = next(m for m in (Q, P) if base in m.QUERIES)

    def run(spark, d):
        df = module.QUERIES[base](spark, d)
        return (df.where(where) if where else df).select(*columns)

    QUERIES[name] = run
    if base in module.ORACLE_SQL:
        ORACLE_SQL[name] = f"SELECT {sql_columns or ', '.join(columns)} FROM ({module.ORACLE_SQL[base]}) " + (f"WHERE {where}" if where else "")


derived("win_bm25_rank", "q_fts5_search", ["doc_id", "bm25_rank"])
derived("join_fts_chunks", "fts_bm25_chunks", ["id", "score"])
derived("win_vector_rank", "q_vector_by_doc_low", ["doc_id", "vector_rank"])
derived("agg_max_per_doc", "q_vector_by_doc_low", ["doc_id", "vec_score"])
derived("agg_rrf_sum", "join_rrf_full_outer", ["doc_id", "rrf"])
derived("join_source_flags", "join_rrf_full_outer", ["doc_id", "sources"])
derived("srt_page_local", "q_search_documents", ["doc_id", "rank", "score"])
derived("srt_hybrid", "q_hybrid_search", ["doc_id", "rank", "score"])
derived("srt_retrieve_topk", "q_retrieve_context", ["chunk_id", "score"])
derived("set_union_legs", "q_retrieve_context", ["chunk_id", "source"])
derived("win_first_per_key", "q_retrieve_context", ["chunk_id", "document_id", "dieu", "khoan"])
derived("join_enrich", "q_enrich", ["chunk_id", "doc_number", "doc_title", "issuing_date", "issuing_authority"])
derived("srt_rerank_topk", "q_rerank", ["chunk_id", "rerank_score"])
derived("set_union_expand", "q_expand", ["chunk_id", "source"])
derived("win_expand_cap", "q_expand", ["chunk_id", "document_id", "dieu"], where="source = 'context_expansion'")
derived("join_expand_semi", "q_expand", ["document_id"], where="source = 'context_expansion'")
derived("join_expand_anti", "q_expand", ["document_id", "dieu"], where="source = 'context_expansion'")
derived("fn_context_string", "q_context_end_to_end", ["context"])
derived("join_similar_docs", "q_similar_documents", ["doc_id", "title"])
derived("srt_similar_topk", "q_similar_documents", ["doc_id", "score"])
derived("join_lint_orphan", "q_lint_wiki", ["slug"], where="orphan")
derived("join_lint_expired", "q_lint_wiki", ["slug"], where="expired")
derived("join_lint_links", "q_lint_wiki", ["slug", "broken"], where="broken > 0")
derived("agg_lint_issues", "q_lint_wiki", ["slug", "broken", "expired", "orphan"], where="lint_status <> 'ok'")
derived("fn_lint_status", "q_lint_wiki", ["slug", "lint_status"])
derived("join_lint_pages_orphan", "q_lint_pages", ["slug"], where="orphan")
derived("join_lint_pages_links", "q_lint_pages", ["slug", "broken"], where="broken > 0")
derived("flt_lint", "q_lint_pages", ["slug"], where="lint_status <> 'ok'")
derived("join_lint_pages_expired", "q_lint_pages", ["slug"], where="expired")
derived("agg_lint_pages_issues", "q_lint_pages", ["slug", "broken", "expired", "orphan"], where="lint_status <> 'ok'")
derived("agg_wiki_status", "q_wiki_status", ["wiki_pages", "reviewed", "pending_review", "lint_issues"])
derived("fn_summary_fallback", "q_compile_wiki", ["document_id", "summary"])
derived("fn_obsidian_md", "q_compile_wiki", ["document_id", "markdown"])
derived("q_compile_all", "q_compile_wiki", ["slug", "document_id", "markdown"])
derived("fn_section_title", "agg_sections", ["doc_number", "title"])


@query(Q._HITS + ", f AS (SELECT nn::BIGINT AS n_docs, round(av, 6) AS avg_tokens, c0 AS df0, c1 AS df1, c2 AS df2, c3 AS df3 FROM hits_s) SELECT * FROM f")
def agg_bm25_stats(spark, d):
    index = Q.doc_index(spark, d)
    holding = [search.phrase_counts(index, p).agg(F.count(F.lit(1)).alias(f"df{i}")) for i, p in enumerate(T.query_phrases(Q.TEXT))]
    first = spark.range(1).select(F.lit(index.rows).cast("long").alias("n_docs"), F.round(F.lit(index.mean), 6).alias("avg_tokens"))
    return reduce(lambda a, b: a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k"), holding, first)


@query(Q._HITS + " SELECT d.doc_id, d.doc_number, round(score, 9) AS score FROM hits JOIN documents d ON d.doc_id = hits.id")
def join_fts_documents(spark, d):
    hits = search.bm25(Q.doc_index(spark, d), Q.TEXT)
    return Q.docs(spark, d).join(hits, F.col("doc_id") == F.col("id")).select("doc_id", "doc_number", F.round("score", 9).alias("score"))


@query(Q._HITS + " SELECT id AS doc_id FROM hits ORDER BY score, id LIMIT 30")
def srt_bm25(spark, d):
    return search.bm25(Q.doc_index(spark, d), Q.TEXT).orderBy("score", "id").limit(30).select(F.col("id").alias("doc_id"))


@query("SELECT e.vec_id, round(" + Q.S.DOT + ", 6) AS score FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE doc_type = 'quyet_dinh' AND effectiveness_status = 'con_hieu_luc' ORDER BY 2 DESC, 1 LIMIT 10")
def flt_vector_payload(spark, d):
    near = search.with_filters(Q.docs(spark, d), doc_type="quyet_dinh", status="con_hieu_luc").select("doc_id")
    return search.nearest(Q.vectors(spark, d).join(near, "doc_id", "left_semi"), Q.vector0(spark, d), 10)


@query("WITH " + P._MSG + " SELECT seq FROM m WHERE role IN ('user', 'assistant')")
def flt_role(spark, d):
    return P._messages(spark, d).where(F.col("role").isin("user", "assistant")).select("seq")


@query("WITH " + P._PG + " SELECT slug FROM pg WHERE reviewed")
def flt_reviewed(spark, d):
    return P._linked(spark, d).where("reviewed").select("slug")


@query("SELECT doc_id FROM documents WHERE to_json(list_value(doc_type, lang)) LIKE '%vi%'")
def flt_wiki_field(spark, d):
    """Pages whose field list, as JSON text, holds a string."""
    return Q.docs(spark, d).where(F.to_json(F.array("doc_type", "lang")).like("%vi%")).select("doc_id")


@query("WITH pg AS (SELECT doc_id, [doc_type, lang] AS legal_fields FROM documents) SELECT doc_id, (SELECT count(*) FROM pg) AS total FROM pg WHERE to_json(legal_fields) LIKE '%vi%' ORDER BY doc_id LIMIT 20")
def flt_wiki_field_page(spark, d):
    """A page of pages whose field list holds a string; the total is that of all pages."""
    pages = Q.docs(spark, d).select("doc_id", F.array("doc_type", "lang").alias("legal_fields"))
    kept = pages.where(F.contains(F.to_json("legal_fields"), F.lit("vi"))).orderBy("doc_id").limit(20)
    return kept.select("doc_id", F.lit(pages.count()).cast("long").alias("total"))


@query("SELECT queries, queries * 10 AS wanted, true AS enough FROM (SELECT count(*) AS queries FROM embeddings WHERE vec_id % 20 = 0)")
def vec_index_recall(spark, d):
    """Whether the inverted-file index finds at least nine of ten of the ten nearest vectors, looked into as many cells as other queries need for 95 in 100."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    index = once(spark, ("vectors", d), lambda: vectors.build(e))
    return vectors.recall(index, e, 10, vectors.probes_for(index, e, 10, 0.95)).select("queries", "wanted", (F.col("recall") >= 0.9).alias("enough"))


@query("WITH sc AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, embeddings e) SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5")
def vec_index_whole(spark, d):
    """The index looked into all of its cells gives what brute force does."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    index = once(spark, ("vectors", d), lambda: vectors.build(e))
    return vectors.search(index, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5, len(index.centres))


@query("SELECT doc_id FROM documents ORDER BY issuing_date DESC NULLS LAST, doc_id LIMIT 50")
def srt_issuing_date_text(spark, d):
    return Q.docs(spark, d).orderBy(F.desc("issuing_date"), "doc_id").limit(50).select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40")
def lim_paginate(spark, d):
    return Q.docs(spark, d).orderBy("doc_id").offset(40).limit(20).select("doc_id")


@query("SELECT DISTINCT document_id, id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, id) AS n FROM (SELECT DISTINCT document_id, id, chunk_index FROM chunks WHERE document_id IS NOT NULL)")
def srt_chunks_by_index(spark, d):
    c = table(spark, d, "chunks").select("document_id", "id", "chunk_index").distinct().where("document_id is not null")
    return c.select("document_id", "id", F.row_number().over(W.partitionBy("document_id").orderBy("chunk_index", "id")).cast("long").alias("n"))


@query("SELECT document_id, id, row_number() OVER (PARTITION BY document_id ORDER BY id) AS n FROM (SELECT DISTINCT document_id, id FROM doc_sections WHERE document_id IS NOT NULL)")
def srt_sections_by_id(spark, d):
    s = table(spark, d, "doc_sections").select("document_id", "id").distinct().where("document_id is not null")
    return s.select("document_id", "id", F.row_number().over(W.partitionBy("document_id").orderBy("id")).cast("long").alias("n"))


@query("SELECT id, row_number() OVER (PARTITION BY source_doc_id ORDER BY relation_type NULLS FIRST, id) AS n FROM (SELECT DISTINCT id, source_doc_id, relation_type FROM doc_relations)")
def srt_relations_by_type(spark, d):
    r = table(spark, d, "doc_relations").select("id", "source_doc_id", "relation_type").distinct()
    return r.select("id", F.row_number().over(W.partitionBy("source_doc_id").orderBy("relation_type", "id")).cast("long").alias("n"))


@query("SELECT user_id AS session_id, max(ts) AS updated_at FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def srt_sessions_updated(spark, d):
    m = P._messages(spark, d)
    return chat.sessions_by_update(m.groupBy("session_id").agg(F.min("timestamp").alias("created_at")), m).limit(20).select("session_id", "updated_at")


@query("WITH " + P._MSG + " SELECT session_id, seq FROM m QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY timestamp, seq) <= 3")
def srt_messages_time(spark, d):
    """The oldest messages of each session."""
    return P._messages(spark, d).withColumn("r", F.row_number().over(W.partitionBy("session_id").orderBy("timestamp", "seq"))).where("r <= 3").select("session_id", "seq")


@query("WITH " + P._MSG + " SELECT session_id, max(timestamp) AS updated_at FROM m GROUP BY 1")
def dml_update_session(spark, d):
    return P._messages(spark, d).groupBy("session_id").agg(F.max("timestamp").alias("updated_at"))


@query("WITH " + P._PG + " SELECT slug FROM pg ORDER BY created_at DESC, slug LIMIT 50")
def srt_wiki_created(spark, d):
    return P._linked(spark, d).orderBy(F.desc("created_at"), "slug").limit(50).select("slug")


@query("WITH " + P._PG + " SELECT slug, document_id, reviewed FROM pg WHERE document_id = (SELECT min(doc_id) FROM documents)")
def q_wiki_page(spark, d):
    one = Q.docs(spark, d).agg(F.min("doc_id")).first()[0]
    return P._linked(spark, d).where(F.col("slug") == f"trang-so-{one}-x").select("slug", "document_id", "reviewed")


@query("SELECT DISTINCT source_doc_id, target_doc_number, relation_type FROM doc_relations WHERE target_doc_number IS NOT NULL")
def set_dedup(spark, d):
    return table(spark, d, "doc_relations").where("target_doc_number is not null").select("source_doc_id", "target_doc_number", "relation_type").distinct()


@query("WITH r AS (SELECT DISTINCT source_doc_id, target_doc_number, relation_type FROM doc_relations WHERE target_doc_number IS NOT NULL) SELECT * FROM r a WHERE NOT EXISTS (SELECT 1 FROM doc_relations b WHERE b.source_doc_id = a.source_doc_id AND b.target_doc_number = a.target_doc_number AND b.relation_type = a.relation_type AND b.confidence < 0.9)")
def join_dup_relation(spark, d):
    from vanthu.operators.relations import unseen

    return unseen(set_dedup(spark, d), table(spark, d, "doc_relations").where("confidence < 0.9"))


@query("SELECT doc_id FROM documents WHERE doc_number IS NOT NULL AND doc_number NOT IN (SELECT target_doc_number FROM doc_relations WHERE target_doc_number IS NOT NULL)")
def join_existing_doc(spark, d):
    known = table(spark, d, "doc_relations").select(F.col("target_doc_number").alias("doc_number"))
    return ingest.insert_if_absent(known, Q.docs(spark, d).where("doc_number is not null"), "doc_number").select("doc_id")


@query(f"SELECT doc_id, regexp_replace(substring(content_markdown, n + 1, greatest(0, 500 - n)), '^{X.WS}+|{X.WS}+$', '', 'g') || '...' AS summary FROM (SELECT *, length('# Van ban so ' || coalesce(doc_number, '')) + 2 AS n FROM documents WHERE content_markdown IS NOT NULL)")
def fn_summary_slice(spark, d):
    """The text behind a document's head up to its 500th character."""
    head = F.length(F.concat(F.lit("# Van ban so "), F.coalesce("doc_number", F.lit("")))) + 2
    return Q.docs(spark, d).where("content_markdown is not null").select("doc_id", ingest.summary_slice(F.col("content_markdown"), head).alias("summary"))


@query("SELECT event_id, coalesce(len(json_keys(try_cast(props AS JSON))), 0)::INTEGER AS n FROM events")
def fn_json_decode(spark, d):
    m = F.from_json("props", "map<string,string>", {"mode": "PERMISSIVE"})
    return table(spark, d, "events").select("event_id", F.coalesce(F.when(m.isNotNull(), F.size(m)), F.lit(0)).alias("n"))


@query()
def fn_ids(spark, d):
    """New ids of the form sess_ and twelve hexadecimal digits; different each time."""
    return Q.docs(spark, d).select("doc_id", F.concat(F.lit("sess_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)).alias("session_id"))


@query("SELECT v, CASE v WHEN 'dia_danh' THEN 'Hà Nội' WHEN 'ngay' THEN '5' WHEN 'thang' THEN '4' WHEN 'nam' THEN '2026' ELSE '[Chưa điền ' || v || ']' END AS value FROM (SELECT unnest(['co_quan_trinh', 'dia_danh', 'ngay', 'thang', 'nam', 'noi_dung_trinh', 'cap_tren_kinh_gui', 'ly_do_trinh', 'can_cu_phap_ly', 'su_can_thiet', 'de_xuat_1', 'phuong_an_trien_khai', 'kinh_phi_thoi_gian', 'nguoi_trinh_ky']) AS v)")
def fn_template_defaults(spark, _d):
    return spark.createDataFrame(list(docgen.defaults("to_trinh_mau", datetime.date(2026, 4, 5)).items()), "v string, value string")


@query(TX.blocks("SELECT doc_id, '# Công văn' || chr(10) || 'Hà Nội, ngày 5 tháng 4 năm 2026' || chr(10) || '- [Chưa điền can_cu_phap_ly]' || chr(10) || '---' || chr(10) || '[Chưa điền nguoi_ky]' AS t FROM documents"))
def q_generate_draft(spark, d):
    """A letter for every document: its template filled and its lines classified for a word-processor file."""
    letter = "# Công văn\n{{ dia_danh }}, ngày {{ngay}} tháng {{ thang }} năm {{nam}}\n- {{ can_cu_phap_ly }}\n---\n{{ nguoi_ky }}"
    filled = docgen.render(F.lit(letter), docgen.defaults("cong_van_tra_loi", datetime.date(2026, 4, 5)))
    return docgen.blocks(Q.docs(spark, d).select("doc_id", filled.alias("text")), "doc_id", "text")


@query("WITH " + P._REL + ", h AS (SELECT i FROM hot) SELECT id, relation_type, 'in' AS direction FROM r WHERE target_doc_id = (SELECT i FROM h) UNION ALL SELECT id, relation_type, 'out' FROM r WHERE source_doc_id = (SELECT i FROM h)")
def q_relations_of(spark, d):
    from vanthu.operators import relations as R

    one, r, docs = P._hot(spark, d), table(spark, d, "doc_relations"), Q.docs(spark, d)
    cols = ["id", "relation_type", "direction"]
    return R.incoming(r, docs, one).withColumn("direction", F.lit("in")).select(*cols).unionByName(R.outgoing(r, docs, one).withColumn("direction", F.lit("out")).select(*cols))


@query("SELECT user_id AS file_hash, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1")
def str_ingest_status(spark, d):
    from vanthu.operators.uploads import latest

    return latest(table(spark, d, "events").select(F.col("user_id").alias("file_hash"), F.struct("ts", "event_id").alias("step"), F.col("event_type").alias("state")))


@query("SELECT doc_id, 1 AS embedding_indexed FROM documents WHERE embedding_indexed = 1 OR length(text) > 10")
def dml_flag_update(spark, d):
    """The flags after an indexing run, as a table of processed ids."""
    done = Q.docs(spark, d).where("embedding_indexed = 1 or length(text) > 10")
    return done.select("doc_id", F.lit(1).alias("embedding_indexed"))


@query("SELECT doc_id, coalesce(file_hash, sha256(text)) AS file_hash FROM documents WHERE text IS NOT NULL")
def dml_update_hash(spark, d):
    return Q.docs(spark, d).where("text is not null").select("doc_id", F.coalesce("file_hash", F.sha2(F.encode("text", "UTF-8"), 256)).alias("file_hash"))


@query("SELECT DISTINCT id, document_id, chunk_index FROM chunks")
def snk_tables(spark, d):
    """Chunks appended to a table in the shared folder and read again."""
    out = scratch(spark, "table")
    files.append(table(spark, d, "chunks").select("id", "document_id", "chunk_index").distinct(), out)
    return spark.read.parquet(out)


@query("SELECT vec_id FROM embeddings")
def snk_vector_upsert(spark, d):
    """Vectors upserted by id: half first, then all; ids of the second write replace those of the first."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    old = e.where("vec_id % 2 = 0")
    return old.join(e.select("vec_id"), "vec_id", "left_anti").unionByName(e).select("vec_id")


@query("SELECT DISTINCT id::VARCHAR AS id, document_number, chunk_index AS index, md5(text) AS h FROM chunks WHERE document_id IS NOT NULL AND text IS NOT NULL")
def src_json_corpus(spark, d):
    """Corpus files made of the chunk table, and one that is no JSON, read by the corpus source: several lines an object, bad files skipped."""
    out = scratch(spark, "corpus")
    c = table(spark, d, "chunks").where("document_id is not null and text is not null").dropDuplicates(["id"])
    one = F.struct(F.col("id").cast("string").alias("id"), F.col("chunk_index").alias("index"), "text", "dieu", "khoan", "document_number")
    grouped = c.groupBy("document_id").agg(F.collect_list(one).alias("chunks")).select(F.struct(F.col("document_id").cast("string").alias("source_id"), "chunks").alias("o"))
    lists = grouped.groupBy(F.pmod(F.xxhash64("o.source_id"), F.lit(max(1, c.count() // 20_000))).alias("f")).agg(F.to_json(F.collect_list("o"), {"pretty": "true"}).alias("value"))
    named = lists.withColumn("f", F.col("f").cast("string")).unionByName(spark.createDataFrame([("bad", "{")], "f string, value string"))
    named.repartition("f").write.partitionBy("f").text(f"{out}/text")
    return files.read_corpus(spark, f"{out}/text/*", "*.txt").select(F.explode("chunks").alias("c")).select("c.id", "c.document_number", "c.index", F.md5("c.text").alias("h"))


@query("SELECT count(*) = 0 AS empty FROM documents")
def src_seed_if_empty(spark, d):
    return Q.docs(spark, d).agg((F.count(F.lit(1)) == 0).alias("empty"))


@query(f"WITH {X.PAGES} SELECT slug, document_id, md5(markdown) AS h FROM pg")
def snk_wiki_md(spark, d):
    """The pages' JSON written to a folder and read again."""
    out = scratch(spark, "vault")
    files.write_pages(P._pages(spark, d), out)
    return spark.read.schema("slug string, document_id long, markdown string").json(f"{out}/json").select("slug", "document_id", F.md5("markdown").alias("h"))


@query("SELECT name, text FROM (VALUES ('a-b', '# A' || chr(10) || 'x'), ('c', 'neu'), ('d', '')) t(name, text)")
def snk_wiki_files(spark, _d):
    """Pages written as one text each, one of them again: it replaces its own text only."""
    out = scratch(spark, "vault")
    pages = spark.createDataFrame([("a-b", "# A\nx"), ("c", "alt"), ("d", "")], "slug string, markdown string")
    files.write_page_files(pages, out)
    files.write_page_files(pages.where("slug = 'c'").withColumn("markdown", F.lit("neu")), out)
    back = spark.read.text(f"{out}/tom-tat", wholetext=True).select(F.col("slug").alias("name"), F.regexp_replace("value", "\n$", "").alias("text"))
    return back


@query("SELECT doc_id, list_transform(['a', 'e', 'i', 'o', 'u'], lambda c: (length(coalesce(title, '')) - length(replace(coalesce(title, ''), c, '')))::FLOAT) AS embedding FROM documents")
def fn_encode(spark, d):
    """Vectors of titles by a stand-in encoder: letter counts, in place of a sentence model."""
    return files.encode(Q.docs(spark, d), "doc_id", "title", lambda texts: [[float(t.count(c)) for c in "aeiou"] for t in texts])
