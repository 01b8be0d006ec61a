"""The public surface: one method for each request, over the tables of one folder or of a store."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from vanthu.functions import text as T
from vanthu.operators import chat, docgen, guard, ingest, models, rag, relations, search, uploads, wiki
from vanthu.runtime import cut, once, remove_scratch, table
from vanthu.sources import files
from vanthu.sources.store import Store
from vanthu.streaming import incremental


class Engine:
    """Requests over a folder of tables, or over a ``Store``, whose tables requests can also change.

    ``encode`` turns a question into a vector; without it only text is searched. ``model`` answers and summarises, ``ocr`` reads
    PDF files, ``pdf`` makes them of DOCX ones; without them their fallbacks hold.
    """

    def __init__(
        self, spark: SparkSession, folder: str, encode: Callable[[str], list[float]] | None = None, store: Store | None = None,
        model: models.Model | None = None, ocr: Callable[[bytes, str], str | None] | None = None, pdf: Callable[[bytes], bytes | None] | None = None,
    ):
        self.spark, self.folder, self.encode, self.store, self.model, self.ocr, self.pdf = spark, folder, encode, store, model, ocr, pdf

    def _t(self, name: str) -> DataFrame:
        return self.store.read(name) if self.store else table(self.spark, self.folder, name)

    def _vectors(self, key: str) -> DataFrame:
        return self._t("embeddings").select("vec_id", F.col("vec_id").alias(key), "embedding")

    def _index(self, name: str) -> search.TextIndex:
        """The text index of a table, built once for each state of it."""
        key, columns = {"documents": ("doc_id", search.DOC_COLUMNS), "chunks": ("id", search.CHUNK_COLUMNS)}[name]
        rows = self._t(name)
        columns = [c for c in (*columns, "summary") if c in rows.columns]
        return once(self.spark, (name, self.folder, self.store.version() if self.store else 0), lambda: search.build_index(rows, key, columns))

    def _own(self) -> Store:
        if self.store is None:
            raise ValueError("this request changes tables and needs a store")
        return self.store

    def close(self) -> None:
        """Deletes what the session has written to the shared folder besides its tables: indexes and intermediate results."""
        remove_scratch(self.spark)

    # ---- search and documents
    def search(self, query: str = "", page: int = 1, size: int = 20, **filters) -> DataFrame:
        """Fused search where an encoder is given and the query is not blank, else full text."""
        if self.encode and query.strip():
            mode = self.spark.range(1).select(T.search_mode(F.lit(query)).alias("m")).first()["m"]
            return search.hybrid_search(self._t("documents"), self._vectors("doc_id"), query, self.encode(query), mode, page, size, index=self._index("documents"), **filters)
        index = self._index("documents") if query.strip() else None
        return search.search_documents(self._t("documents"), query, page, size, index=index, **filters)

    def search_page(self, query: str = "", page: int = 1, size: int = 20, **filters) -> tuple[DataFrame, int, DataFrame]:
        """(hits, total, facets): a page, the number of all that match by text, and the facets of the whole collection."""
        docs = self._t("documents")
        total = search.count_matches(docs, query, index=self._index("documents"), **filters).first()["total"] if query.strip() else search.with_filters(docs, **filters).count()
        return self.search(query, page, size, **filters), total, self.facets()

    def facets(self) -> DataFrame:
        return search.facets(self._t("documents"))

    def documents(self, page: int = 1, size: int = 20) -> DataFrame:
        return search.list_documents(self._t("documents"), page, size)

    def document(self, doc_id: int) -> DataFrame:
        return search.document_detail(self._t("documents"), self._t("chunks"), self._t("doc_sections"), doc_id)

    def relations(self, doc_id: int) -> tuple[DataFrame, DataFrame]:
        r, d = self._t("doc_relations"), self._t("documents")
        return relations.outgoing(r, d, doc_id), relations.incoming(r, d, doc_id)

    def similar(self, doc_id: int, k: int = 5) -> DataFrame:
        return search.similar_documents(self._t("documents"), self._vectors("doc_id"), doc_id, k)

    # ---- questions
    def route(self, questions: DataFrame) -> DataFrame:
        return guard.route(questions)

    def suggested_questions(self) -> list[str]:
        return list(guard.SUGGESTED)

    def context(self, question: str) -> DataFrame:
        """Tagged context chunks of a question; needs an encoder."""
        if self.encode is None:
            raise ValueError("context() needs an encoder")
        if not question.strip():
            raise ValueError("the question is blank")
        return rag.chain(self._t("chunks"), self._vectors("chunk_id"), self._t("documents"), self._t("doc_relations"), question, self.encode(question), index=self._index("chunks"))

    def answer(self, question: str, model: Callable[[str, str], str] | None = None) -> str:
        """The model's answer to the question and its context, or the listing of the passages found."""
        rows, model = cut(self.context(question)), model or self.model
        if model is None:
            return rag.fallback_answer(rows).first()["answer"] or guard.ANSWERS["nothing_found"]
        return model(question, rag.context_string(rows).first()["context"])

    def ask(self, question: str, session_id: str | None = None) -> dict:
        """A question through guard and routing: the canned answer, or answer and citations; kept in the session where one is named."""
        routed = guard.route(self.spark.createDataFrame([(question,)], "question string")).first().asDict()
        answer, cited = routed.get("answer"), []
        if answer is None:
            rows = cut(self.context(question))
            cited = [r.asDict() for r in rag.citations(rows).orderBy("n").collect()]
            answer = self.model(question, rag.context_string(rows).first()["context"]) if self.model else rag.fallback_answer(rows).first()["answer"] or guard.ANSWERS["nothing_found"]
        if session_id:
            self.save_messages(session_id, [("user", question), ("assistant", answer)])
        return {"answer": answer, "citations": cited, "route": routed["intent"]}

    def stream(self, question: str, session_id: str | None = None) -> Iterator[str]:
        """The server-sent events of a question: progress, the answer, or the error, and the closing line."""
        try:
            got = self.ask(question, session_id)
            rows = [(1, "progress", "retrieve" if got["citations"] else "guard", None), (2, "answer", "generate", got["answer"])]
        except ValueError as e:
            rows = [(1, "error", "guard", str(e))]
        events = self.spark.createDataFrame(rows, "n int, type string, node string, content string")
        yield from (r["data"] for r in incremental.sse(events).orderBy("n").collect())

    # ---- sessions
    def create_session(self, user: str = "default_user", session_id: str | None = None) -> str:
        """The session's id; an id that is there stays as it is."""
        session_id = session_id or f"sess_{uuid.uuid4().hex[:12]}"
        now = datetime.datetime.now()
        new = self.spark.createDataFrame([(session_id, user, now, now)], "session_id string, user_id string, created_at timestamp, updated_at timestamp")
        fresh = chat.fresh_sessions(self._own().read("chat_sessions"), new)
        if not fresh.isEmpty():
            self.store.commit(append={"chat_sessions": fresh})
        return session_id

    def save_messages(self, session_id: str, messages: list[tuple[str, str]]) -> int:
        """Keeps (role, content) in order; unknown roles and sessions are left out. Returns how many were kept."""
        held = self._own().read("chat_messages")
        at = held.where(F.col("session_id") == session_id).agg(F.max("seq")).first()[0] or 0
        now = datetime.datetime.now()
        new = self.spark.createDataFrame([(f"msg_{uuid.uuid4().hex[:12]}", session_id, role, content, now, at + 1 + k) for k, (role, content) in enumerate(messages)], "message_id string, session_id string, role string, content string, timestamp timestamp, seq long")
        kept = cut(chat.valid_messages(self.store.read("chat_sessions"), new))
        if n := kept.count():
            self.store.commit(append={"chat_messages": kept})
        return n

    def sessions(self, user: str = "default_user") -> DataFrame:
        return chat.sessions_of(self._own().read("chat_sessions"), self.store.read("chat_messages"), user)

    def messages(self, session_id: str, limit: int | None = None) -> DataFrame:
        return chat.messages_of(self._own().read("chat_messages"), session_id, limit)

    def memory(self, session_id: str, n: int = 10) -> DataFrame:
        """The last messages of a session, as a model is given them."""
        return chat.last_messages(self._own().read("chat_messages").where(F.col("session_id") == session_id), n).orderBy("timestamp", "seq")

    def delete_session(self, session_id: str) -> bool:
        """Deletes a session with its messages in one step; whether there was one."""
        sessions, messages = self._own().read("chat_sessions"), self.store.read("chat_messages")
        gone = sessions.where(F.col("session_id") == session_id).select("session_id").distinct()
        if gone.isEmpty():
            return False
        s, m = chat.delete_sessions(sessions, messages, gone)
        self.store.commit(replace={"chat_sessions": s, "chat_messages": m})
        return True

    def summarise_sessions(self) -> None:
        if self.model:
            sessions, messages = self._own().read("chat_sessions"), self.store.read("chat_messages")
            self.store.commit(replace={"chat_sessions": chat.summarise(sessions, messages, self.model)})

    # ---- drafts
    def draft(self, kind: str, template: str, today, values: dict[str, str] | None = None) -> tuple[str, bytes]:
        """A filled template as markdown and as a word-processor file."""
        filled = docgen.defaults(kind, today) | (values or {})
        one = self.spark.createDataFrame([(template,)], "t string").select(docgen.render(F.col("t"), filled).alias("text"), F.lit(0).alias("id"))
        rows = [r.asDict() for r in docgen.blocks(one).orderBy("n").collect()]
        return one.first()["text"], files.write_docx(rows)

    def save_draft(self, question: str, answer: str, kind: str, template: str, today) -> dict:
        """A draft of an answer, kept as md, docx and, where it can be made, pdf; its id and what files there are."""
        if not question or not answer:
            raise ValueError("question and answer must not be empty")
        text, docx = self.draft(kind, template, today, models.form_values(question, answer, docgen.VARIABLES.get(kind, []), self.model))
        draft_id = f"draft_{uuid.uuid4().hex[:12]}"
        paths = files.write_draft(self.spark, f"{self.folder}/drafts", draft_id, text, docx, self.pdf)
        return {"draft_id": draft_id, "template_type": kind, "has_pdf": paths["pdf"] is not None, "content_preview": text[:500]}

    def download(self, draft_id: str, ext: str = "pdf") -> bytes | None:
        return files.read_draft(self.spark, f"{self.folder}/drafts", draft_id, ext.lower())

    # ---- ingest
    def ingest(self, corpus_folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(documents, sections, chunks) of a folder of corpus files."""
        chunks = ingest.without_repeats(ingest.corpus_chunks(files.read_corpus(self.spark, corpus_folder)))
        return ingest.documents_of(chunks), ingest.sections_of(chunks), chunks

    def load(self, corpus_folder: str) -> int:
        """Adds the corpus's documents whose number is not there, with their sections and chunks, in one step; returns how many."""
        docs, sections, chunks = self.ingest(corpus_folder)
        return self._add(docs.withColumn("effective_date", F.col("issuing_date")), sections, chunks.select(F.col("key").alias("doc_number"), "index", "text", "dieu", "khoan", "token_count"))

    def _add(self, docs: DataFrame, sections: DataFrame, chunks: DataFrame) -> int:
        """Rows by doc_number, with new ids after those that are there."""
        old = self._own().read("documents")
        start = lambda name, c: self.store.read(name).agg(F.max(c)).first()[0] or 0
        fresh = ingest.insert_if_absent(old, docs, "doc_number")
        new = cut(ingest.with_ids(fresh, ["doc_number"], start("documents", "doc_id")).withColumnRenamed("id", "doc_id").withColumn("created_at", F.current_timestamp()))
        ids = new.select("doc_number", F.col("doc_id").alias("document_id"))
        s = ingest.with_ids(sections.join(ids, "doc_number"), ["document_id", "number"], start("doc_sections", "id"))
        s = cut(s)
        c = ingest.with_ids(chunks.join(ids, "doc_number"), ["document_id", "index"], start("chunks", "id")).withColumnRenamed("index", "chunk_index").withColumn("document_number", F.col("doc_number"))
        first = s.where("section_type = 'dieu'").select("document_id", F.expr("try_cast(number as int)").alias("dieu"), F.col("id").alias("section_id"))
        n = new.count()
        if n:
            self.store.commit(append={"documents": new, "doc_sections": s, "chunks": c.join(first, ["document_id", "dieu"], "left")})
        return n

    def seed_if_empty(self, base: str) -> int:
        """Loads ``base``/chunks, or ``base``/data, if there is no document yet."""
        return self.load(files.select_folder(self.spark, base)) if self._own().read("documents").isEmpty() else 0

    def start(self, base: str) -> dict[str, int]:
        """What a new service does first: seed, index, relations; a step that fails does not keep the others from running."""
        done: dict[str, int] = {}
        for name, step in (("documents", lambda: self.seed_if_empty(base)), ("indexed", lambda: self._index("chunks").rows), ("relations", lambda: incremental.store_relations(self._own(), self.store.read("documents")))):
            try:
                done[name] = step()
            except Exception:  # noqa: BLE001
                done[name] = -1
        return done

    def upload(self, glob: str) -> DataFrame:
        """Takes PDF and DOCX files in: documents, sections, chunks, relations, pages and the states each file passed. The last state of each file."""
        store = self._own()
        up = self.spark.read.format("binaryFile").load(glob).select("path", "content")
        empty = [(f.getPath().toString(), b"") for f in store.fs.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)) if f.isFile() and not f.getLen()]
        if empty:  # the source leaves these out
            up = up.unionByName(self.spark.createDataFrame(empty, "path string, content binary"))
        parsed = uploads.parse(up, store.read("documents"), self.ocr)
        pieces = parsed.chunks.select("doc_number", "index", "text", "dieu", "khoan", "token_count", "file_hash").join(parsed.documents.select("file_hash"), "file_hash", "left_semi")
        sections = ingest.sections_of(pieces.withColumnRenamed("doc_number", "key").withColumn("hash", F.md5("text")))
        known = store.read("documents").select("doc_id")
        self._add(parsed.documents, sections, pieces)
        files.write_chunks(parsed.chunks, parsed.states, f"{self.folder}/chunks_uploads")
        new = cut(store.read("documents").join(known, "doc_id", "left_anti"))
        if not new.isEmpty():
            incremental.store_relations(store, new)
            incremental.store_pages(store, new)
        ids = store.read("documents").select("doc_number", "doc_id")
        ended = parsed.states.join(ids, "doc_number", "left").withColumns({"document_id": F.coalesce("document_id", F.when(F.col("state") == "ingesting", F.col("doc_id"))), "state": F.when(F.col("state") == "ingesting", "done").otherwise(F.col("state"))})
        ended = cut(ended.select("file_hash", "file_name", "file_type", "document_id", "state", "error_message"))
        store.commit(append={"ingest_status": uploads.way(ended)})
        return ended

    def ingest_status(self, file_hash: str) -> DataFrame:
        """The states a file has passed, in order."""
        return self._own().read("ingest_status").where(F.col("file_hash") == file_hash).orderBy("step")

    # ---- wiki
    def compile_wiki(self) -> DataFrame:
        told = models.wiki_parts(self._t("documents"), self.model) if self.model else None
        return wiki.compile_wiki(self._t("documents"), self._t("chunks"), told=told)

    def compile_stored(self, doc_id: int | None = None, limit: int | None = None, again: bool = True) -> int:
        """Compiles all documents, or one, or the first ``limit`` by id, into the stored pages; returns how many. Without ``again``, those that have no page yet."""
        docs = self._own().read("documents")
        if doc_id is not None:
            docs = docs.where(F.col("doc_id") == doc_id)
        if not again:
            docs = docs.join(self.store.read("wiki_pages").select(F.col("document_id").alias("doc_id")).distinct(), "doc_id", "left_anti")
        return incremental.store_pages(self.store, docs.orderBy("doc_id").limit(limit) if limit else docs)

    def lint_wiki(self) -> DataFrame:
        return wiki.lint(cut(self.compile_wiki()), self._t("documents"))

    def lint_stored(self) -> DataFrame:
        """Lints the stored pages and keeps each page's status with it."""
        pages = self._own().read("wiki_pages")
        found = cut(wiki.lint(pages, self.store.read("documents")))
        self.store.commit(replace={"wiki_pages": pages.drop("lint_status").join(found.select("slug", "lint_status"), "slug")})
        return found

    def wiki_status(self) -> DataFrame:
        pages = cut(self.compile_wiki())
        return wiki.status(pages.select("slug", "reviewed").join(wiki.lint(pages, self._t("documents")).select("slug", "lint_status"), "slug"))

    def wiki_pages(self, field: str | None = None, page: int = 1, size: int = 20) -> tuple[DataFrame, int]:
        """(a page of pages, newest first, whose legal fields hold ``field``; the number of all pages, filter or not)."""
        pages = self._own().read("wiki_pages")
        kept = pages.where(F.contains(F.to_json("legal_fields"), F.lit(field))) if field else pages
        return kept.orderBy(F.desc("created_at"), "slug").offset((page - 1) * size).limit(size).withColumn("summary", F.substring("summary", 1, 200)), pages.count()

    def wiki_page(self, slug: str) -> DataFrame:
        return self._own().read("wiki_pages").where(F.col("slug") == slug)

    # ---- status
    def vector_info(self) -> DataFrame:
        return self._t("embeddings").agg(F.count(F.lit(1)).alias("points"), F.max(F.size("embedding")).alias("dims"))

    def system_status(self) -> dict[str, int]:
        one = lambda name, c: self._t(name).select(F.count_distinct(c)).first()[0]
        out = {"documents": one("documents", "doc_id"), "chunks": one("chunks", "id"), "relations": self._t("doc_relations").count()}
        return out | ({"wiki_pages": self.store.read("wiki_pages").count()} if self.store else {})
