"""Wiki pages: rule-based compilation, upsert by slug, lint and status."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vanthu.functions import text as T
from vanthu.runtime import cut

#: A needle is looked up by its first so many characters.
KEY = 20
TABLE_BITS, HASHES = 1 << 27, 3  # 16 megabytes, three bits a key
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def key_points(chunks: DataFrame) -> DataFrame:
    """(document_id, key_points): of the first fifteen chunks by chunk_index (none first), up to five first lines of articles."""
    line = F.trim(F.element_at(F.split("text", "\n"), 1))
    fit = (F.coalesce("dieu", F.lit(0)) != 0) & (F.length("text") > 30) & (F.length(line) > 10) & ~line.startswith("Điều")
    point = F.when(fit, F.concat(F.lit("Điều "), F.col("dieu").cast("string"), F.lit(": "), F.substring(line, 1, 120)))
    rows = chunks.where("document_id is not null").select("id", "document_id", "chunk_index", point.alias("point")).dropDuplicates(["id"])
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("document_id").orderBy("chunk_index", "id"))).where("n <= 15")
    points = F.array_sort(F.collect_list(F.when(F.col("point").isNotNull(), F.struct("n", "point"))))
    return first.groupBy("document_id").agg(F.slice(F.transform(points, lambda x: x["point"]), 1, 5).alias("key_points"))


# Patterns of named authorities, in the order in which they are tried, and of the line below a signature's head.
AUTHORITIES = [r"(Bộ\s+[\w\s]+?)(?=\s+(?:ban hành|quy định|hướng dẫn|chỉ đạo))", r"(Ủy ban nhân dân\s+[\w\s]+?)(?=\s+(?:ban hành|quyết định))", r"(Thủ tướng Chính phủ)", r"(Chính phủ)"]
SIGNER = r"(?:KT\.|TM\.|Thay mặt.*?)\n+([A-ZÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐ][^\n]{5,60})\n"


def authorities(content: Column, issuer: Column) -> Column:
    """Up to five authorities: the issuer, then those named in the first 3000 characters, in pattern order."""
    head = F.substring(content, 1, 3000)
    named = F.flatten(F.array(*[F.transform(F.regexp_extract_all(head, F.lit("(?iuU)" + p), F.lit(1)), lambda x: F.trim(x)) for p in AUTHORITIES]))
    own = F.filter(F.array(issuer), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.slice(F.array_distinct(F.concat(own, F.coalesce(named, F.array().cast("array<string>")))), 1, 5)


def entities(content: Column, issuer: Column, issued: Column, effective: Column) -> Column:
    """(authorities, signers, dates (issuance, effective)); a document without an effective date is in effect from its issue."""
    signer = F.trim(F.regexp_extract(F.coalesce(content, F.lit("")), SIGNER, 1))
    text = lambda c: F.coalesce(c, F.lit(""))
    dates = F.struct(text(issued).alias("issuance"), F.coalesce(F.nullif(effective, F.lit("")), text(issued)).alias("effective"))
    return F.struct(authorities(content, issuer).alias("authorities"), F.when(signer == "", F.array().cast("array<string>")).otherwise(F.array(signer)).alias("signers"), dates.alias("dates"))


def summary(issuer: Column, number: Column, date: Column, content: Column) -> Column:
    snippet = F.substring(F.array_join(T.words(F.substring(content, 1, 600)), " "), 1, 400)
    return F.concat(F.coalesce(issuer, F.lit("")), F.lit(" ban hành văn bản số "), F.coalesce(number, F.lit("")), F.lit(" ngày "), F.coalesce(date, F.lit("")), F.lit(". Nội dung: "), snippet, F.lit("..."))


QA = "array<struct<question:string,answer:string>>"


def compile_pages(docs: DataFrame, chunks: DataFrame, today: datetime.date | None = None, told: DataFrame | None = None, model: str = "") -> DataFrame:
    """One page for each document: slug, title, document_id, doc_number, the document's own columns, summary, key_points,
    legal_fields, suggested_qa, entities, confidence, created_by_model, created_at, markdown.

    A document without content has that of its chunks, one after the other. ``told`` (document_id, summary, key_points,
    suggested_qa, legal_fields, confidence) is what a model said of documents; what it left out, or all, is told by rule,
    without fields and questions and with confidence 0.
    """
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    bare = docs.where("coalesce(content_markdown, '') = ''").select(F.col("doc_id").alias("document_id")).distinct()
    parts = chunks.select("id", "document_id", "chunk_index", "text").join(bare, "document_id", "left_semi").dropDuplicates(["id"]).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "text"))).alias("cs"))
    joined = parts.select(F.col("document_id").alias("doc_id"), F.array_join(F.transform("cs", lambda c: c["text"]), "\n").alias("joined"))
    docs = docs.join(joined, "doc_id", "left").withColumn("content_markdown", F.coalesce(F.nullif("content_markdown", F.lit("")), "joined", F.lit("")))
    base = docs.join(key_points(chunks).withColumnRenamed("document_id", "doc_id"), "doc_id", "left")
    kinds = {"summary": "string", "key_points": "array<string>", "suggested_qa": QA, "legal_fields": "array<string>", "confidence": "double"}
    if told is None:
        base = base.withColumns({f"told_{c}": F.lit(None).cast(kind) for c, kind in kinds.items()})
    else:
        base = base.join(told.select(F.col("document_id").alias("doc_id"), *[F.col(c).cast(kind).alias(f"told_{c}") for c, kind in kinds.items()]), "doc_id", "left")
    none = lambda kind: F.array().cast(kind)
    slug = T.slugify(F.concat(s("doc_number"), F.lit("-"), s("doc_type")))
    page = base.select(
        F.when(slug == "", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).otherwise(slug).alias("slug"), s("title").alias("title"), F.col("doc_id").alias("document_id"), s("doc_number").alias("doc_number"), s("doc_type").alias("doc_type"),
        s("issuing_date").alias("issuing_date"), s("issuing_authority").alias("issuing_authority"), s("effectiveness_status").alias("effectiveness_status"),
        F.coalesce(F.nullif("told_summary", F.lit("")), summary(F.col("issuing_authority"), F.col("doc_number"), F.col("issuing_date"), F.col("content_markdown"))).alias("summary"),
        F.coalesce(F.when(F.size("told_key_points") > 0, F.col("told_key_points")), "key_points", none("array<string>")).alias("key_points"),
        F.coalesce("told_legal_fields", none("array<string>")).alias("legal_fields"), F.coalesce("told_suggested_qa", none(QA)).alias("suggested_qa"),
        entities(F.col("content_markdown"), F.col("issuing_authority"), F.col("issuing_date"), F.col("effective_date")).alias("entities"),
        F.coalesce("told_confidence", F.lit(0.0)).alias("confidence"), F.lit(model).alias("created_by_model"), F.col("created_at"),
    )
    return page.withColumn("markdown", markdown(F.lit((today or datetime.date.today()).isoformat())))


def markdown(today: Column) -> Column:
    """The page's text: front matter, head, summary, key points, facts, questions and links."""
    c, l = F.col, F.lit
    none = "_chưa xác định_"
    lines = lambda items, line: F.array_join(F.transform(items, line), "")
    given = lambda items, head, line: F.when(F.size(items) > 0, F.concat(l(head), lines(items, line))).otherwise("")
    listed = lambda items, n: F.coalesce(F.nullif(F.array_join(F.slice(items, 1, n), ", "), l("")), l(none))
    effective = c("entities.dates.effective")
    field = lambda name, value: F.concat(l(f'{name}: "'), value, l('"\n'))
    tags = F.when(F.size("legal_fields") > 0, lines("legal_fields", lambda t: F.concat(l('  - "'), t, l('"\n')))).otherwise('  - "pháp-luật"\n')
    front = F.concat(
        l("---\n"), field("title", F.substring("title", 1, 100)), l("type: tom_tat\n"), field("doc_number", c("doc_number")), field("doc_type", c("doc_type")),
        l("sources:\n  - doc_id: "), c("document_id").cast("string"), l('\n    doc_number: "'), c("doc_number"), l('"\n    title: "'), F.substring("title", 1, 80), l('"\ntags:\n'), tags,
        field("issuing_authority", c("issuing_authority")), field("issuance_date", c("issuing_date")), field("effective_date", effective),
        l("created: "), today, l("\nupdated: "), today, l("\n"), field("created_by_model", c("created_by_model")), l("reviewed: false\n---\n\n"),
    )
    head = F.concat(l("# "), F.substring("title", 1, 120), l("\n\n> **Số hiệu:** "), c("doc_number"), l(" | **Ngày ban hành:** "), c("issuing_date"), l(" | **Cơ quan:** "), c("issuing_authority"), l("\n\n## Tóm tắt\n\n"), c("summary"), l("\n"))
    points = given("key_points", "\n## Điểm chính\n\n", lambda k: F.concat(l("- "), k, l("\n")))
    rows = [("Số hiệu", c("doc_number")), ("Loại văn bản", c("doc_type")), ("Cơ quan ban hành", c("issuing_authority")), ("Ngày ban hành", c("issuing_date")), ("Ngày hiệu lực", effective)]
    rows += [("Người ký", listed("entities.signers", 2)), ("Cơ quan liên quan", listed("entities.authorities", 3)), ("Hiệu lực", c("effectiveness_status"))]
    facts = F.concat(l("\n## Thông tin văn bản\n\n| Thuộc tính | Giá trị |\n|---|---|\n"), *[F.concat(l(f"| {k} | "), v, l(" |\n")) for k, v in rows])
    asked = given("suggested_qa", "\n## Câu hỏi thường gặp\n\n", lambda q: F.concat(l("**Q: "), F.coalesce(q["question"], l("")), l("**\n\n> "), F.coalesce(q["answer"], l("")), l("\n\n")))
    links = F.when(F.size("legal_fields") > 0, lines(F.slice("legal_fields", 1, 3), lambda t: F.concat(l("- Xem thêm: [[linh-vuc/"), T.slugify(t), l("]]\n")))).otherwise("- _Chưa có liên kết._")
    closing = F.concat(l("\n\n---\n*Trang này được biên dịch tự động bởi hệ thống vào "), today, l(". Vui lòng review trước khi sử dụng.*\n"))
    return F.concat(front, head, points, facts, asked, l("\n## Liên kết\n\n"), links, closing)


def upsert(pages: DataFrame, compiled: DataFrame) -> DataFrame:
    """``pages`` with ``compiled`` merged by slug: document, review flag and creation time of an existing page stay. Among compiled pages of one slug the last document wins."""
    columns = [c for c in compiled.columns if c not in ("slug", "reviewed")]
    last = compiled.groupBy("slug").agg(F.max_by(F.struct(*columns), "document_id").alias("n"))
    old = pages.select("slug", *[F.col(x).alias(f"old_{x}") for x in (*columns, "reviewed")])
    both = old.join(last, "slug", "full_outer")
    of = lambda x: (F.coalesce(f"old_{x}", f"n.{x}") if x in ("document_id", "created_at") else F.coalesce(f"n.{x}", f"old_{x}")).alias(x)
    return both.select("slug", *map(of, columns), F.coalesce("old_reviewed", F.lit(False)).alias("reviewed"))


def compile_wiki(docs: DataFrame, chunks: DataFrame, **more) -> DataFrame:
    """The pages of ``compile_pages`` with ``reviewed``, one for each slug: documents are compiled by id, the first makes the page and the last fills it."""
    compiled = compile_pages(docs, chunks, **more)
    columns = [c for c in compiled.columns if c != "slug"]
    first = compiled.groupBy("slug").agg(F.min_by(F.struct(*columns), "document_id").alias("f")).select("slug", "f.*", F.lit(False).alias("reviewed"))
    return upsert(first, compiled)


def broken_links(pages: DataFrame) -> DataFrame:
    """(slug, link): links of which neither the last part nor the slug of the whole is a page."""
    links = pages.select("slug", F.explode(T.wiki_links(F.coalesce("markdown", F.lit("")))).alias("link"))
    keyed = links.withColumn("base", F.element_at(F.split("link", "/"), -1)).withColumn("whole", T.slugify(F.translate("link", "/", "-")))
    known = pages.select(F.col("slug").alias("k")).distinct()
    return keyed.join(known, F.col("base") == F.col("k"), "left_anti").join(known, F.col("whole") == F.col("k"), "left_anti").select("slug", "link").distinct()


def _window_hashes(codes: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, 64-bit hash of each window of so many characters)."""
    n = len(codes)
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, _BACK, dtype=np.uint64)
    up[:1] = down[:1] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * np.cumprod(up))])
    down = np.cumprod(down)
    for k in lengths:
        if k <= n:
            x = (sums[k:] - sums[:-k]) * down[: n - k + 1]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            yield k, x ^ (x >> np.uint64(29))


def _bits(h: np.ndarray) -> Iterator[np.ndarray]:
    """The places of hashes in a bit table, one array for each of HASHES."""
    for _ in range(HASHES):
        yield h >> np.uint64(37)
        h = h * np.uint64(0x94D049BB133111EB) + np.uint64(1)
        h ^= h >> np.uint64(32)


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def holders(pages: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, low, high): the lowest and highest slug of the pages that hold a needle, for needles that are not empty.

    A page can only hold a needle if it holds the first ``KEY`` characters of it, which is an equi-join on the windows of its
    text; the characters after them are then compared. Bit tables of fixed size keep other windows out of the shuffle, and the
    text after the first characters where no needle is longer; the pages of a hot start are then one row.
    """
    keyed = cut(needles.where("needle <> ''").select("needle", F.substring("needle", 1, KEY).alias("key")).distinct())
    lengths = sorted(r[0] for r in keyed.select(F.length("key")).distinct().collect())
    longest = keyed.agg(F.max(F.length("needle"))).first()[0] or 0
    sc = pages.sparkSession.sparkContext

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.array([int(next(_window_hashes(_codes(k), [len(k)]))[1][0]) for k in batch.column(0).to_pylist()], dtype=np.uint64)
            at = np.concatenate(list(_bits(h))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], names=["w", "bit"])

    def table(keys: DataFrame):
        words = keys.distinct().mapInArrow(hashed, "w long, bit long").groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
        bits = np.zeros(TABLE_BITS // 64, dtype=np.int64)
        bits[words["w"].to_numpy()] = words["bits"].to_numpy()
        return sc.broadcast(bits.view(np.uint64))

    every, longer = table(keyed.select("key")), table(keyed.where(F.length("needle") > KEY).select("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def among(shared, h: np.ndarray) -> np.ndarray:
            at = np.arange(len(h))
            for x in _bits(h):
                x = x[at]
                at = at[((shared.value[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1)).astype(bool)]
            return at

        for batch in batches:
            slugs, keys, texts = [], [], []
            for slug, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = set()
                for k, h in _window_hashes(_codes(text), lengths):
                    hit = among(every, h)
                    found |= {(text[i : i + k],) * 2 for i in hit.tolist()}
                    if k == KEY and longest > KEY:
                        found |= {(text[i : i + k], text[i : i + longest]) for i in hit[among(longer, h[hit])].tolist()}
                slugs += [slug] * len(found)
                keys += [k for k, _ in found]
                texts += [t for _, t in found]
            yield pa.RecordBatch.from_arrays([pa.array(slugs, pa.string()), pa.array(keys, pa.string()), pa.array(texts, pa.string())], names=["slug", "key", "text"])

    held = pages.where("markdown <> ''").select("slug", "markdown").mapInArrow(run, "slug string, key string, text string")
    held = held.groupBy("key", "text").agg(F.min("slug").alias("low"), F.max("slug").alias("high"))
    return keyed.join(held, "key").where(F.startswith("text", "needle")).groupBy("needle").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def orphans(pages: DataFrame) -> DataFrame:
    """(slug): pages of which no other page holds the slug or the first twenty characters of the title.

    Each different needle is looked up once, however many pages share it; a page is held by another one if the lowest or the
    highest slug that holds its needle is not its own. The empty needle is held by every page.
    """
    ends = pages.select("slug", F.explode(F.array(F.col("slug"), F.substring("title", 1, 20))).alias("needle")).where("needle is not null").distinct()
    every = pages.agg(F.lit("").alias("needle"), F.min("slug").alias("low"), F.max("slug").alias("high"))
    at = holders(pages, ends.select("needle")).unionByName(every)
    held = ends.join(at, "needle").where((F.col("low") != F.col("slug")) | (F.col("high") != F.col("slug"))).select("slug").distinct()
    return pages.select("slug").distinct().join(held, "slug", "left_anti")


def lint(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(slug, lint_status, broken, expired, orphan) of every page: error with a broken link, warn with another issue, else ok."""
    b = broken_links(pages).groupBy("slug").agg(F.count(F.lit(1)).alias("broken"))
    status = docs.select(F.col("doc_id").alias("document_id"), (F.col("effectiveness_status") == "het_hieu_luc").alias("expired"))
    o = orphans(pages).withColumn("orphan", F.lit(True))
    j = pages.select("slug", "document_id").join(status, "document_id", "left").join(b, "slug", "left").join(o, "slug", "left")
    n, e, r = F.coalesce("broken", F.lit(0)), F.coalesce("expired", F.lit(False)), F.coalesce("orphan", F.lit(False))
    return j.select("slug", F.when(n > 0, "error").when(e | r, "warn").otherwise("ok").alias("lint_status"), n.alias("broken"), e.alias("expired"), r.alias("orphan"))


def status(pages: DataFrame) -> DataFrame:
    """One row of counts over (reviewed, lint_status)."""
    return pages.agg(F.count(F.lit(1)).alias("wiki_pages"), F.count_if("reviewed").alias("reviewed"), (F.count(F.lit(1)) - F.count_if("reviewed")).alias("pending_review"), F.count_if(F.col("lint_status") != "ok").alias("lint_issues"))


def vault_index(pages: DataFrame, n: int = 100) -> DataFrame:
    """One row (text): the newest pages as links."""
    top = pages.orderBy(F.desc("created_at"), "slug").limit(n)
    line = F.concat(F.lit("- [[tom-tat/"), F.col("slug"), F.lit("|"), F.substring("title", 1, 80), F.lit("]] ("), F.col("doc_number"), F.lit(")"))
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("k"), "slug", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
