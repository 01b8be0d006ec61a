import random

from vanthu.operators import wiki
from vanthu.plans import registry

DOC = "doc_id long, doc_number string, doc_type string, title string, issuing_date string, issuing_authority string, effectiveness_status string, effective_date string, created_at string, content_markdown string"
CHUNK = "id long, document_id long, chunk_index int, dieu int, text string"


def doc(i, number, content, created="2026-01-01"):
    return (i, number, "luat", f"Tiêu đề {i}", "2026", "Bộ", "con_hieu_luc", None, created, content)


def test_documents_without_content_have_their_chunks(spark):
    docs = spark.createDataFrame([doc(1, "1", None), doc(2, "2", ""), doc(3, "3", "riêng"), doc(4, "4", None)], DOC)
    chunks = spark.createDataFrame([(10, 1, 1, 0, "sau"), (11, 1, 0, 0, "trước"), (10, 1, 1, 0, "sau"), (12, 2, 0, 0, "hai"), (13, 3, 0, 0, "không")], CHUNK)
    got = {r.document_id: r.summary.split("Nội dung: ")[1] for r in wiki.compile_wiki(docs, chunks).collect()}
    assert got == {1: "trước sau...", 2: "hai...", 3: "riêng...", 4: "..."}


def test_one_page_for_each_slug(spark):
    docs = spark.createDataFrame([doc(1, "7", "cũ", "2026-01-01"), doc(5, "7", "mới", "2026-02-02"), doc(2, "8", "khác")], DOC)
    rows = {r.slug: r for r in wiki.compile_wiki(docs, spark.createDataFrame([], CHUNK)).collect()}
    assert set(rows) == {"7-luat", "8-luat"}
    page = rows["7-luat"]
    assert (page.document_id, page.created_at, page.title, page.reviewed) == (1, "2026-01-01", "Tiêu đề 5", False) and "mới" in page.markdown


def test_key_points_of_the_first_fifteen_at_any_index(spark):
    text = lambda k: f"Nội dung số {k:03d} của khoản\n" + "x" * 30
    rows = [(k, 1, 40 + k, 3, text(k)) for k in range(20)] + [(100 + k, 2, None if k == 0 else 7000 + k, 0 if 0 < k < 14 else 4, text(k)) for k in range(17)]
    got = {r.document_id: r.key_points for r in wiki.key_points(spark.createDataFrame(rows, CHUNK)).collect()}
    assert got[1] == [f"Điều 3: Nội dung số {k:03d} của khoản" for k in range(5)]
    assert got[2] == [f"Điều 4: Nội dung số {k:03d} của khoản" for k in (0, 14)]


def test_orphans_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        title = rng.choice(["Quyết định về việc phê duyệt", "Quyết định về việc phân", "", "Nghị", f"Công văn số {i} của Bộ"]) + rng.choice(["", f" {i % 40}"])
        text = rng.choice(["", f"xem trang-{rng.randrange(300)}-{'x' * 30} và", f"# {title} 😀", "Quyết định về việc p", f"trang-{rng.randrange(300)}-" + "x" * 29])
        rows.append((f"trang-{i}-{'x' * rng.choice([1, 30])}", title, text))
    want = {s for s, t, _ in rows if not any(o != s and (s in md or t[:20] in md) for o, _, md in rows)}
    pages = spark.createDataFrame(rows, "slug string, title string, markdown string")
    assert {r.slug for r in wiki.orphans(pages).collect()} == want and 0 < len(want) < 300
    assert wiki.orphans(pages.limit(0)).count() == 0
    assert [r.slug for r in wiki.orphans(spark.createDataFrame([("một", "", "một")], pages.schema)).collect()] == ["một"]


def test_lint_of_compiled_pages(spark, small):
    q = registry.queries()
    pages = {r.slug: r for r in q["q_compile_wiki"](spark, small).collect()}
    got = {r.slug: r for r in q["q_lint_pages"](spark, small).collect()}
    assert set(got) == set(pages)
    for s, p in pages.items():
        assert got[s].orphan == (not any(o != s and (s in x.markdown or p.title[:20] in x.markdown) for o, x in pages.items()))
    assert q["q_pages_status"](spark, small).first().wiki_pages == len(pages)
