import pytest

from oracle import same
from vanthu.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, small, name):
    same(spark, small, QUERIES[name], ORACLE_SQL[name])


def rows_of(spark, small, name):
    return QUERIES[name](spark, small).collect()


def test_forms_are_stable_and_tell_what_was_found(spark, small):
    """A canonical text is its own form, and the texts that changed are those found."""
    from pyspark.sql import functions as F

    from vanthu.llm import lookalike

    first = QUERIES["p1_canonical"](spark, small)
    again = lookalike.canonical(first.select("table_name", "id", "text"), lookalike.Forms(lookalike.static_mapping(), frozenset()))
    assert again.where("changed").count() == 0
    assert {tuple(r) for r in first.where("changed").select("table_name", "id").distinct().collect()} == {tuple(r) for r in rows_of(spark, small, "p1_found")} != set()
    assert first.where(F.col("text").rlike("[\u200b\xa0\uff01-\uff5e]")).count() == 0


def test_every_text_has_paragraphs(spark, small):
    """Each text with words comes out in paragraphs numbered in order; each kind of noise occurs."""
    texts = spark.read.parquet(f"{small}/documents.parquet").where("trim(content_markdown) <> ''").select("doc_id").distinct().count()
    rows = QUERIES["p4_paragraphs"](spark, small).where("table_name = 'documents'")
    assert rows.select("id").distinct().count() == texts and rows.groupBy("id", "paragraph").count().where("count > 1").count() == 0
    assert {r.noise for r in rows_of(spark, small, "p4_found")} == {"line_hyphen", "misread", "running_header", "page_number"}


def test_groups_hold_the_pairs(spark, small):
    """Both records of every pair are in one group, which bears its lowest id, and links counts the versions each meets."""
    group = {(r.table_name, r.id): (r.group_id, r.links) for r in rows_of(spark, small, "p6_groups")}
    pairs = rows_of(spark, small, "p6_found")
    assert pairs and all(group[r.table_name, r.id_a][0] == group[r.table_name, r.id_b][0] for r in pairs)
    assert {(r.table_name, i) for r in pairs for i in (r.id_a, r.id_b)} == set(group)
    assert all(g <= i for (_, i), (g, _) in group.items())


def test_ids_and_containers(spark, small):
    ids = {r.doc_id: r.ids for r in rows_of(spark, small, "p7_ids")}
    containers = rows_of(spark, small, "p8_containers")
    held = {}
    for r in containers:
        held[r.doc_id] = held.get(r.doc_id, 0) + r.token_end - r.token_start
    assert held == {i: len(x) for i, x in ids.items() if x}
    report = rows_of(spark, small, "p8_report")[0]
    assert report.tokens == sum(held.values()) and report.containers == len({r.container for r in containers})


def test_shares_of_cut_texts(spark, small):
    cut = {r.doc_id for r in rows_of(spark, small, "p9_found")}
    by = rows_of(spark, small, "p9_by_source")
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source").distinct().collect()
    assert {r.source: (r.documents, r.cut) for r in by} == {s: (sum(d.source == s for d in docs), sum(d.source == s and d.doc_id in cut for d in docs)) for s in {d.source for d in docs}} and cut
