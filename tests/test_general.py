"""Problems 3 and 5 on small tables with known results, and their defined cases."""

from pyspark.sql import functions as F

from vanthu.operators import hierarchy, references

SECTIONS = "id long, document_id long, parent_id long, section_type string, number string, title string, extra int"


def sections(spark, rows):
    return spark.createDataFrame([(i, 1, p, t, n, None, 0) for i, p, t, n in rows], SECTIONS)


def test_faults_and_paths(spark):
    rows = [(9, None, "phan", "I"), (1, 9, "dieu", "1"), (2, 1, "khoan", None), (3, 4, "dieu", "x"), (4, 3, "dieu", "y"), (5, 3, "khoan", "1"), (6, 77, "dieu", "7"), (7, 6, "khoan", "1"), (8, 8, "dieu", "8"), (2, 1, "khoan", None)]
    df = sections(spark, rows)
    assert {(r.id, r.fault) for r in hierarchy.faults(df).collect()} == {(3, "on_cycle"), (4, "on_cycle"), (8, "on_cycle"), (5, "below_cycle"), (6, "missing_parent")}
    nodes, below = hierarchy.hierarchy(df), hierarchy.descendants(df)
    got = {r.id: r for r in nodes.collect()}
    assert got[2].path == "phan I/dieu 1/khoan" and got[2].depth == 3 and got[2].root_id == 9 and got[9].n_descendants == 2
    assert got[7].rooted is False and got[7].path == "dieu 7/khoan 1" and set(got) == {9, 1, 2, 6, 7}
    assert {(r.id, r.descendant_id) for r in below.collect()} == {(9, 1), (9, 2), (1, 2), (6, 7)}


def test_deep_chain_and_long_cycle(spark):
    chain = [(i, i - 1 if i else None, "dieu", str(i)) for i in range(70)]
    ring = [(100 + i, 100 + (i + 1) % 13, "dieu", "r") for i in range(13)] + [(200, 105, "dieu", "b"), (201, 200, "dieu", "b")]
    df = sections(spark, chain + ring)
    faults = {r.id: r.fault for r in hierarchy.faults(df).collect()}
    assert faults == {100 + i: "on_cycle" for i in range(13)} | {200: "below_cycle", 201: "below_cycle"}
    nodes, below = hierarchy.hierarchy(df), hierarchy.descendants(df)
    assert {r.id: r.depth for r in nodes.collect()} == {i: i + 1 for i in range(70)}
    assert below.count() == 70 * 69 // 2


def test_empty_sections(spark):
    df = sections(spark, [])
    assert hierarchy.faults(df).count() == 0
    assert hierarchy.hierarchy(df).count() == hierarchy.descendants(df).count() == 0


def test_many_children_and_a_long_chain(spark, monkeypatch):
    """One parent of 10^5 children and a chain of 5,000, with blocks far smaller than the tours."""
    monkeypatch.setattr(hierarchy, "TOP_LEVEL", 9)
    wide, deep = 100_000, 5_000
    rows = spark.range(wide + 1).select("id", F.when(F.col("id") > 0, 0).cast("long").alias("parent_id"), F.lit("d").alias("section_type"), F.lit(None).cast("string").alias("number"))
    chain = spark.range(200_000, 200_000 + deep).select("id", F.when(F.col("id") > 200_000, F.col("id") - 1).alias("parent_id"), F.lit("k").alias("section_type"), F.lit(None).cast("string").alias("number"))
    df = rows.unionByName(chain)
    got = {r.root_id: r for r in hierarchy.hierarchy(df).groupBy("root_id").agg(F.max("depth").alias("depth"), F.max("n_descendants").alias("n"), F.max("exit").alias("exit"), F.count_distinct("entry").alias("entries"), F.max(F.length("path")).alias("path")).collect()}
    assert (got[0].depth, got[0].n, got[0].exit, got[0].entries, got[0].path) == (2, wide, 2 * wide + 1, wide + 1, 3)
    assert (got[200_000].depth, got[200_000].n, got[200_000].exit, got[200_000].entries, got[200_000].path) == (deep, deep - 1, 2 * deep - 1, deep, 2 * deep - 1)
    below = hierarchy.descendants(df.where("id < 200300"))
    assert below.agg(F.count(F.lit(1)), F.count_distinct("id", "descendant_id")).first() == (wide + 300 * 299 // 2,) * 2


def frames(spark, documents, deletions, chunks, relations):
    ts = lambda rows, at: [tuple(f"2024-{v:02d}-05 00:00:00" if k == at and v else v for k, v in enumerate(r)) for r in rows]
    make = lambda rows, schema, col: spark.createDataFrame(rows, schema).withColumn(col, __import__("pyspark.sql.functions", fromlist=["x"]).col(col).cast("timestamp_ntz"))
    return (
        make(ts(documents, 2), "doc_id long, doc_number string, created_at string", "created_at"),
        make(ts(deletions, 2), "doc_id long, doc_number string, deleted_at string", "deleted_at"),
        make(ts(chunks, 2), "id long, document_id long, processed_at string", "processed_at"),
        make(ts(relations, 3), "id long, target_doc_id long, target_doc_number string, created_at string", "created_at"),
    )


def test_references(spark):
    got = references.unresolved_references(
        *frames(
            spark,
            [(1, "15/QĐ-A", 3), (2, None, 1)],
            [(5, "9/TT-B", 1)],
            [(10, 1, 1), (11, 1, 4), (12, 5, 2), (13, 6, 2), (14, None, 2), (13, 6, 2), (15, 6, None)],
            [(20, None, "15/qđ-a ;", 6), (21, None, "9 /ТТ-В", 6), (22, None, None, 6), (23, 2, "9/TT-B", 6), (24, None, "15/QĐ-A", 1), (25, None, "8/X", 1)],
        )
    )
    assert {tuple(r) for r in got.collect()} == {
        ("chunks", "document_id", 10, "2024-01", "late"), ("chunks", "document_id", 12, "2024-02", "deleted"), ("chunks", "document_id", 13, "2024-02", "missing"), ("chunks", "document_id", 15, None, "missing"),
        ("doc_relations", "target_doc_number", 21, "2024-06", "deleted"), ("doc_relations", "target_doc_number", 24, "2024-01", "late"), ("doc_relations", "target_doc_number", 25, "2024-01", "missing"),
    }
