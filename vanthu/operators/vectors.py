"""An inverted-file index of vectors: every vector lies in the cell of its nearest centre, a search looks into the nearest cells.

The centres are fitted on a bounded sample (``SAMPLE_MOST`` vectors, by a hash of their ids, so the same rows each time);
every row is indexed. Cells are kept sorted by centre, so a search reads the pages of its cells only; the vectors read are
scored exactly. Recall against brute force depends on how many cells are looked into: ``probes_for`` tells how many a wanted recall
needs, ``recall`` measures it on other queries.

Defined cases: vectors that are null, empty or of another length than the first are left out; a repeated id keeps each of its
vectors; an index of no vectors finds nothing; ties go to the lower id.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from vanthu.runtime import cut, scratch

SAMPLE_MOST = 50_000  # vectors on which the centres are fitted
CELLS_MOST = 4_096  # centres, so at most a few megabytes are broadcast
ROUNDS, SEED = 12, 7


class VectorIndex(NamedTuple):
    """``rows`` (cell, vec_id, embedding) sorted by cell, and the centres."""

    rows: DataFrame
    centres: np.ndarray


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of ``sample`` by Lloyd's rounds on the dot product; an empty cell takes a vector far from all centres."""
    rng = np.random.default_rng(SEED)
    centres = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(ROUNDS):
        score = sample @ centres.T
        cell = score.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        empty = np.flatnonzero(np.bincount(cell, minlength=cells) == 0)
        if len(empty):
            sums[empty] = sample[np.argsort(score.max(1))[: len(empty)]]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float32).reshape(len(column), width)


def build(vectors: DataFrame, cells: int | None = None) -> VectorIndex:
    """The index of (vec_id, embedding), written to the shared folder; by default the root of the number of vectors as cells."""
    spark = vectors.sparkSession
    some = vectors.where("size(embedding) > 0")
    n, width = some.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    good = some.where(F.size("embedding") == (width or 0)).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    share = max(1, -(-n // (SAMPLE_MOST // 2)))
    rows = good.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0).select("embedding").limit(SAMPLE_MOST).toArrow().column(0).combine_chunks() if n else []
    sample = _matrix(rows, width) if len(rows) else np.zeros((0, width or 1), np.float32)
    cells = min(len(sample), cells or min(CELLS_MOST, max(1, round(n**0.5))))
    centres = fit(sample, cells) if cells else np.zeros((0, width or 1), np.float32)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = (_matrix(batch.column(1), width) @ shared.value.T).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1)], names=["cell", "vec_id", "embedding"])

    path = scratch(spark, "vectors")
    placed = good.mapInArrow(assign, "cell int, vec_id long, embedding array<float>")
    placed.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id").write.option("parquet.block.size", 16 << 20).parquet(path)
    return VectorIndex(spark.read.schema("cell int, vec_id long, embedding array<float>").parquet(path), centres)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, vec_id, score): the best ``k`` of the vectors in the ``probes`` nearest cells of each query (query_id, embedding).

    Queries meet vectors by cell, an equi-join; both are scored in the JVM and cut to k by a window for each query.
    """
    if not len(index.centres):
        return queries.select("query_id", F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    shared, width = queries.sparkSession.sparkContext.broadcast(index.centres), index.centres.shape[1]
    kind = dict(queries.dtypes)["query_id"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best = np.argsort(-(_matrix(batch.column(1), width) @ shared.value.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                at = pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(best.ravel()), batch.column(0).take(at), batch.column(1).take(at)], names=["cell", "query_id", "q"])

    asked = queries.where(F.size("embedding") == width).select("query_id", F.col("embedding").cast("array<float>")).mapInArrow(near, f"cell int, query_id {kind}, q array<float>")
    dot = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    scored = index.rows.join(cut(asked), "cell").select("query_id", "vec_id", F.round(dot, 6).alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def _nearest(index: VectorIndex, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id) by brute force: the queries, one cell with all vectors."""
    whole = VectorIndex(vectors.select(F.lit(0).alias("cell"), "vec_id", "embedding"), index.centres[:1])
    return search(whole, queries, k, 1).select("query_id", "vec_id")


def probes_for(index: VectorIndex, vectors: DataFrame, k: int, target: float, one_in: int = 20, left: int = 10) -> int:
    """How many cells must be looked into for a share ``target`` of the ``k`` nearest, told by the queries whose id leaves ``left``.

    For every neighbour that brute force finds, the place of its cell among the query's nearest cells is how many are needed.
    """
    shared, width = vectors.sparkSession.sparkContext.broadcast(index.centres), index.centres.shape[1]
    queries = cut(vectors.where(F.col("vec_id") % one_in == left).select(F.col("vec_id").alias("query_id"), "embedding"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = _matrix(batch.column(1), width) @ shared.value.T
                own = score[np.arange(len(score)), np.asarray(batch.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array((score > own[:, None]).sum(1) + 1)], names=["place"])

    wanted = _nearest(index, vectors, queries, k).join(index.rows.select("vec_id", "cell"), "vec_id").join(queries, "query_id")
    counts = {r["place"]: r["n"] for r in wanted.select("cell", F.col("embedding").cast("array<float>")).mapInArrow(place, "place long").groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, so_far = sum(counts.values()), 0
    for p in sorted(counts):
        so_far += counts[p]
        if so_far >= target * total:
            return p
    return max(1, len(index.centres))


def recall(index: VectorIndex, vectors: DataFrame, k: int, probes: int, one_in: int = 20) -> DataFrame:
    """(queries, wanted, found, recall) against brute force, the vectors whose id ``one_in`` divides as queries against all."""
    queries = cut(vectors.where(F.col("vec_id") % one_in == 0).select(F.col("vec_id").alias("query_id"), "embedding"))
    got = search(index, queries, k, probes).select("query_id", "vec_id")
    both = _nearest(index, vectors, queries, k).join(got.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found")).withColumn("recall", F.round(F.col("found") / F.col("wanted"), 4))
