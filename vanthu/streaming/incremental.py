"""Incremental work with Structured Streaming: ingest of new files, new relations and pages, session memory, event windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vanthu.operators import relations, wiki
from vanthu.runtime import cut
from vanthu.sources.store import Store


def new_rows(spark: SparkSession, schema, glob: str, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs ``step`` on all rows of files not seen before, then stops; the checkpoint takes the place of processed flags."""
    stream = spark.readStream.schema(schema).parquet(glob)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def reset(spark: SparkSession, checkpoint: str) -> None:
    """Forgets what an incremental job has seen: its next run takes all files again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def store_relations(store: Store, docs: DataFrame) -> int:
    """Adds the relations that ``docs`` state and that are not stored yet, with their targets among the stored documents; returns how many."""
    found = relations.resolve(relations.extract(docs), store.read("documents").select("doc_id", "doc_number"))
    fresh = cut(relations.unseen(found, store.read("doc_relations")).withColumns({"detected_by": F.lit("regex"), "confidence": F.lit(1.0)}))
    n = fresh.count()
    if n:
        store.commit(append={"doc_relations": fresh})
    return n


def store_pages(store: Store, docs: DataFrame, **more) -> int:
    """Compiles the pages of ``docs`` and merges them by slug with the stored ones; returns how many documents were compiled."""
    compiled = cut(wiki.compile_wiki(docs, store.read("chunks"), **more).drop("reviewed"))
    old = store.read("wiki_pages")
    columns = [c for c in compiled.columns if c != "slug"]
    merged = wiki.upsert(old.select("slug", *columns, "reviewed"), compiled)
    lint = old.select("slug", "lint_status")
    store.commit(replace={"wiki_pages": merged.join(lint, "slug", "left").withColumns({"lint_status": F.coalesce("lint_status", F.lit("ok")), "updated_at": F.current_timestamp()})})
    return docs.count()


def relations_of_new(spark: SparkSession, schema, glob: str, store: Store, checkpoint: str) -> None:
    """Relations of all documents in files not seen before. A batch that is taken again adds nothing, since its relations are there."""
    new_rows(spark, schema, glob, lambda batch, _: store_relations(store, batch), checkpoint)


def pages_of_new(spark: SparkSession, schema, glob: str, store: Store, checkpoint: str, **more) -> None:
    """Pages of all documents in files not seen before. A batch that is taken again gives the same pages."""
    new_rows(spark, schema, glob, lambda batch, _: store_pages(store, batch, **more), checkpoint)


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of (ts, event_type, value) by window; later events than ``late`` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session_memory(messages: DataFrame) -> DataFrame:
    """(session_id, n, due): for every micro-batch of (session_id, role) the messages so far and whether a summary is due.

    State: messages so far and at the last summary. Due: four or more, and four more than at the last one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0)
        n += sum(int(b["role"].isin(["user", "assistant"]).sum()) for b in batches)
        due = n >= 4 and n - last >= 4
        state.update((n, n if due else last))
        yield pd.DataFrame({"session_id": [key[0]], "n": [n], "due": [due]})

    return messages.groupBy("session_id").applyInPandasWithState(step, "session_id long, n long, due boolean", "n long, last long", "update", GroupStateTimeout.NoTimeout)


def sse(events: DataFrame) -> DataFrame:
    """(n, data): server-sent event lines of (n, type, node, content), with the closing line."""
    rows = events.select("n", F.concat(F.lit("data: "), F.to_json(F.struct("type", "node", "content")), F.lit("\n\n")).alias("data"))
    end = events.agg((F.coalesce(F.max("n"), F.lit(0)) + 1).alias("n")).select("n", F.lit("data: [DONE]\n\n").alias("data"))
    return rows.unionByName(end)
