"""Chat sessions as append-only tables (session_id, user_id, created_at[, updated_at, summary, summarised]) and (session_id, seq, role, content, timestamp)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from vanthu.operators import models

ROLES = ("user", "assistant", "system")
SPOKEN = ("user", "assistant")


def create_sessions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``existing`` with the sessions of ``new`` whose id is not there."""
    return existing.unionByName(fresh_sessions(existing, new), allowMissingColumns=True)


def fresh_sessions(existing: DataFrame, new: DataFrame) -> DataFrame:
    return new.dropDuplicates(["session_id"]).join(existing.select("session_id"), "session_id", "left_anti")


def valid_messages(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """The messages of ``new`` that can be kept: a known role, content, and a session that is there."""
    return new.where(F.col("role").isin(*ROLES) & F.col("content").isNotNull()).join(sessions.select("session_id").distinct(), "session_id", "left_semi")


def sessions_of(sessions: DataFrame, messages: DataFrame, user: str) -> DataFrame:
    """A user's sessions with their summary, newest change first."""
    last = messages.groupBy("session_id").agg(F.max("timestamp").alias("last"))
    rows = sessions.where(F.col("user_id") == user).join(last, "session_id", "left")
    return rows.select("session_id", "user_id", "created_at", F.greatest("created_at", "updated_at", "last").alias("updated_at"), "summary").orderBy(F.desc("updated_at"), "session_id")


def sessions_by_update(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with their last message's time and count, newest first."""
    m = messages.groupBy("session_id").agg(F.max("timestamp").alias("last"), F.count_if(F.col("role").isin(*SPOKEN)).alias("messages"))
    return sessions.join(m, "session_id", "left").select("session_id", F.coalesce("last", "created_at").alias("updated_at"), F.coalesce("messages", F.lit(0)).alias("messages")).orderBy(F.desc("updated_at"), "session_id")


def messages_of(messages: DataFrame, session_id: str, limit: int | None = None) -> DataFrame:
    """A session's messages in order of time; a limit gives the oldest."""
    rows = messages.where(F.col("session_id") == session_id).orderBy("timestamp", "seq")
    return rows.limit(limit) if limit else rows


def last_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` user and assistant messages of every session, with their position in time order."""
    m = messages.where(F.col("role").isin(*SPOKEN))
    ranked = m.withColumn("back", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("timestamp"), F.desc("seq"))))
    return ranked.where(F.col("back") <= n).drop("back")


def summary_due(messages: DataFrame) -> DataFrame:
    """(session_id, seq, n): messages at which a summary falls due: four or more, and four since the last one, so every fourth."""
    m = messages.where(F.col("role").isin(*SPOKEN))
    counted = m.withColumn("n", F.row_number().over(W.partitionBy("session_id").orderBy("timestamp", "seq")))
    return counted.where(F.col("n") % 4 == 0).select("session_id", "seq", "n")


def due_now(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, n, last, due): messages so far, and whether a summary is due.

    ``summarised`` holds the count at the last summary of this run. Where it is null although there is a summary, as after a
    restart, all but the last two messages count as summarised.
    """
    n = messages.where(F.col("role").isin(*SPOKEN)).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    last = F.coalesce("summarised", F.when(F.coalesce("summary", F.lit("")) != "", F.greatest(F.lit(0), F.col("n") - 2)).otherwise(0))
    rows = sessions.join(n, "session_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("session_id", "n", last.cast("long").alias("last")).withColumn("due", (F.col("n") >= 4) & (F.col("n") - F.col("last") >= 4))


def summarise(sessions: DataFrame, messages: DataFrame, model: models.Model | None) -> DataFrame:
    """``sessions`` with the summaries that were due and that the model wrote; as they are without a model."""
    due = due_now(sessions, messages).where("due")
    told = models.ask(transcript(messages).join(due, "session_id", "left_semi"), "session_id", "transcript", "Tóm tắt cuộc hội thoại", model).where("coalesce(trim(answer), '') <> ''")
    both = sessions.join(told.select("session_id", F.trim("answer").alias("_new")), "session_id", "left").join(due.select("session_id", F.col("n").alias("_n")), "session_id", "left")
    written = F.col("_new").isNotNull()
    return both.withColumns({"summary": F.coalesce("_new", "summary"), "summarised": F.when(written, F.col("_n")).otherwise(F.col("summarised")), "updated_at": F.when(written, F.current_timestamp()).otherwise(F.col("updated_at"))}).drop("_new", "_n")


def transcript(messages: DataFrame) -> DataFrame:
    """(session_id, transcript): one line for each message, cut at 300 characters."""
    line = F.concat(F.when(F.col("role") == "user", "Người dùng").otherwise("Trợ lý AI"), F.lit(": "), F.substring("content", 1, 300), F.lit("\n"))
    return messages.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "seq", line.alias("l")))), lambda x: x["l"]), "").alias("transcript"))


def delete_sessions(sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions of ``gone``."""
    return sessions.join(gone, "session_id", "left_anti"), messages.join(gone, "session_id", "left_anti")
