"""The engine's own tables: schemas, additive migration, and commits that change several tables at once.

A table is a list of Parquet folders; which ones, a numbered manifest says. A commit writes its folders first and then one
new manifest, so readers see all of it or nothing, and a job that dies in between leaves only folders that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Columns of each table. A column added here is null in the rows written before.
SCHEMAS = {
    "documents": "doc_id long, doc_number string, title string, doc_type string, issuing_date string, effective_date string, effectiveness_status string, file_hash string, content_markdown string, source_url string, issuing_authority string, summary string, created_at timestamp",
    "doc_sections": "id long, document_id long, parent_id long, section_type string, number string, title string, content string",
    "chunks": "id long, document_id long, section_id long, chunk_index int, text string, token_count int, dieu int, khoan int, document_number string",
    "doc_relations": "source_doc_id long, target_doc_id long, target_doc_number string, relation_type string, source_section string, detected_by string, confidence double",
    "embeddings": "vec_id long, embedding array<float>",
    "wiki_pages": "slug string, title string, document_id long, doc_number string, doc_type string, issuing_date string, issuing_authority string, effectiveness_status string, summary string, key_points array<string>, legal_fields array<string>, suggested_qa array<struct<question:string,answer:string>>, entities struct<authorities:array<string>,signers:array<string>,dates:struct<issuance:string,effective:string>>, confidence double, created_by_model string, created_at timestamp, updated_at timestamp, markdown string, reviewed boolean, lint_status string",
    "chat_sessions": "session_id string, user_id string, created_at timestamp, updated_at timestamp, summary string, summarised long",
    "chat_messages": "message_id string, session_id string, role string, content string, timestamp timestamp, seq long, tokens_used int",
    "ingest_status": "file_hash string, file_name string, step int, state string, error_message string, document_id long",
}


class Conflict(RuntimeError):
    """Another commit came first; the tables are as it left them."""


class Store:
    """The tables under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = self._path("")
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        at = self._path("_commits")
        names = [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self.fs.open(self._path(f"_commits/{version:09d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a commit, the last one by default; empty if it has no rows yet."""
        parts = self.manifest(version).get(name, [])
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.folder}/{p}" for p in parts])

    def shaped(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` with exactly the table's columns; those it lacks are null, others are left out."""
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        known = rows.select(*[rows[c].cast(t) for c, t in empty.dtypes if c in rows.columns])
        return empty.unionByName(known, allowMissingColumns=True)

    def commit(self, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None) -> int:
        """Appends to and replaces tables in one step; returns the commit's number. Nothing changes if any write fails."""
        before = self.version()
        tables = self.manifest(before)
        written: list[str] = []
        try:
            for keep, changes in ((True, append or {}), (False, replace or {})):
                for name, rows in changes.items():
                    part = f"{name}/{uuid.uuid4().hex}"
                    written.append(part)
                    self.shaped(name, rows).write.parquet(f"{self.folder}/{part}")
                    tables[name] = [*(tables.get(name, []) if keep else []), part]
            self._publish(before + 1, tables)
        except BaseException:
            for part in written:
                self.fs.delete(self._path(part), True)
            raise
        return before + 1

    def _publish(self, version: int, tables: dict[str, list[str]]) -> None:
        draft, final = self._path(f"_commits/.{uuid.uuid4().hex}"), self._path(f"_commits/{version:09d}.json")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise Conflict(f"commit {version} is taken")

    def vacuum(self) -> int:
        """Deletes the folders that the last commit does not name and all commits before it; returns how many folders went."""
        last = self.version()
        named, gone = {p for parts in self.manifest(last).values() for p in parts}, 0
        for name in SCHEMAS:
            if self.fs.exists(self._path(name)):
                for f in self.fs.listStatus(self._path(name)):
                    if f"{name}/{f.getPath().getName()}" not in named:
                        self.fs.delete(f.getPath(), True)
                        gone += 1
        for v in range(1, last):
            self.fs.delete(self._path(f"_commits/{v:09d}.json"), False)
        return gone
