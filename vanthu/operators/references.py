"""Problem 5: references to records that do not exist.

Method: a reference is a composite key of which any part may be null. References are grouped by their null mask, each
mask has one declared match rule on its non-null columns, and each group is joined on those columns only.

Defined cases: a reference whose key columns are all null is no reference; repeated rows count once (by id); a null
reference time cannot be late and has a null period; an empty number refers to nothing and is ``missing``; extra
columns of the inputs are ignored; empty inputs give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from vanthu.functions.agree import number_key_udf


@dataclass(frozen=True)
class Rule:
    """The match rule of one null mask: columns set (others are null or ignored), and the key that is compared."""

    column: str  # the reference column reported
    key: str  # the comparison key in the target tables: doc_id or number_key


def targets(documents: DataFrame, deletions: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """For each comparison key the living targets with their earliest time, and the deleted keys."""
    docs = documents.select("doc_id", number_key_udf("doc_number").alias("number_key"), "created_at")
    gone = deletions.select("doc_id", number_key_udf("doc_number").alias("number_key"))
    out = {}
    for key in ("doc_id", "number_key"):
        alive = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min("created_at").alias("_born"), F.lit(True).alias("_alive"))
        dead = gone.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.lit(True).alias("_dead")).distinct()
        out[key] = (alive, dead)
    return out


def _resolve(refs: DataFrame, alive: DataFrame, dead: DataFrame) -> DataFrame:
    """Unresolved rows of ``refs`` (ref_table, ref_column, ref_id, _k, _at) with their state.

    The first join keeps only references without a living target or with a later one, so the second sees few rows. Hot
    keys are split by the adaptive skew join: the reference side is the outer one.
    """
    first = refs.join(alive, "_k", "left")
    late = F.col("_alive") & (F.col("_born") > F.col("_at"))
    open_refs = first.where(F.col("_alive").isNull() | F.coalesce(late, F.lit(False)))
    state = F.when(F.col("_alive"), "late").when(F.col("_dead"), "deleted").otherwise("missing")
    return open_refs.join(dead, "_k", "left").select(
        "ref_table", "ref_column", "ref_id", F.substring(F.col("_at").cast("string"), 1, 7).alias("period"), state.alias("state")
    )


def by_mask(refs: DataFrame, columns: list[str]) -> Column:
    """The null mask of a reference: '1' where a column is set, in the order of ``columns``."""
    return F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])


def find_unresolved(refs: DataFrame, table_name: str, id_col: str, time_col: str, columns: list[str], rules: dict[str, Rule], keys: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame | None:
    """Unresolved references of one table.

    ``rules`` maps null masks to match rules; a mask without a rule is no reference. Masks with the same rule share one join.
    """
    base = refs.select(F.col(id_col).alias("ref_id"), F.col(time_col).alias("_at"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)]).withColumn("_mask", by_mask(refs, [f"_c{i}" for i in range(len(columns))]))
    grouped: dict[Rule, list[str]] = {}
    for mask, rule in rules.items():
        grouped.setdefault(rule, []).append(mask)
    result = None
    for rule, masks in grouped.items():
        value = F.col(f"_c{columns.index(rule.column)}")
        key = number_key_udf(value) if rule.key == "number_key" else value
        part = base.where(F.col("_mask").isin(masks)).select(F.lit(table_name).alias("ref_table"), F.lit(rule.column).alias("ref_column"), "ref_id", "_at", key.alias("_k"))
        found = _resolve(part, *keys[rule.key])
        result = found if result is None else result.unionByName(found)
    return result


def unresolved_references(documents: DataFrame, deletions: DataFrame, chunks: DataFrame, relations: DataFrame) -> DataFrame:
    """(ref_table, ref_column, ref_id, period, state), one row for each unresolved reference.

    Relations compare their target id where it is set, else their target number; chunks compare their document id.
    """
    keys = targets(documents, deletions)
    rel_rules = {"11": Rule("target_doc_id", "doc_id"), "10": Rule("target_doc_id", "doc_id"), "01": Rule("target_doc_number", "number_key")}
    rel = find_unresolved(relations, "doc_relations", "id", "created_at", ["target_doc_id", "target_doc_number"], rel_rules, keys)
    chk = find_unresolved(chunks, "chunks", "id", "processed_at", ["document_id"], {"1": Rule("document_id", "doc_id")}, keys)
    return rel.unionByName(chk).distinct()  # delivered twice: after the joins few rows are left


def by_table_and_period(unresolved: DataFrame) -> DataFrame:
    """The report: unresolved references per table, column, month and state."""
    return unresolved.groupBy("ref_table", "ref_column", "period", "state").agg(F.count(F.lit(1)).alias("n"))
