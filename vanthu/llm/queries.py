"""Queries of the text problems (1, 2, 4, 6-9), with SQL where it can express the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from vanthu.llm import lookalike, neardup, packing, scans, splitting, tokenizer, truncation
from vanthu.runtime import table


def p1_found(spark, d):
    return lookalike.found(table(spark, d, "documents"), table(spark, d, "chunks"))


def p1_canonical(spark, d):
    """Every title and chunk text in its consistent form."""
    rows, forms = lookalike.titles_and_chunks(table(spark, d, "documents"), table(spark, d, "chunks"))
    return lookalike.canonical(rows, forms)


def p2_found(spark, d):
    return splitting.found(table(spark, d, "chunks"))


def p2_pieces(spark, d):
    return splitting.split_oversized(table(spark, d, "chunks"))


def p2_rebuilt(spark, d):
    """The words of every divided text, made again of its pieces, and how long and how many these are."""
    pieces = p2_pieces(spark, d).select("id", "piece", "text", "n_words", "overlap_words")
    most = pieces.groupBy("id").agg(F.max("n_words").alias("n"), F.max("overlap_words").alias("o"), F.count_if(F.col("overlap_words") != F.when(F.col("piece") == 0, 0).otherwise(splitting.OVERLAP)).alias("other_overlaps"))
    return splitting.joined(pieces).join(most, "id").select("id", F.md5(F.array_join("words", " ")).alias("h"), (F.col("n") <= splitting.MAX_WORDS).alias("within"), "other_overlaps")


def p4_found(spark, d):
    return scans.found(table(spark, d, "documents"), table(spark, d, "chunks"))


def p4_paragraphs(spark, d):
    return scans.paragraphs(table(spark, d, "documents"), table(spark, d, "chunks"))


def p6_found(spark, d):
    return neardup.pairs(table(spark, d, "documents"), table(spark, d, "chunks"))


def p6_groups(spark, d):
    return neardup.groups(table(spark, d, "documents"), table(spark, d, "chunks"))


def p7_ids(spark, d):
    return tokenizer.encode_texts(table(spark, d, "documents"))


def p7_decoded(spark, d):
    """Every text from its ids: the way back gives the text."""
    return tokenizer.decode_ids(p7_ids(spark, d)).select("doc_id", F.md5("text").alias("h"))


def p8_containers(spark, d):
    return packing.pack_documents(table(spark, d, "documents"))


def p8_report(spark, d):
    return packing.report(p8_containers(spark, d))


def p8_coverage(spark, d):
    """For every document in containers: where its first token range begins, how many ranges do not go on where one ends, and the fill of its fullest container."""
    rows = p8_containers(spark, d)
    fill = rows.groupBy("container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("fill"))
    ends = F.array_sort(F.collect_list(F.struct("token_start", "token_end")))
    per = rows.join(fill, "container").groupBy("doc_id").agg(ends.alias("r"), F.max("fill").alias("fill"), F.min("token_start").alias("first"))
    gaps = F.size(F.filter(F.sequence(F.lit(1), F.size("r")), lambda k: (k > 1) & (F.element_at("r", k)["token_start"] != F.element_at("r", F.greatest(k - 1, F.lit(1)))["token_end"])))
    return per.select("doc_id", "first", gaps.cast("long").alias("gaps"), (F.col("fill") <= packing.CAPACITY).alias("within"))


def p9_found(spark, d):
    return truncation.found(table(spark, d, "documents"))


def p9_by_source(spark, d):
    return truncation.by_source(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_canonical, p2_found, p2_pieces, p2_rebuilt, p4_found, p4_paragraphs, p6_found, p6_groups, p7_ids, p7_decoded, p8_containers, p8_coverage, p8_report, p9_found, p9_by_source)}

_WORDS = "len(list_filter(regexp_split_to_array(text, '[\\s\\x1c-\\x1f\\x85\\p{Z}]+'), lambda w: w <> ''))"
ORACLE_SQL = {
    "p2_rebuilt": f"SELECT DISTINCT id, md5(array_to_string({_WORDS[4:-1]}, ' ')) AS h, true AS within, 0::BIGINT AS other_overlaps FROM chunks WHERE {_WORDS} > 500",
    "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents",
    "p8_coverage": "SELECT doc_id, 0::BIGINT AS first, 0::BIGINT AS gaps, true AS within FROM documents WHERE text <> ''",
    "p2_found": f"SELECT DISTINCT id FROM chunks WHERE {_WORDS} > 500",
}
