"""Queries of the general data problems: hierarchies (3) and references (5)."""

from __future__ import annotations

from vanthu.operators import hierarchy, references
from vanthu.runtime import table


def p3_found(spark, d):
    return hierarchy.faults(table(spark, d, "doc_sections"))


def p3_hierarchy(spark, d):
    return hierarchy.hierarchy(table(spark, d, "doc_sections"))


def p3_descendants(spark, d):
    return hierarchy.descendants(table(spark, d, "doc_sections"))


def p5_found(spark, d):
    return references.unresolved_references(*(table(spark, d, t) for t in ("documents", "doc_deletions", "chunks", "doc_relations")))


def p5_by_period(spark, d):
    return references.by_table_and_period(p5_found(spark, d))


QUERIES = {f.__name__: f for f in (p3_found, p3_hierarchy, p3_descendants, p5_found, p5_by_period)}

_TREE = """
WITH RECURSIVE n AS (SELECT DISTINCT id, parent_id, section_type, number FROM doc_sections WHERE id IS NOT NULL),
up(id, anc, hops) AS (
  SELECT id, parent_id, 1 FROM n WHERE parent_id IN (SELECT id FROM n)
  UNION
  SELECT u.id, p.parent_id, u.hops + 1 FROM up u JOIN n p ON p.id = u.anc WHERE p.parent_id IN (SELECT id FROM n) AND u.hops < 400 AND u.anc <> u.id),
on_cycle AS (SELECT DISTINCT id FROM up WHERE anc = id),
below AS (SELECT DISTINCT id FROM up WHERE anc IN (SELECT id FROM on_cycle) AND id NOT IN (SELECT id FROM on_cycle)),
missing AS (SELECT id FROM n WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM n)),
ok AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM on_cycle UNION SELECT id FROM below)),
clos AS (SELECT id AS descendant_id, id AS anc, 0 AS dist FROM ok UNION ALL SELECT u.id, u.anc, u.hops FROM up u JOIN ok ON ok.id = u.id)
"""
_DOWN = _TREE + """,
down AS (SELECT id, id AS root_id, 1 AS depth, trim(coalesce(section_type, '') || ' ' || coalesce(number, '')) AS path, [id] AS ids, parent_id IS NULL AS rooted FROM ok WHERE parent_id IS NULL OR id IN (SELECT id FROM missing)
  UNION ALL SELECT c.id, p.root_id, p.depth + 1, p.path || '/' || trim(coalesce(c.section_type, '') || ' ' || coalesce(c.number, '')), list_append(p.ids, c.id), p.rooted FROM down p JOIN ok c ON c.parent_id = p.id),
pre AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY ids) - 1 AS k FROM down),
below_n AS (SELECT anc AS id, count(*) AS n FROM clos WHERE dist > 0 GROUP BY 1)
"""
_WIDE = "".join(chr(0xFF01 + i) for i in range(94))
_ASCII = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")


def _num(column: str) -> str:
    """The agreement key of a document number in SQL."""
    folded = f"nfc_normalize(lower(translate({column}, '{_WIDE}', '{_ASCII}')))"
    bare = f"regexp_replace({folded}, '[\\s\\p{{Z}}\\p{{Cf}}\\p{{Cc}}]', '', 'g')"
    return f"rtrim(translate({bare}, 'асеіјорѕхукмтвнοαβεηικμνρτυχζγðɖ‑‐', 'aceijopsxykmtbhoabehikmvptuxzyđđ--'), '.,;)')"


_REFS = (
    "WITH docs AS (SELECT doc_id, " + _num("doc_number") + " AS k, created_at FROM documents), "
    "gone AS (SELECT doc_id, " + _num("doc_number") + " AS k FROM doc_deletions), "
    "byid AS (SELECT doc_id, min(created_at) AS born FROM docs GROUP BY 1), bynum AS (SELECT k, min(created_at) AS born FROM docs WHERE k IS NOT NULL GROUP BY 1), "
    "refs AS (SELECT DISTINCT 'chunks' AS ref_table, 'document_id' AS ref_column, id AS ref_id, processed_at AS tm, document_id AS rid, CAST(NULL AS VARCHAR) AS rnum FROM chunks WHERE document_id IS NOT NULL "
    "UNION ALL SELECT DISTINCT 'doc_relations', CASE WHEN target_doc_id IS NOT NULL THEN 'target_doc_id' ELSE 'target_doc_number' END, id, created_at, target_doc_id, CASE WHEN target_doc_id IS NULL THEN " + _num("target_doc_number") + " END FROM doc_relations WHERE target_doc_id IS NOT NULL OR target_doc_number IS NOT NULL), "
    "res AS (SELECT r.*, coalesce(a.born, b.born) AS born, (r.rid IS NOT NULL AND r.rid IN (SELECT doc_id FROM gone WHERE doc_id IS NOT NULL)) OR (r.rnum IS NOT NULL AND r.rnum IN (SELECT k FROM gone WHERE k IS NOT NULL)) AS dead FROM refs r LEFT JOIN byid a ON a.doc_id = r.rid LEFT JOIN bynum b ON b.k = r.rnum), "
    "found AS (SELECT ref_table, ref_column, ref_id, strftime(tm, '%Y-%m') AS period, CASE WHEN born IS NOT NULL THEN 'late' WHEN dead THEN 'deleted' ELSE 'missing' END AS state FROM res WHERE born IS NULL OR born > tm) "
)

ORACLE_SQL = {
    "p3_found": _TREE + "SELECT id, 'on_cycle' AS fault FROM on_cycle UNION ALL SELECT id, 'below_cycle' FROM below UNION ALL SELECT id, 'missing_parent' FROM missing",
    "p3_hierarchy": _DOWN + "SELECT pre.id, root_id, depth, path, coalesce(n, 0) AS n_descendants, 2 * k - depth + 1 AS entry, 2 * k - depth + 2 + 2 * coalesce(n, 0) AS exit, rooted FROM pre LEFT JOIN below_n USING (id)",
    "p3_descendants": _TREE + "SELECT anc AS id, descendant_id FROM clos WHERE dist > 0",
    "p5_found": _REFS + "SELECT ref_table, ref_column, ref_id, period, state FROM found",
    "p5_by_period": _REFS + "SELECT ref_table, ref_column, period, state, count(*) AS n FROM found GROUP BY ALL",
}
