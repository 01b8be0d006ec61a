"""The statements that give the same rows as text queries over whole tables: pieces, documents from chunks, guard, drafts, snippets."""

from __future__ import annotations

from vanthu.operators import guard
from vanthu.plans.sqltext import quote
from vanthu.plans.wikisql import WS

_IN = WS[1:-1]
CLEAN = lambda c: f"regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '\\[\\[PAGE_\\d+\\]\\]|\\r', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{WS}+|{WS}+$', '', 'g')"
_WORDS = lambda c: f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda w: w <> '')"


def _before_numbers(c: str) -> str:
    """``c`` with chr(1) before every place where digits, a point and white space follow."""
    out = f"regexp_replace({c}, '(\\d\\.[\\s\\x0b])', chr(1) || '\\1', 'g')"
    for _ in range(12):  # the digits before it, one by one
        out = f"regexp_replace({out}, '(\\d\\x01\\d)', chr(1) || '\\1', 'g')"
    return f"regexp_replace({out}, '\\x01+', chr(1), 'g')"


#: Up to pc (id, i, text, dieu, khoan, token_count): the pieces of documents.text.
PIECES = (
    f"sr AS (SELECT doc_id AS id, text AS t FROM documents WHERE text IS NOT NULL), "
    f"pa AS (SELECT id, t, list_filter(list_transform(string_split(regexp_replace(t, '(Điều{WS}+\\p{{Nd}}+)', chr(1) || '\\1', 'gi'), chr(1)), lambda x: {CLEAN('x')}), lambda x: length(x) >= 10) AS parts FROM sr), "
    "un AS (SELECT id, unnest(parts) AS s, unnest(range(1, len(parts) + 1)) AS pi FROM pa), "
    f"kl AS (SELECT id, pi, s, try_cast(nullif(regexp_extract(s, '(?i)^Điều{WS}+(\\p{{Nd}}+)', 1), '') AS INTEGER) AS dieu, list_filter(string_split({_before_numbers('s')}, chr(1)), lambda x, k: k > 1 OR x <> '') AS ks FROM un), "
    f"ml AS (SELECT id, pi, dieu, CASE WHEN len(ks) > 1 AND coalesce(dieu, 0) <> 0 THEN list_filter(list_transform(ks, lambda x: {CLEAN('x')}), lambda x: length(x) >= 10) ELSE [s] END AS cs, len(ks) > 1 AND coalesce(dieu, 0) <> 0 AS many FROM kl), "
    "fo AS (SELECT id, pi, unnest(range(1, len(cs) + 1)) AS ki, unnest(cs) AS text, dieu, many FROM ml), "
    "fp AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY pi, ki) - 1)::INTEGER AS i, text, dieu, CASE WHEN many THEN try_cast(nullif(regexp_extract(text, '^(\\d+)\\.[\\s\\x0b]', 1), '') AS INTEGER) END AS khoan FROM fo), "
    f"wo AS (SELECT id, {_WORDS('t')} AS ws FROM sr WHERE id NOT IN (SELECT id FROM fp)), wi AS (SELECT id, ws, unnest(range(0, ((len(ws) + 499) // 500)::BIGINT))::INTEGER AS i FROM wo), "
    f"al AS (SELECT * FROM fp UNION ALL SELECT id, i, array_to_string(ws[i * 500 + 1 : i * 500 + 500], ' '), NULL, NULL FROM wi), pc AS (SELECT *, len({_WORDS('text')})::INTEGER AS token_count FROM al)"
)

#: Up to dm (doc_number, content, n_chunks, issuing_date, issuing_authority): documents made of the chunk table.
DOCUMENTS = (
    f"uc AS (SELECT DISTINCT * FROM chunks), cl AS (SELECT * EXCLUDE (text), {CLEAN('text')} AS text FROM uc WHERE document_id IS NOT NULL), "
    f"ch AS (SELECT *, md5(array_to_string({_WORDS('text')}, ' ')) AS h FROM cl WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY document_id, md5(array_to_string({_WORDS('text')}, ' ')) ORDER BY chunk_index NULLS FIRST, id) = 1), "
    "ln AS (SELECT *, CASE WHEN chunk_index = 0 THEN chr(10) || text || chr(10) WHEN coalesce(dieu, 0) <> 0 AND coalesce(khoan, 0) = 0 THEN chr(10) || '## Dieu ' || dieu || chr(10) || chr(10) || text || chr(10) WHEN coalesce(dieu, 0) <> 0 THEN chr(10) || '### Khoan ' || khoan || ' (Dieu ' || dieu || ')' || chr(10) || chr(10) || text || chr(10) ELSE chr(10) || text || chr(10) END AS line FROM ch), "
    "dm AS (SELECT document_id::VARCHAR AS doc_number, '# Van ban so ' || document_id || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY chunk_index NULLS FIRST, h, text) AS content, count(*)::INTEGER AS n_chunks, "
    "list(issuance_date ORDER BY chunk_index NULLS FIRST, h, text)[1] AS issuing_date, list(issuing_authority ORDER BY chunk_index NULLS FIRST, h, text)[1] AS issuing_authority FROM ln GROUP BY document_id)"
)


def _any(c: str, patterns: list[str]) -> str:
    def plain(p: str) -> str:
        return p.replace(r"\s", f"[{_IN}]").replace(r"\w", r"[\p{L}\p{M}\p{N}_]").replace(r"\d", r"\p{Nd}").replace(r"\b", "\x00")

    def one(p: str) -> str:
        left, right = p.startswith("\x00"), p.endswith("\x00")
        body = p.strip("\x00").replace("\x00.*\x00", r"(?:|[^\p{L}\p{M}\p{N}_].*[^\p{L}\p{M}\p{N}_]|[^\p{L}\p{M}\p{N}_])").replace("\x00", "")
        return (r"(?:^|[^\p{L}\p{M}\p{N}_])" if left else "") + f"(?:{body})" + (r"(?:$|[^\p{L}\p{M}\p{N}_])" if right else "")

    return f"regexp_matches({c}, {quote('|'.join(one(plain(p)) for p in patterns))}, 'i')"


def _routed() -> str:
    c = "title"
    threat = f"CASE WHEN {_any(c, guard.JAILBREAK)} THEN 'jailbreak' WHEN {_any(c, guard.CONFIRMATION)} THEN 'confirmation_attack' WHEN {_any(c, guard.LEAK)} THEN 'leak' END"
    intent = f"CASE WHEN threat IS NOT NULL THEN 'blocked' WHEN coalesce(length(trim(title)) < 3, true) THEN 'small_talk' WHEN {_any(c, guard.LEGAL)} THEN 'rag' WHEN {_any(c, guard.SMALL_TALK)} AND len({_WORDS(c)}) <= 15 THEN 'small_talk' WHEN {_any(c, guard.OUT_OF_SCOPE)} THEN 'out_of_scope' ELSE 'rag' END"
    said = " ".join(f"WHEN {when} THEN {quote(guard.ANSWERS[k])}" for k, when in (("leak", "threat = 'leak'"), ("blocked", "intent = 'blocked'"), ("small_talk", "intent = 'small_talk'"), ("out_of_scope", "intent = 'out_of_scope'")))
    return f"WITH th AS (SELECT doc_id, title, {threat} AS threat FROM documents), it AS (SELECT *, {intent} AS intent FROM th) SELECT doc_id, title AS question, threat, intent, CASE {said} END AS answer FROM it"


ROUTE = _routed()


def highlight(c: str, query: str, max_len: int = 200) -> str:
    ws = [w for w in query.split() if len(w) >= 2]
    at = lambda w: f"position({quote(w.lower())} IN lower({c}))"
    pos = "CASE " + " ".join(f"WHEN {at(w)} > 0 THEN greatest(0, {at(w)} - 51)" for w in ws) + " ELSE 0 END"
    out = f"(CASE WHEN {pos} > 0 THEN '...' ELSE '' END || substring({c}, ({pos}) + 1, {max_len}) || CASE WHEN ({pos}) + {max_len} < length({c}) THEN '...' ELSE '' END)"
    for w in ws:
        out = f"regexp_replace({out}, {quote(w)}, {quote(f'<mark>{w}</mark>')}, 'gi')"
    return f"CASE WHEN {c} = '' THEN '' ELSE {out} END"


def blocks(source: str) -> str:
    """(doc_id, n, style, align, size, text) of the lines of ``source`` (doc_id, t)."""
    marked = "(starts_with(s, '# ') OR starts_with(s, '## ') OR starts_with(s, '### ') OR starts_with(s, '- ') OR s = '---')"
    centred = "(contains(s, 'CỘNG HÒA XÃ HỘI') OR contains(s, 'Độc lập - Tự do') OR contains(s, 'ĐƠN KHIẾU NẠI') OR contains(s, 'TỜ TRÌNH'))"
    return (
        f"WITH so AS ({source}), li AS (SELECT doc_id, unnest(range(0, len(string_split(t, chr(10)))))::INTEGER AS n, trim(unnest(string_split(t, chr(10)))) AS s FROM so) "
        "SELECT doc_id, n, CASE WHEN starts_with(s, '# ') THEN 'heading1' WHEN starts_with(s, '## ') THEN 'heading2' WHEN starts_with(s, '### ') THEN 'heading3' WHEN starts_with(s, '- ') THEN 'bullet' WHEN s = '---' THEN 'rule' ELSE 'body' END AS style, "
        f"CASE WHEN {marked} THEN 'left' WHEN {centred} THEN 'center' WHEN contains(s, ', ngày') AND contains(s, 'tháng') AND contains(s, 'năm') THEN 'right' ELSE 'left' END AS align, "
        f"CASE WHEN starts_with(s, '# ') THEN 16 WHEN starts_with(s, '## ') THEN 14 WHEN starts_with(s, '### ') THEN 13 WHEN s = '---' THEN 10 WHEN NOT {marked} AND (contains(s, 'ĐƠN KHIẾU NẠI') OR contains(s, 'TỜ TRÌNH')) THEN 14 ELSE 13 END AS size, "
        "CASE WHEN starts_with(s, '# ') OR starts_with(s, '- ') THEN substring(s, 3) WHEN starts_with(s, '## ') THEN substring(s, 4) WHEN starts_with(s, '### ') THEN substring(s, 5) WHEN s = '---' THEN repeat('—', 30) ELSE s END AS text FROM li"
    )

