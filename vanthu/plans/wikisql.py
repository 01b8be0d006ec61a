"""The statements that give the same rows as compiled wiki pages, their parts and their lint."""

from __future__ import annotations

from vanthu.functions import text as T
from vanthu.plans.sqltext import quote

TODAY = "2026-04-05"
WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
_W = r"[\s\p{Z}\x0b\x1c-\x1f\x85\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}]"
_NL = "chr(10)"


def slug(c: str) -> str:
    flat = f"regexp_replace(lower(translate({c}, {quote(T.SLUG_FROM)}, {quote(T.SLUG_TO)})), '[^\\x00-\\x7f]', '', 'g')"
    kept = f"regexp_replace({flat}, '[^a-z0-9_\\s\\x0b\\-]', '', 'g')"
    return f"substring(regexp_replace(regexp_replace({kept}, '[\\s\\x0b_\\-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80)"


def authorities(content: str, issuer: str) -> str:
    patterns = [rf"(Bộ{WS}+{_W}+?){WS}+(?:ban hành|quy định|hướng dẫn|chỉ đạo)", rf"(Ủy ban nhân dân{WS}+{_W}+?){WS}+(?:ban hành|quyết định)", "(Thủ tướng Chính phủ)", "(Chính phủ)"]
    named = " || ".join(f"list_transform(regexp_extract_all(substring({content}, 1, 3000), '{p}', 1, 'i'), lambda x: trim(x))" for p in patterns)
    every = f"(list_filter([{issuer}], lambda x: coalesce(x, '') <> '') || {named})"
    return f"list_filter({every}, lambda x, i: list_position({every}, x) = i)[1:5]"


def signer(content: str) -> str:
    return rf"trim(regexp_extract({content}, '(?:KT\.|TM\.|Thay mặt.*?)\n+([A-ZÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐ][^\n]{{5,60}})\n', 1))"


def summary(issuer: str, number: str, date: str, content: str) -> str:
    text = f"substring(trim(regexp_replace(substring({content}, 1, 600), '{WS}+', ' ', 'g')), 1, 400)"
    return f"coalesce({issuer}, '') || ' ban hành văn bản số ' || coalesce({number}, '') || ' ngày ' || coalesce({date}, '') || '. Nội dung: ' || {text} || '...'"


KEY_POINTS = (
    f"uc AS (SELECT DISTINCT * FROM chunks), kp15 AS (SELECT *, trim(string_split(text, {_NL})[1]) AS line, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index NULLS FIRST, id) AS n FROM uc WHERE document_id IS NOT NULL QUALIFY n <= 15), "
    "kp AS (SELECT document_id, coalesce(list('Điều ' || dieu || ': ' || substring(line, 1, 120) ORDER BY n) FILTER (WHERE coalesce(dieu, 0) <> 0 AND length(text) > 30 AND length(line) > 10 AND NOT starts_with(line, 'Điều')), [])[1:5] AS key_points FROM kp15 GROUP BY 1)"
)


def _markdown() -> str:
    rows = [("Số hiệu", "doc_number"), ("Loại văn bản", "doc_type"), ("Cơ quan ban hành", "issuing_authority"), ("Ngày ban hành", "issuing_date"), ("Ngày hiệu lực", "effective")]
    rows += [("Người ký", "coalesce(nullif(array_to_string(signers[1:2], ', '), ''), '_chưa xác định_')"), ("Cơ quan liên quan", "coalesce(nullif(array_to_string(authorities[1:3], ', '), ''), '_chưa xác định_')"), ("Hiệu lực", "effectiveness_status")]
    parts = [
        "'---\n' || 'title: \"' || substring(title, 1, 100) || '\"\ntype: tom_tat\n' || 'doc_number: \"' || doc_number || '\"\ndoc_type: \"' || doc_type || '\"\nsources:\n  - doc_id: ' || document_id || '\n    doc_number: \"' || doc_number || '\"\n    title: \"' || substring(title, 1, 80) || '\"\ntags:\n  - \"pháp-luật\"\n'",
        f"'issuing_authority: \"' || issuing_authority || '\"\nissuance_date: \"' || issuing_date || '\"\neffective_date: \"' || effective || '\"\ncreated: {TODAY}\nupdated: {TODAY}\ncreated_by_model: \"\"\nreviewed: false\n---\n\n# ' || substring(title, 1, 120)",
        "'\n\n> **Số hiệu:** ' || doc_number || ' | **Ngày ban hành:** ' || issuing_date || ' | **Cơ quan:** ' || issuing_authority || '\n\n## Tóm tắt\n\n' || summary || '\n'",
        "CASE WHEN len(key_points) > 0 THEN '\n## Điểm chính\n\n' || array_to_string(list_transform(key_points, lambda k: '- ' || k || '\n'), '') ELSE '' END",
        "'\n## Thông tin văn bản\n\n| Thuộc tính | Giá trị |\n|---|---|\n'",
        *[f"'| {k} | ' || {v} || ' |\n'" for k, v in rows],
        f"'\n## Liên kết\n\n- _Chưa có liên kết._\n\n---\n*Trang này được biên dịch tự động bởi hệ thống vào {TODAY}. Vui lòng review trước khi sử dụng.*\n'",
    ]
    return " || ".join(parts)


_S = lambda c: f"coalesce({c}, '')"
PAGES = (
    f"{KEY_POINTS}, cj AS (SELECT document_id, string_agg(text, {_NL} ORDER BY chunk_index NULLS FIRST, id) AS joined FROM uc GROUP BY 1), "
    "dc AS (SELECT d.* EXCLUDE (content_markdown), coalesce(nullif(content_markdown, ''), joined, '') AS content FROM documents d LEFT JOIN cj ON cj.document_id = d.doc_id), "
    f"raw AS (SELECT {slug(_S('doc_number') + chr(32) + '||' + chr(32) + quote('-') + chr(32) + '||' + chr(32) + _S('doc_type'))} AS slug0, {_S('title')} AS title, doc_id AS document_id, {_S('doc_number')} AS doc_number, {_S('doc_type')} AS doc_type, {_S('issuing_date')} AS issuing_date, {_S('issuing_authority')} AS issuing_authority, {_S('effectiveness_status')} AS effectiveness_status, "
    f"{summary('issuing_authority', 'doc_number', 'issuing_date', 'content')} AS summary, coalesce(key_points, []) AS key_points, {authorities('content', 'issuing_authority')} AS authorities, CASE WHEN {signer('content')} = '' THEN [] ELSE [{signer('content')}] END AS signers, coalesce(nullif(effective_date, ''), issuing_date, '') AS effective, created_at FROM dc LEFT JOIN kp ON kp.document_id = dc.doc_id), "
    f"comp AS (SELECT CASE WHEN slug0 = '' THEN 'doc-' || document_id ELSE slug0 END AS slug, *, {_markdown()} AS markdown FROM raw), "
    "one AS (SELECT slug, arg_min(document_id, document_id) AS document_id, arg_min(created_at, document_id) AS created_at, max(document_id) AS filled_by FROM comp GROUP BY 1), "
    "pg AS (SELECT one.slug, one.document_id, one.created_at, c.title, c.doc_number, c.summary, c.key_points, c.authorities, c.signers, c.effective, c.markdown, false AS reviewed FROM one JOIN comp c ON c.slug = one.slug AND c.document_id = one.filled_by)"
)
LINT = (
    f"{PAGES}, lk AS (SELECT DISTINCT slug, trim(string_split(u, '|')[1]) AS link FROM (SELECT slug, unnest(regexp_extract_all(markdown, '\\[\\[([^\\]]+)\\]\\]', 1)) AS u FROM pg)), "
    f"bl AS (SELECT slug, count(*) AS broken FROM lk WHERE string_split(link, '/')[-1] NOT IN (SELECT slug FROM pg) AND {slug(chr(116) + 'ranslate(link, ' + quote('/') + ', ' + quote('-') + ')')} NOT IN (SELECT slug FROM pg) GROUP BY 1), "
    "orph AS (SELECT p.slug FROM pg p WHERE NOT EXISTS (SELECT 1 FROM pg o WHERE o.slug <> p.slug AND (contains(o.markdown, p.slug) OR contains(o.markdown, substring(p.title, 1, 20))))), "
    "li AS (SELECT p.slug, coalesce(broken, 0) AS broken, coalesce(d.effectiveness_status = 'het_hieu_luc', false) AS expired, p.slug IN (SELECT slug FROM orph) AS orphan, p.reviewed FROM pg p LEFT JOIN bl ON bl.slug = p.slug LEFT JOIN documents d ON d.doc_id = p.document_id), "
    "ls AS (SELECT slug, CASE WHEN broken > 0 THEN 'error' WHEN expired OR orphan THEN 'warn' ELSE 'ok' END AS lint_status, broken, expired, orphan, reviewed FROM li)"
)
