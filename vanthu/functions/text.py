"""Scalar text functions as column expressions; none leaves the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F


def _single_mark_letters() -> tuple[str, str]:
    """Lower-case letters whose decomposition has exactly one mark, with their base letters."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) == 2 and unicodedata.combining(d[1]) and chr(cp).islower():
            src.append(chr(cp))
            dst.append(d[0])
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _single_mark_letters()


def _all_marks() -> tuple[str, str]:
    """Latin letters with any marks, with their ASCII base, and letters without one, to be dropped (translate drops the excess)."""
    pairs, dropped = [], []
    for cp in [*range(0xAA, 0x250), *range(0x1E00, 0x1F00)]:
        flat = unicodedata.normalize("NFKD", chr(cp)).encode("ascii", "ignore").decode()
        if len(flat) == 1:
            pairs.append((chr(cp), flat))
        elif not flat:
            dropped.append(chr(cp))
    return "".join(a for a, _ in pairs) + "".join(dropped), "".join(b for _, b in pairs)


SLUG_FROM, SLUG_TO = _all_marks()


def clean_text(c: Column) -> Column:
    """Page markers and carriage returns dropped, three and more newlines made two, ends trimmed; null gives an empty text."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\[\[PAGE_\d+\]\]|\r", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def token_count(c: Column) -> Column:
    return F.size(words(F.coalesce(c, F.lit(""))))


def text_hash(c: Column) -> Column:
    """md5 of the text with its white space made single spaces."""
    return F.md5(F.array_join(words(c), " "))


def folded(c: Column) -> Column:
    """Index form: lower case, single marks stripped, separators made one space, a space at both ends."""
    low = F.translate(F.lower(F.coalesce(c, F.lit(""))), FOLD_FROM, FOLD_TO)
    low = F.regexp_replace(low, "[̀-̱]", "")
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), r"[^\p{L}\p{N}\p{Co}]+", " ")


def fold_py(s: str) -> str:
    """``folded`` for a literal, without the outer spaces."""
    s = "".join(c for c in s.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO)) if not "̀" <= c <= "̱")
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in s).split())


def query_phrases(query: str) -> list[str]:
    """The index forms of a query's words (letters, digits, slash, dash); words without a token vanish."""
    import re

    return [p for p in (fold_py(w) for w in re.findall(r"[\w/\-]+", query)) if p]


def search_mode(c: Column) -> Column:
    """keyword for document numbers, semantic for question words (as substrings), else balanced."""
    # Question words that make a query semantic.
    asks = ["quy định", "điều kiện", "thủ tục", "quyền", "nghĩa vụ", "như thế nào", "bao gồm", "ai", "khi nào", "ở đâu"]
    ask = F.lit(False)
    for w in asks:
        ask = ask | F.contains(F.lower(c), F.lit(w))
    return F.when(F.rlike(c, F.lit(r"(?iu)\d+[/\-]\d+|QĐ|NĐ|TT\-|QH\d+")), "keyword").when(ask, "semantic").otherwise("balanced")


def highlight(c: Column, query: str, max_len: int = 200) -> Column:
    """A snippet around the first query word found, every query word marked in turn (later words may match inside earlier marks)."""
    import re

    ws = [w for w in query.split() if len(w) >= 2]
    pos = F.lit(0)
    for w in reversed(ws):
        at = F.locate(w.lower(), F.lower(c))
        pos = F.when(at > 0, F.greatest(F.lit(0), at - 51)).otherwise(pos)
    cut = F.substring(c, pos + 1, F.lit(max_len))
    out = F.concat(F.when(pos > 0, "...").otherwise(""), cut, F.when(pos + max_len < F.length(c), "...").otherwise(""))
    for w in ws:
        out = F.regexp_replace(out, "(?iu)" + re.escape(w), f"<mark>{w}</mark>".replace("\\", "\\\\").replace("$", "\\$"))
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(out)


def year_of(c: Column) -> Column:
    """The first four-digit part of a date text."""
    return F.try_element_at(F.filter(F.split(F.translate(c, "-", "/"), "/"), lambda p: p.rlike(r"^\d{4}$")), F.lit(1))


def recency(c: Column) -> Column:
    """1 plus a hundredth for each year since 2000; the year is the last part after a slash, else the first four characters."""
    y = F.when(F.contains(c, F.lit("/")), F.element_at(F.split(c, "/"), -1)).otherwise(F.substring(c, 1, 4))
    year = F.when(y.rlike(r"^\s*\d{1,6}\s*$"), F.trim(y).cast("int"))
    return F.coalesce(1.0 + F.greatest(F.lit(0.0), (year - 2000) / F.lit(100.0)), F.lit(1.0))


def parse_doc_type(c: Column) -> Column:
    """The document type told by a number. With the letter U+00D0; numbers with the ordinary Đ fall through (a known quirk that is kept)."""
    n = F.upper(c)
    rules = [
        (r"\d+/QH\d+", "luat"), (r"/NQ-UBTVQH|/NQ-QH", "nghi_quyet"), ("/ND-CP|/NÐ-CP", "nghi_dinh"), (r"/TT-", "thong_tu"),
        ("/QD-|/QÐ-", "quyet_dinh"), (r"/NQ-", "nghi_quyet"), (r"/CT-", "chi_thi"),
    ]
    out = F.lit("cong_van")
    for pattern, code in reversed(rules):
        out = F.when(n.rlike(pattern), code).otherwise(out)
    return out


NUMBER = r"(?U)\b(\d+(?:/\d+)?(?:/[A-ZĐ\-]+)+)\b"


def doc_numbers(c: Column) -> Column:
    """All document numbers of a text; numbers that end in other letters are cut there (kept as it is)."""
    return F.regexp_extract_all(c, F.lit(NUMBER), F.lit(1))


def slugify(c: Column) -> Column:
    """An ASCII slug of at most 80 characters; letters without an ASCII base (đ) vanish."""
    t = F.lower(F.translate(c, SLUG_FROM, SLUG_TO))
    t = F.regexp_replace(t, r"[^\x00-\x7f]", "")
    t = F.regexp_replace(t, r"[^a-z0-9_\s\-]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[\s_\-]+", "-"), r"^-+|-+$", "")
    return F.substring(t, 1, 80)


def valid_doc_number(c: Column) -> Column:
    """Whether a number is one: three characters and a digit, not one of the known placeholders."""
    # Placeholders.
    stop = ["", "N/A", "Trang chu", "Trang chủ", "n/a", "none", "null", "Trang"]
    t = F.trim(F.coalesce(c, F.lit("")))
    return ~t.isin(stop) & (F.length(t) >= 3) & t.rlike(r"\p{Nd}")


def like_ascii(c: Column, needle: str) -> Column:
    """Substring match that folds ASCII letters only."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.contains(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(needle.translate(fold)))


def in_year(c: Column, year: int) -> Column:
    return c.endswith(f"/{year}") | c.startswith(str(year))


def wiki_links(c: Column) -> Column:
    """The targets of all [[links]], without their labels."""
    found = F.regexp_extract_all(c, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))
    return F.transform(found, lambda x: F.trim(F.element_at(F.split(x, r"\|"), 1)))


def salvage_json(c: Column) -> Column:
    """The JSON object inside a model's reply: thoughts and code fences off, else from the first brace to the last."""
    t = F.regexp_replace(c, r"(?is)<thought>.*?</thought>", "")
    t = F.regexp_replace(F.regexp_replace(F.trim(t), r"(?i)^```json\s*", ""), r"\s*```$", "")
    return F.when(F.rlike(F.trim(t), F.lit(r"(?s)^\{.*\}$")), F.trim(t)).otherwise(F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit("")))
