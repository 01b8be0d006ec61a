"""Problem 2: splitting oversized texts at natural boundaries.

Method: content-defined chunking. A rolling hash over eight words marks landmarks; the first landmark between the minimum
and maximum size snaps to the nearest natural boundary there (article, clause, point, sentence or line begin). Landmarks
depend on the words around them only, so an edit alters only neighbouring pieces. Without a landmark the largest size is
the mark; without a boundary the cut is at a word.

Words are the pieces of a text split at white space. Defined cases: null, empty and short texts give no piece; a text of
exactly the limit is whole and gives none; a text without any boundary is cut at words; repeated rows (same id) are cut
once; texts of any length are cut whole; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

MAX_WORDS, OVERLAP = 500, 50
WINDOW, ONE_IN = 8, 48  # words in the rolling hash; a landmark every so many words on average
_WORD = re.compile(r"\S+")
_BOUNDARIES = (  # kind, what stands before a begin, cost in words against a nearer begin of a weaker kind
    ("article", re.compile(r"(?:^|(?<=\n))[^\S\n]*(?=(?:#+[^\S\n]*)?(?:Điều|Dieu|Article)\s+\d+)"), 0),
    ("clause", re.compile(r"(?:^|(?<=\n))[^\S\n]*(?=\d{1,3}\.\s)"), 3),
    ("point", re.compile(r"(?:^|(?<=\n))[^\S\n]*(?=[a-zđ]\)\s)"), 6),
    ("sentence", re.compile(r"[.!?;…]\s+(?=\S)"), 9),
    ("line", re.compile(r"\n\s*(?=\S)"), 20),
)
_ARTICLE = re.compile(r"(?:^|(?<=\n))[^\S\n]*(?:#+[^\S\n]*)?(?:Điều|Dieu|Article)\s+(\d{1,6})")
_CLAUSE = re.compile(r"(?:^|(?<=\n))[^\S\n]*(\d{1,3})\.\s")


def landmarks(words: list[str]) -> list[int]:
    """Word positions whose window of words before them hashes to a multiple of ``ONE_IN``."""
    base, mod = 1_000_003, (1 << 61) - 1
    out_factor = pow(base, WINDOW, mod)
    values = [zlib.crc32(w.encode()) + 1 for w in words]
    h, out = 0, []
    for i, v in enumerate(values):
        h = (h * base + v) % mod
        if i >= WINDOW:
            h = (h - values[i - WINDOW] * out_factor) % mod
        if i + 1 >= WINDOW and (h ^ (h >> 17)) % ONE_IN == 0:
            out.append(i + 1)
    return out


def split_text(text: str, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """[(first word with the overlap, first new word, end word, kind of begin)] of a text of more than ``max_words`` words."""
    spans = [m.span() for m in _WORD.finditer(text)]
    n = len(spans)
    if n <= max_words:
        return []
    starts = [a for a, _ in spans]
    kinds: dict[int, tuple[int, str]] = {}
    for kind, pattern, cost in _BOUNDARIES:
        for m in pattern.finditer(text):
            at = bisect_left(starts, m.end())
            if 0 < at < n:
                kinds.setdefault(at, (cost, kind))
    begins = sorted(kinds)
    marks = landmarks([text[a:b] for a, b in spans])
    out, new, kind = [], 0, "start"
    while True:
        first = max(0, new - overlap)
        most = first + max_words
        if most >= n:
            out.append((first, new, n, kind))
            return out
        least = new + max(1, (most - new) // 2)
        k = bisect_left(marks, least)
        mark = marks[k] if k < len(marks) and marks[k] <= most else most
        near = begins[bisect_left(begins, least) : bisect_right(begins, most)]
        if near:
            end = min(near, key=lambda b: (abs(b - mark) + kinds[b][0], b))
            next_kind = kinds[end][1]
        else:
            end, next_kind = mark, "word"
        out.append((first, new, end, kind))
        new, kind = end, next_kind


def pieces_of(text: str, dieu, khoan, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> list[dict]:
    """The pieces of one text with the article and clause in force where their new words begin, and those that begin inside."""
    spans = [m.span() for m in _WORD.finditer(text)]
    articles = [(m.start(1), int(m.group(1))) for m in _ARTICLE.finditer(text)]
    clauses = [(m.start(1), int(m.group(1))) for m in _CLAUSE.finditer(text)]
    out = []
    for no, (first, new, end, kind) in enumerate(split_text(text, max_words, overlap)):
        at, stop = spans[new][0], spans[end - 1][1]
        # a number that begins with the piece's first word is in force there
        here = spans[new][1] + 8
        before = [v for v in articles if v[0] <= here]
        art_at = before[-1][0] if before else -1
        cl = [v for v in clauses if art_at < v[0] <= spans[new][1]]
        out.append(
            {
                "piece": no,
                "text": text[spans[first][0] : stop],
                "n_words": end - first,
                "overlap_words": new - first,
                "first_word": new,
                "begins_at": kind,
                "dieu": before[-1][1] if before else dieu,
                "khoan": cl[-1][1] if cl else (None if before else khoan),
                "dieu_inside": [v for p, v in articles if at <= p < stop],
                "khoan_inside": [v for p, v in clauses if at <= p < stop],
            }
        )
    return out


def split_oversized(chunks: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """Ordered pieces of every chunk of more than ``max_words`` words, whatever its token_count says.

    A text of so many words has at least twice as many characters, less one, so most rows never leave the JVM.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                none = lambda v: None if pd.isna(v) else int(v)
                rows += [{"id": r.id} | p for p in pieces_of(r.text, none(r.dieu), none(r.khoan), max_words, overlap)]
            if rows:
                out = pd.DataFrame(rows)
                out[["dieu", "khoan"]] = out[["dieu", "khoan"]].astype("Int64")
                yield out

    long = chunks.select("id", "text", "dieu", "khoan").where(F.length("text") > 2 * max_words)
    schema = "id long, piece int, text string, n_words int, overlap_words int, first_word int, begins_at string, dieu int, khoan int, dieu_inside array<int>, khoan_inside array<int>"
    return long.dropDuplicates(["id"]).mapInPandas(run, schema)


def joined(pieces: DataFrame) -> DataFrame:
    """(id, words): the words of the divided texts, made of their pieces without the words each repeats."""
    own = F.expr("slice(filter(split(text, '(?U)\\\\s+'), w -> w <> ''), overlap_words + 1, n_words)")
    return pieces.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", own.alias("ws")))), lambda p: p["ws"])).alias("words"))


def found(chunks: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(id) of the chunks that were cut."""
    return split_oversized(chunks, max_words).where("piece = 0").select("id")
