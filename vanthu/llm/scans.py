"""Problem 4: noise in text from scanned pages.

Method: words are grouped by a skeleton in which the glyphs that scanners confuse, and the accents they lose, are one. A word
whose rate in records without signs of scanning is far below its rate in the others is suspect, and a misreading if its
skeleton, or the word without added signs or gaps, is that of a form well known in clean records; among several forms the
one that stands most often next to the same word before and after it in clean records is taken. Only the word pairs that some
misreading asks for are counted, and both sides are joined, so no count is left out and none is broadcast. Lines with
digits and capitalised words masked give shapes; shapes that stand right after a word divided at a line end, or at a page mark inside a sentence, are running headers. Lines then
flow into paragraphs, decided by a SQL window over consecutive lines.

Characters are first brought to one form by the rewriting of problem 1, so look-alike letters are not misreadings.
Defined cases: null and empty text has no noise and stays; ``[[PAGE_n]]`` lines and the document's own head are no noise;
plain line breaks inside a paragraph are no noise; a line of more than 100 characters is no running header; repeated rows
count once (by id), of different texts under one id paragraphs come from one; texts of any length are treated whole;
ties between forms go to the more frequent, then the lower one; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from vanthu.llm.lookalike import TWINS, Rewriter, static_mapping
from vanthu.llm.neardup import BLOOM_BITS, _bloom
from vanthu.runtime import cut, stored

#: A word is well known from this share of the words of clean records, and three occurrences: at most 10^6 words. A share,
#: not a count, so that the same text is judged alike in a collection of any size.
KNOWN_SHARE, KNOWN_LEAST = 1e-6, 3
#: ... and if its rate in clean records is at least this part of its rate in the others.
CLEAN_PART = 0.3
#: A header shape stands after a divided word or at a page mark in at least this share of its lines, and twice.
HEADER_SHARE = 0.01
MARKS = "-¬‑­‐"
SIGNS = "'’`^~*•¢|°¤§\"_@."
_PAGE_MARK = re.compile(r"\[\[PAGE_\w{1,6}\]\]")
_PAGE_NUMBER = re.compile(r"^\W{0,3}\s*(?:(?:trang|tr|page|p)\b\.?\s*)?\W{0,2}\s*\d{1,4}\s*(?:/\s*\d{1,4})?\s*\W{0,3}$", re.I)
_DIVIDED = re.compile(rf"[^\W\d_][{MARKS}]\s*$")
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_LETTER = re.compile(r"[^\W\d_]")
_SIGNS_INSIDE = "^~*•¢|`'@"
_INNER_SIGN = re.compile(rf"[^\W\d_][{re.escape(_SIGNS_INSIDE)}][^\W\d_]")
_CAPITAL = re.compile(r"[^\W\d_]")
_ITEM = re.compile(r"^(?:#|\||(?:Điều|Dieu|Article)\s+\d|\d{1,3}\.\s|[a-zđ]\)\s|- |Căn cứ|Theo đề nghị)")
# Strings a scanner confuses, with the one that stands for them in a skeleton; longer ones first.
CONFUSED = [("rn", "m"), ("ri", "n"), ("li", "h"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("đ", "d"), ("|", "i"), ("l", "i"), ("1", "i"), ("!", "i"), ("0", "o"), ("9", "g"), ("6", "b"), ("5", "s"), ("8", "b"), ("f", "t"), ("(", "c"), ("e", "c"), ("@", "a")]
_SIGN_TABLE = {ord(c): None for c in SIGNS if c not in "|@"}


def skeleton(word: str) -> str:
    """The confusable-glyph skeleton: accents and added signs dropped, confused glyphs folded in the listed order."""
    out = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c)).translate(_SIGN_TABLE)
    for a, b in CONFUSED:
        out = out.replace(a, b)
    return out


def word_of(token: str) -> str:
    return _EDGE.sub("", token).lower()


def shape_of(line: str) -> str:
    """A line with its digits and its runs of capitalised words masked."""
    out: list[str] = []
    for t in line.split():
        m = _CAPITAL.search(t)
        if m and m.group().isupper():
            t = "X"
            if out and out[-1] == "X":
                continue
        out.append(re.sub(r"\d+", "#", t))
    return " ".join(out)


def is_page_number(s: str) -> bool:
    return len(s) < 24 and bool(_PAGE_NUMBER.match(s)) and not re.fullmatch(r"\d{1,3}[.)]", s)


def page_lines(text: str) -> list[tuple[str, str]]:
    """(line, kind) with kind blank, mark, page_number or text."""
    out = []
    for line in text.split("\n"):
        s = line.strip()
        out.append((s, "blank" if not s else "mark" if s[0] == "[" and _PAGE_MARK.fullmatch(s) else "page_number" if is_page_number(s) else "text"))
    return out


def _ends_divided(s: str) -> bool:
    """Whether a line, white space at its ends off, ends in a letter and a mark."""
    return bool(s) and s[-1] in MARKS and bool(_DIVIDED.search(s[-2:]))


def _unfinished(s: str) -> bool:
    return bool(s) and s[-1] not in ".;:!?|/" and not s.isupper() and not s.startswith("#")


def intruders(lines: list[tuple[str, str]]) -> list[tuple[int, bool, bool]]:
    """(position, strong, interrupts) of text lines that could be a page's head or foot.

    strong: right after a divided word, the line does not begin with a small letter. interrupts: the text before is
    unfinished and the text after begins with a small letter.
    """
    texts = [k for k, (_, kind) in enumerate(lines) if kind == "text"]
    out = []
    for j, k in enumerate(texts):
        s = lines[k][0]
        if len(s) > 100 or s[0].islower() or _ITEM.match(s) or s[-1] in ".;,:":
            continue
        before = lines[texts[j - 1]][0] if j else ""
        after = lines[texts[j + 1]][0] if j + 1 < len(texts) else ""
        strong = _ends_divided(before)
        at_page = k and lines[k - 1][1] in ("mark", "page_number") or k + 1 < len(lines) and lines[k + 1][1] in ("mark", "page_number")
        interrupts = _unfinished(before) and after[:1].islower()
        out.append((k, strong or bool(at_page and interrupts), strong or interrupts))
    return out


def divided(lines: list[tuple[str, str]]) -> bool:
    """Whether a word is divided by a mark over a line end, page lines between its parts not counted."""
    for k, (s, kind) in enumerate(lines[:-1]):
        if kind == "text" and _ends_divided(s):
            rest = next((x for x, kd in lines[k + 1 :] if kd == "text"), "")
            if rest[:1].islower() or lines[k + 1][1] != "text":
                return True
            if s[-2:-1].islower() and any(x[:1].islower() for x, kd in lines[k + 1 : k + 4] if kd == "text"):
                return True
    return False


def scanned(text: str, lines: list[tuple[str, str]]) -> bool:
    """Whether a record carries any sign of scanning that needs no vocabulary."""
    return any(c in text for c in _SIGNS_INSIDE) and bool(_INNER_SIGN.search(text)) or any(k == "page_number" for _, k in lines) or divided(lines)


def _rewriter(shared=None) -> Rewriter:
    """The rewriting of problem 1 by its fixed classes; which member stands for a class does not matter here. Words wholly of
    another alphabet are rewritten once the broadcast lexicon tells which of them imitate Latin ones."""
    if not _KEPT_REWRITER:
        _KEPT_REWRITER.append(Rewriter(static_mapping()))
    _KEPT_REWRITER[0].words = shared.value[3] if shared else frozenset()
    return _KEPT_REWRITER[0]


_KEPT_REWRITER: list[Rewriter] = []


def _imitations(words: DataFrame) -> frozenset[str]:
    """Of the counted words (key, n, m) and their parts those of Latin twins that occur more often in Latin letters, in the cases
    they are written in. The Latin word must be well known by its share, so there are at most 10^6, for each as many spellings as letters have twins."""
    lower = {k.lower(): v.lower() for k, v in TWINS.items() if k.isupper()} | {k: v for k, v in TWINS.items() if k.islower()}
    parts = words.select(F.explode(F.split("key", r"[^\p{L}\p{M}\p{N}]+")).alias("key"), (F.col("n") + F.col("m")).alias("c")).groupBy("key").agg(F.sum("c").alias("c"))
    parts = cut(parts.where("key <> ''"))
    least = max(KNOWN_LEAST, KNOWN_SHARE * (parts.agg(F.sum("c")).first()[0] or 0))
    foreign = parts.where(F.col("key").rlike(f"^[{''.join(lower)}]+$")).select(F.col("key").alias("word"), F.col("c").alias("f"), F.translate("key", "".join(lower), "".join(lower.values())).alias("key"))
    got = foreign.join(parts.where(F.col("c") >= least), "key").where("c > f").select("word").collect()
    return frozenset(v for r in got for v in (r["word"], r["word"].capitalize(), r["word"].upper()) if set(v) <= TWINS.keys())


def _gather():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = _rewriter()
        clean, dirty, shapes, strong = Counter(), Counter(), Counter(), Counter()
        for batch in batches:
            for text in batch.column(2).to_pylist():
                if not text:
                    continue
                text = rewrite(text)
                lines = page_lines(text)
                if scanned(text, lines):
                    dirty.update(text.split())
                    for k, s, _ in intruders(lines):
                        shape = shape_of(lines[k][0])
                        shapes[shape] += 1
                        strong[shape] += s
                else:
                    clean.update(text.split())
        words: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for j, counts in enumerate((clean, dirty)):
            for token, n in counts.items():
                words[word_of(token)][j] += n
        rows = [("w", w, a, b) for w, (a, b) in words.items() if w] + [("s", s, n, strong[s]) for s, n in shapes.items()]
        for at in range(0, len(rows), 50_000):
            cols = list(zip(*rows[at : at + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["kind", "key", "n", "m"])

    return run


class Lexicon:
    """What is known of a corpus: the well-known words, their skeletons, and the shapes of its running headers."""

    def __init__(self, words: dict[str, int], shapes: set[str]):
        self.words, self.shapes = words, shapes
        self.by_skeleton: dict[str, list[str]] = defaultdict(list)
        for w in words:
            if len(w) > 1:
                self.by_skeleton[skeleton(w)].append(w)
        for forms in self.by_skeleton.values():
            forms.sort(key=lambda w: (-words[w], w))
        self.state = _States(self)

    def forms(self, token: str) -> list[str]:
        """Well-known forms of which a token (edges stripped) is a misreading."""
        inner = "".join(c for c in token if c not in SIGNS)
        if inner != token and inner in self.words:
            return [inner]
        return [f for f in self.by_skeleton.get(skeleton(token), ()) if abs(len(f) - len(token)) <= 3]

    def judge(self, token: str) -> int:
        """0: nothing to see; 1: a misreading; 2: unknown, perhaps part of a word with a gap."""
        w = word_of(token)
        if not _LETTER.search(w) or w in self.words:
            core = _EDGE.sub("", token)
            if core and token[-1:] in "|^~*•¢" and len(token) > len(core) and _LETTER.match(core[-1:] or "0") and len(core) > 1 and "|" not in token[:-1]:
                return 1
            return 0
        if any(c.isdigit() for c in w):
            # codes hold capitals and digits; a misread digit stands in a word of small letters
            core = _EDGE.sub("", token)
            if core.upper() == core or "/" in w or "-" in w or sum(c.isdigit() for c in w) > 1 + len(w) // 3:
                return 0
            return int(bool(self.forms(w)))
        if "/" in w or "-" in w:
            return 0
        parts = [p for p in re.split(r"['`^~*•¢|\"@.]", w) if p]
        if len(parts) > 1 and all(p in self.words for p in parts) and "." not in w:
            return 1
        if token[:1] == "(" and ")" not in token and "c" + w in self.words:
            return 1
        return 1 if self.forms(w) else 2

    def misread(self, tokens: list[str]) -> bool:
        states = list(map(self.state.__getitem__, tokens))
        if 1 in states:
            return True
        if 2 in states:
            for k, s in enumerate(states):
                if s == 2:
                    w = _EDGE.sub("", tokens[k]).lower()
                    for other in ((word_of(tokens[k - 1]) + w) if k else "", (w + word_of(tokens[k + 1])) if k + 1 < len(tokens) else ""):
                        if other in self.words:
                            return True
        return False

    def header_lines(self, lines: list[tuple[str, str]]) -> set[int]:
        """Positions of running headers. A shape of capitals only is also that of titles and signatures, so there the context decides."""
        return {k for k, _, interrupts in intruders(lines) if shape_of(lines[k][0]) in self.shapes and (interrupts or shape_of(lines[k][0]) != "X")}


class _States(dict):
    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> int:
        got = self.lexicon.judge(token)
        if len(self) > 400_000:
            self.clear()
        if len(token) < 60:
            self[token] = got
        return got


_KEPT_LEXICON: dict[str, Lexicon] = {}


def _lexicon(shared) -> Lexicon:
    """The lexicon of a broadcast (words, shapes, name, imitating words), built once in each worker."""
    words, shapes, name, _ = shared.value
    if name not in _KEPT_LEXICON:
        _KEPT_LEXICON.clear()
        _KEPT_LEXICON[name] = Lexicon(words, shapes)
    return _KEPT_LEXICON[name]


def learn(rows: DataFrame):
    """The broadcast lexicon of all records (table_name, id, text). Known words and header shapes are bounded by their share."""
    stats = cut(rows.mapInArrow(_gather(), "kind string, key string, n long, m long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    words = stats.where("kind = 'w'")
    n, m = words.agg(F.sum("n"), F.sum("m")).first()
    n, m = n or 0, m or 0
    rate = F.col("n") * F.lit(float(m)) >= F.col("m") * F.lit(CLEAN_PART * n)
    known = words.where((F.col("n") >= max(KNOWN_LEAST, KNOWN_SHARE * n)) & rate & F.col("key").rlike(r"^\p{L}+$")).select("key", "n").collect()
    shapes = stats.where((F.col("kind") == "s") & (F.col("m") >= 2) & (F.col("m") >= HEADER_SHARE * F.col("n")) & (F.col("n") >= KNOWN_SHARE * n)).select("key").collect()
    return rows.sparkSession.sparkContext.broadcast(({r["key"]: r["n"] for r in known}, {r["key"] for r in shapes}, uuid.uuid4().hex, _imitations(words)))


def noises(text: str, lexicon: Lexicon) -> list[str]:
    """The kinds of noise of one text in consistent characters."""
    lines = page_lines(text)
    heads = lexicon.header_lines(lines)
    out = []
    if divided(lines):
        out.append("line_hyphen")
    kept = joined([(s, "running_header" if k in heads else kind) for k, (s, kind) in enumerate(lines)])
    if lexicon.misread(" ".join(kept).split()):
        out.append("misread")
    if heads:
        out.append("running_header")
    if any(kind == "page_number" for _, kind in lines):
        out.append("page_number")
    return out


def joined(lines: list[tuple[str, str]]) -> list[str]:
    """The text lines without page lines, words divided over a line end joined."""
    out: list[str] = []
    for s, kind in lines:
        if kind in ("page_number", "running_header", "mark", "blank"):
            if kind == "blank":
                out.append("")
            continue
        if out and s[:1].islower() and _ends_divided(out[-1]):
            out[-1] = out[-1][:-1] + s
        else:
            out.append(s)
    return out


def repair_words(lines: list[str], lexicon: Lexicon, several: list[tuple[int, int, list[tuple[str, str]]]] | None = None) -> list[str]:
    """Misread words replaced by the most frequent well-known form, gaps closed.

    ``several`` gets (line, position among its tokens, [(form, token with it)]) of the words that have other forms as well.
    """
    out = []
    for line in lines:
        tokens = line.split()
        if not any(map(lexicon.state.__getitem__, tokens)):
            out.append(" ".join(tokens))
            continue
        k = 0
        fixed: list[str] = []
        while k < len(tokens):
            t = tokens[k]
            state = lexicon.state[t]
            if state == 2 and k + 1 < len(tokens) and word_of(t) + word_of(tokens[k + 1]) in lexicon.words:
                t, state = t + tokens[k + 1], 0
                k += 1
            if state == 1:
                w = word_of(t)
                forms = lexicon.forms(w)
                if forms:
                    core = _EDGE.sub("", t)
                    at = t.find(core)
                    tail = "".join(c for c in t[at + len(core) :] if c not in "|^~*•¢")
                    read = [(f, t[:at] + (f.upper() if core.isupper() and len(core) > 1 else f.capitalize() if core[:1].isupper() else f) + tail) for f in forms]
                    t = read[0][1]
                    if several is not None and len(read) > 1:
                        several.append((len(out), len(fixed), read))
                else:
                    t = "".join(c for c in t if c not in "|^~*•¢`")
            fixed.append(t)
            k += 1
        out.append(" ".join(fixed))
    return out


def beside(lines: list[list[str]], line: int, pos: int) -> tuple[str | None, str | None]:
    """The words before and after a token of the lines' tokens; a blank line has none and parts those around it."""
    last, nxt = lines[line - 1] if line else [], lines[line + 1] if line + 1 < len(lines) else []
    before = lines[line][pos - 1] if pos else last[-1] if last else ""
    after = lines[line][pos + 1] if pos + 1 < len(lines[line]) else nxt[0] if nxt else ""
    return word_of(before) or None, word_of(after) or None


class _Coded(dict):
    """token -> twice the number of its word, plus one for a word in ``forms``; 0 for no word. ``words`` are the words by number."""

    def __init__(self, forms: set[str]):
        super().__init__()
        self.forms, self.words, self.numbers = forms, [""], {"": 0}

    def __missing__(self, token: str) -> int:
        w = word_of(token)
        n = self.numbers.setdefault(w, len(self.words))
        if n == len(self.words):
            self.words.append(w)
        code = self[token] = 2 * n + (w in self.forms)
        return code


_LINE = "table_name string, id long, version long, line int, s string, asks array<struct<pos:int,before:string,after:string,forms:array<struct<form:string,token:string>>>>"
_FORM = pa.struct([("form", pa.string()), ("token", pa.string())])
_ASK = pa.list_(pa.struct([("pos", pa.int32()), ("before", pa.string()), ("after", pa.string()), ("forms", pa.list_(_FORM))]))


def _repaired(shared):
    """(table_name, id, version, line, s, asks): the repaired lines of every text; asks are the misread words with several
    forms: their position, the words around them, and their forms, most frequent first. Equal texts have one version."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite, lex = _rewriter(shared), _lexicon(shared)
        for batch in batches:
            out = []
            for t, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not text:
                    continue
                several: list = []
                fixed = repair_words(_kept(rewrite(text), lex), lex, several)
                asks: dict[int, list] = defaultdict(list)
                if several:
                    tokens = [s.split(" ") if s else [] for s in fixed]
                    for line, pos, read in several:
                        left, right = beside(tokens, line, pos)
                        asks[line].append({"pos": pos, "before": left, "after": right, "forms": [{"form": f, "token": token} for f, token in read]})
                b = text.encode("utf-8", "surrogatepass")
                version = zlib.crc32(b) << 31 ^ zlib.adler32(b)
                out += [(t, i, version, k, s, asks.get(k)) for k, s in enumerate(fixed)]
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), _ASK))], names=["table_name", "id", "version", "line", "s", "asks"])

    return run


def _pairs(shared, table):
    """(pair, m): counts of the adjacent words of clean records, of all pairs in a bit table and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite, bits = _rewriter(shared), table.value
        forms = {w for ws in _lexicon(shared).by_skeleton.values() if len(ws) > 1 for w in ws}
        coded, held, n = _Coded(forms), [], 0

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            rows = []
            for k, m in zip(keys.tolist(), counts.tolist()):
                pair = f"{coded.words[k >> 33]} {coded.words[(k & 0xFFFFFFFF) >> 1]}"
                h = zlib.crc32(pair.encode("utf-8", "surrogatepass")) % BLOOM_BITS
                if int(bits[h >> 6]) >> (h & 63) & 1:
                    rows.append((pair, m))
            held.clear()
            cols = list(zip(*rows)) if rows else [[], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], names=["pair", "m"])

        for batch in batches:
            for text in batch.column(2).to_pylist():
                if not text:
                    continue
                text = rewrite(text)
                lines = page_lines(text)
                if scanned(text, lines):
                    continue
                flat: list[str] = []
                for s in joined(lines):
                    flat += s.split() if s else [""]
                c = np.fromiter(map(coded.__getitem__, flat), dtype=np.int64, count=len(flat))
                a, b = c[:-1], c[1:]
                keep = (a > 1) & (b > 1) & (((a | b) & 1) == 1)
                held.append((a[keep] << 32) | b[keep])
                n += len(c)
                if n > 3_000_000:
                    yield out()
                    n = 0
                    if len(coded) > 400_000:
                        coded = _Coded(forms)
        yield out()

    return run


def choices(rows: DataFrame, lines: DataFrame, shared) -> DataFrame:
    """(table_name, id, version, line, pos, token): of the misread words with several forms, the one its neighbours support.

    The support of a form is the product of its pair counts with the word before and the word after, each plus one; ties go to
    the more frequent, then the lower form. A bit table of fixed size keeps the pairs that no word asks for out of the shuffle.
    """
    at = ["table_name", "id", "version", "line"]
    asks = lines.where("asks is not null").select(*at, F.explode("asks").alias("a")).select(*at, "a.pos", "a.before", "a.after", F.posexplode("a.forms").alias("rank", "f"))
    asks = asks.select(*at, "pos", "rank", "f.token", F.concat("before", F.lit(" "), "f.form").alias("before"), F.concat("f.form", F.lit(" "), "after").alias("after"))
    asked = asks.select(F.explode(F.array("before", "after")).alias("pair")).where("pair is not null")
    table = rows.sparkSession.sparkContext.broadcast(_bloom(asked.select(F.pmod(F.crc32(F.encode("pair", "UTF-8")), F.lit(BLOOM_BITS)).alias("h"))))
    counts = cut(rows.mapInArrow(_pairs(shared, table), "pair string, m long").groupBy("pair").agg(F.sum("m").alias("m")))
    side = lambda name: counts.select(F.col("pair").alias(name), F.col("m").alias(f"n_{name}"))
    scored = asks.join(side("before"), "before", "left").join(side("after"), "after", "left")
    support = (F.coalesce("n_before", F.lit(0)) + 1).cast("double") * (F.coalesce("n_after", F.lit(0)) + 1)
    return scored.groupBy(*at, "pos").agg(F.min_by("token", F.struct(-support, "rank")).alias("token"))


def texts_of(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(table_name, id, text) of documents.content_markdown and chunks.text."""
    return documents.select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("id"), F.col("content_markdown").alias("text")).unionByName(
        chunks.select(F.lit("chunks").alias("table_name"), "id", "text")
    )


def found(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(table_name, id, noise): one row for each kind of noise in a text."""
    rows = texts_of(documents, chunks)
    shared = learn(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite, lex = _rewriter(shared), _lexicon(shared)
        for batch in batches:
            out = [(t, i, kind) for t, i, text in zip(*(c.to_pylist() for c in batch.columns)) if text for kind in noises(rewrite(text), lex)]
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["table_name", "id", "noise"])

    return rows.mapInArrow(run, "table_name string, id long, noise string").distinct()


def _kept(text: str, lexicon: Lexicon) -> list[str]:
    """The lines of a text in consistent characters that are no page lines, divided words joined."""
    lines = page_lines(text)
    heads = lexicon.header_lines(lines)
    return joined([(s, "running_header" if k in heads else kind) for k, (s, kind) in enumerate(lines)])


def paragraphs(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(table_name, id, paragraph, text): continuous paragraphs of every text, in order.

    Lines are repaired where they are and written once, words with several forms chosen by ``choices``; a window over the
    lines of a text then drops those delivered again (of different texts under one id one is kept) and starts a new
    paragraph where a line begins an item, follows a blank line, or follows a finished line and begins with a capital.
    """
    rows = texts_of(documents, chunks)
    shared = learn(rows)
    lines = stored(rows.mapInArrow(_repaired(shared), _LINE), "lines")
    at = lambda line, pos: F.shiftleft(line.cast("long"), 32) + pos
    key = ["table_name", "id", "version"]
    fixes = choices(rows, lines, shared).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(at(F.col("line"), F.col("pos")).alias("k"), F.col("token").alias("v")))).alias("fixes"))
    chosen = F.array_join(F.transform(F.split("s", " "), lambda x, k: F.coalesce(F.try_element_at("fixes", at(F.col("line"), k)), x)), " ")
    lines = lines.select(*key, "line", "s").join(fixes, key, "left").select(*key, "line", F.when(F.col("fixes").isNull(), F.col("s")).otherwise(chosen).alias("s"))
    by = W.partitionBy("table_name", "id").orderBy("version", "line")
    once = lines.withColumn("again", F.lag("line").over(by)).withColumn("kept", F.first("version").over(by)).where("version = kept and (again is null or again <> line)")
    before = F.lag("s").over(by)
    item = F.col("s").rlike(r"^(#|\||(Điều|Dieu|Article)\s+\d|\d{1,3}\.\s|[a-zđ]\)\s|- |Căn cứ|Theo đề nghị)")
    starts = before.isNull() | (before == "") | item | before.rlike(r"^#|[.;:!?|/]$") & F.col("s").rlike(r"^[^\p{Ll}]") | before.rlike(r"^\P{Ll}+$")
    marked = once.withColumn("start", starts.cast("int")).withColumn("paragraph", F.sum("start").over(by)).where("s <> ''")
    return marked.groupBy("table_name", "id", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "s"))), lambda x: x["s"]), " ").alias("text"))
