"""Problem 1: visually identical text with different characters.

Method: look-alike pairs of strings and code points are joined into transitive classes by union-find; the representative
of a class is its most frequent ordinary member in the corpus; a multi-pattern automaton rewrites texts greedily (leftmost,
longest) until nothing changes. Pairs come from the Unicode decompositions (full-width, no-break, compatibility and
mathematical letters and numerals; every spelling of an accented letter in separate parts), from the invisible and space
categories, and from a table of letters of other alphabets. Letters of other alphabets are rewritten by word: in a word that
also holds Latin letters, digits or marks of Latin letters. A word wholly of another alphabet, each of whose letters has a
Latin twin, is an imitation only if frequencies say so: if the corpus holds the same word in Latin letters more often.

Defined cases: null stays null and is no case; tab, newline and carriage return stay; superscripts, dashes longer than a
hyphen, another visible placement of a tone mark, and words or symbols wholly of another alphabet stay; a word that is as
frequent in either alphabet stays; repeated rows count once (by id) in the found list; texts of any length are treated
whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vanthu.runtime import cut

# Letters of other alphabets that are drawn exactly like a Latin letter.
TWINS = {
    "А": "A", "Α": "A", "В": "B", "Β": "B", "С": "C", "Ϲ": "C", "Е": "E", "Ε": "E", "Н": "H", "Η": "H", "І": "I", "Ι": "I",
    "Ӏ": "I", "Ј": "J", "К": "K", "Κ": "K", "М": "M", "Μ": "M", "Ν": "N", "О": "O", "Ο": "O", "Р": "P", "Ρ": "P", "Ԛ": "Q",
    "Ѕ": "S", "Т": "T", "Τ": "T", "Ԝ": "W", "Х": "X", "Χ": "X", "У": "Y", "Υ": "Y", "Ζ": "Z",
    "а": "a", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "ո": "n", "о": "o", "ο": "o",
    "р": "p", "ρ": "p", "ԛ": "q", "ѕ": "s", "υ": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
}
# Other characters drawn like one ordinary character.
SAME = {"Ð": "Đ", "Ɖ": "Đ", "ɖ": "đ", "‐": "-", "‑": "-", "ı": "i", "ſ": "s", "ˈ": "'", "‚": ",", "∕": "/", "⁄": "/", "∶": ":", "ꞌ": "'", "˗": "-"}
# Characters outside the format category that cannot be seen (controls, fillers, variation selectors).
UNSEEN = [*range(0x00, 0x09), *range(0x0E, 0x20), *range(0x7F, 0x85), *range(0x86, 0xA0), 0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, *range(0xFE00, 0xFE10), 0xFFA0]
# Characters of the format category that can be seen (number and verse signs of other alphabets).
SEEN = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
# Marks of Latin letters that other alphabets do not use.
LATIN_MARKS = {0x0302, 0x0303, 0x0306, 0x0309, 0x031B, 0x0323}
_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>"}
_LAST = 0x20000  # above, only the invisible tags and variation selectors are members; they are matched by their range
#: Words of another alphabet that imitate Latin ones are broadcast up to so many, else joined to the texts that hold them.
BROADCAST_WORDS = 100_000
_ANY_MARK = "\u0300-\u036f"
_OTHER = "\u0370-\u058f"  # Greek, Cyrillic, Armenian


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while self.up.setdefault(root, root) != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def union(self, a: str, b: str) -> None:
        self.up[self.find(a)] = self.find(b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.up):
            out.setdefault(self.find(x), []).append(x)
        return out


def spellings(letter: str) -> set[str]:
    """All canonically equivalent spellings of an accented letter: any part composed, marks in any order."""
    base, *marks = unicodedata.normalize("NFD", letter)
    out = set()
    for n in range(len(marks) + 1):
        for inside in itertools.permutations(marks, n):
            core = unicodedata.normalize("NFC", base + "".join(inside)) if inside else base
            if len(core) == 1:
                rest = [m for m in marks if m not in inside]
                out |= {core + "".join(p) for p in itertools.permutations(rest)}
    return {s for s in out if unicodedata.normalize("NFC", s) == letter or sorted(unicodedata.normalize("NFD", s)) == sorted(unicodedata.normalize("NFD", letter))}


def build_classes() -> Classes:
    """The look-alike classes, without frequencies."""
    classes = Classes()
    for cp in UNSEEN:
        classes.union(chr(cp), "")
    for cp in range(0xA0, _LAST):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Cs", "Co"):
            continue
        if kind == "Cf":
            if cp not in SEEN:
                classes.union(ch, "")
            continue
        if kind == "Zs":
            classes.union(ch, " ")
            continue
        d = unicodedata.decomposition(ch)
        if d.startswith("<"):
            plain = unicodedata.normalize("NFKC", ch)
            # only what reads as ordinary Latin text; ellipses, spacing accents and ideographs are visibly themselves
            if d.split()[0] in _TAGS and plain.isascii() and plain.strip() and (len(plain) == 1 or set(plain) != {"."}):
                classes.union(ch, plain)
        elif d and cp < 0x2000 and "LATIN" in unicodedata.name(ch, ""):
            for s in spellings(ch):
                classes.union(s, ch)
    for a, b in SAME.items():
        classes.union(a, b)
    for a, b in TWINS.items():
        classes.union(a, b)
    return classes


def ordinary(member: str) -> bool:
    """Whether a member can be the form all others take: printable ASCII, or one accented letter that is no look-alike itself."""
    return member.isascii() and (member.isprintable() and member != "") or len(member) == 1 and member not in SAME and member not in TWINS and not unicodedata.decomposition(member).startswith("<")


def representatives(classes: Classes, counts: dict[str, int]) -> dict[str, str]:
    """member -> representative for every class: the most frequent ordinary member, ties to the lower one.

    The class of the invisible characters stands for the empty string, which is in every gap of every text. A class
    without an ordinary member takes its most frequent one.
    """
    out = {}
    for members in classes.members().values():
        best = "" if "" in members else min(members, key=lambda m: (not ordinary(m), -counts.get(m, 0), len(m), m))
        out |= {m: best for m in members if m and m != best}
    return out


_WORD = re.compile(rf"[^\W_](?:[^\W_]|[{_ANY_MARK}])*")
_FOREIGN = re.compile(f"[{_OTHER}]")
_LATIN_TWIN = re.compile(f"(?<![^\\W_])[{''.join(sorted(set(TWINS.values())))}]+(?![^\\W_]|[{_ANY_MARK}])")
_TO_LATIN = str.maketrans(TWINS)


def twin_words(text: str) -> Iterator[str]:
    """The words wholly of another alphabet each of whose letters has a Latin twin."""
    if _FOREIGN.search(text):
        for m in _WORD.finditer(text):
            if set(m.group()) <= TWINS.keys():
                yield m.group()


class Rewriter:
    """Rewrites one text into its consistent form. ``words`` are the words wholly of another alphabet that imitate Latin ones."""

    def __init__(self, mapping: dict[str, str], words: frozenset[str] = frozenset()):
        twins = {k: v for k, v in mapping.items() if k in TWINS}
        plain = {k: v for k, v in mapping.items() if k not in TWINS}
        self.twins = str.maketrans(twins)
        self.automaton = ahocorasick.Automaton()
        for k, v in plain.items():
            self.automaton.add_word(k, (len(k), v))
        self.automaton.make_automaton()
        # a text without any of these is as it should be; above the first plane all characters are looked at
        single = "".join(re.escape(k) for k in mapping if len(k) == 1 and k < "\U00010000")
        self.suspect = re.compile(f"[{single}{_ANY_MARK}\U00010000-\U0001ffff\U000e0000-\U000e0fff]")
        self.twin_letters = set(twins)
        self.words = words

    def _word(self, m: re.Match) -> str:
        w = m.group()
        if not _FOREIGN.search(w):
            return w
        others = [c for c in w if "\u0370" <= c <= "\u058f"]
        if not all(c in self.twin_letters for c in others):
            return w
        mixed = any(not "\u0300" <= c <= "\u058f" or ord(c) in LATIN_MARKS for c in w)
        return w.translate(self.twins) if mixed or w in self.words else w

    def __call__(self, text: str) -> str:
        if not self.suspect.search(text):
            return text
        while True:
            out, at = [], 0
            for end, (n, to) in self.automaton.iter_long(text):
                out.append(text[at : end + 1 - n])
                out.append(to)
                at = end + 1
            out.append(text[at:])
            new = re.sub("[\U000e0000-\U000e0fff]", "", "".join(out))
            if _FOREIGN.search(new):
                new = _WORD.sub(self._word, new)
            if new == text:
                return text
            text = new


_CLASSES: list[Classes] = []


def _classes() -> Classes:
    if not _CLASSES:
        _CLASSES.append(build_classes())
    return _CLASSES[0]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """('m', class member, n), ('f', word wholly of Latin twins in another alphabet, n), ('l', word of letters that have such twins, n)."""
    members = [m for ms in _classes().members().values() for m in ms if m]
    total = np.zeros(_LAST, dtype=np.int64)
    several = {m: 0 for m in members if len(m) > 1}
    automaton = ahocorasick.Automaton()
    for m in several:
        automaton.add_word(m, m)
    automaton.make_automaton()
    tokens, foreign, latin = Counter(), Counter(), Counter()

    def fold() -> None:
        for token, n in tokens.items():
            for w in twin_words(token):
                foreign[w] += n
            for w in _LATIN_TWIN.findall(token):
                latin[w] += n
        tokens.clear()

    for batch in batches:
        for column in batch.columns:
            texts = [t for t in column.to_pylist() if t]
            for at in range(0, len(texts), 2000):
                joined = "\n".join(texts[at : at + 2000])
                codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                total += np.bincount(codes[codes < _LAST], minlength=_LAST)
                for _, m in automaton.iter(joined):
                    several[m] += 1
                tokens.update(joined.split())
                if len(tokens) > 500_000:
                    fold()
    fold()
    rows = [("m", m, int(total[ord(m)]) if len(m) == 1 else several[m]) for m in members] + [("f", w, n) for w, n in foreign.items()] + [("l", w, n) for w, n in latin.items()]
    rows = [r for r in rows if r[2]]
    for at in range(0, max(1, len(rows)), 100_000):
        part = rows[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.string()), pa.array([r[2] for r in part], pa.int64())], names=["kind", "member", "n"])


class Forms(NamedTuple):
    """The rewriting of a corpus: class member -> representative, and the imitating words, as a set or, where there are too many, as a table (word)."""

    mapping: dict[str, str]
    words: frozenset[str] | DataFrame


def corpus_forms(*texts: DataFrame) -> Forms:
    """The rewriting of a corpus (one-column frames), told by its frequencies. At most one row for each member of the fixed class table reaches the driver, a few thousand, and the imitating words up to BROADCAST_WORDS."""
    parts = [t.toDF("t").mapInArrow(_count_batches, "kind string, member string, n long") for t in texts]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    counts = cut(union.groupBy("kind", "member").agg(F.sum("n").alias("n")))
    mapping = representatives(_classes(), {r["member"]: r["n"] for r in counts.where("kind = 'm'").collect()})
    twins = "".join(TWINS), "".join(TWINS.values())
    foreign = counts.where("kind = 'f'").select(F.col("member").alias("word"), F.col("n").alias("foreign_n"), F.translate("member", *twins).alias("latin"))
    latin = counts.where("kind = 'l'").select(F.col("member").alias("latin"), F.col("n").alias("latin_n"))
    words = cut(foreign.join(latin, "latin").where("latin_n > foreign_n").select("word"))
    return Forms(mapping, frozenset(r["word"] for r in words.collect()) if words.count() <= BROADCAST_WORDS else words)


def static_mapping() -> dict[str, str]:
    """The rewriting without frequencies: of several ordinary members the lowest."""
    return representatives(_classes(), {})


def _with_words(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``texts`` (table_name, id, text) with the imitating words each holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(t, i, w) for t, i, text in zip(*(c.to_pylist() for c in batch.columns)) if text for w in set(twin_words(text))]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string()))], names=["table_name", "id", "word"])

    held = texts.mapInArrow(run, "table_name string, id long, word string").join(words, "word").groupBy("table_name", "id").agg(F.collect_set("word").alias("words"))
    return texts.join(held, ["table_name", "id"], "left")


def canonical(texts: DataFrame, forms: Forms) -> DataFrame:
    """(table_name, id, text, changed) from (table_name, id, text): every text in its consistent form. No shuffle, unless the imitating words are too many to broadcast."""
    mapping, words = forms
    by_row = not isinstance(words, frozenset)
    known = frozenset() if by_row else words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(mapping, known)
        for batch in batches:
            before, after = batch.column(2).to_pylist(), []
            own = batch.column(3).to_pylist() if by_row else None
            for k, t in enumerate(before):
                if own is not None:
                    rewrite.words = frozenset(own[k] or ())
                after.append(t if t is None else rewrite(t))
            changed = [a is not b and a != b for a, b in zip(after, before)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(after, pa.string()), pa.array(changed, pa.bool_())], names=["table_name", "id", "text", "changed"])

    rows = _with_words(texts, words) if by_row else texts
    return rows.mapInArrow(run, "table_name string, id long, text string, changed boolean")


def titles_and_chunks(documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, Forms]:
    """((table_name, id, text) of documents.title and chunks.text, their forms)."""
    forms = corpus_forms(documents.select("title"), chunks.select("text"))
    rows = documents.select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("id"), F.col("title").alias("text")).unionByName(
        chunks.select(F.lit("chunks").alias("table_name"), F.col("id"), F.col("text"))
    )
    return rows, forms


def found(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(table_name, id) of the values whose consistent form differs from what is stored."""
    return canonical(*titles_and_chunks(documents, chunks)).where("changed").select("table_name", "id").distinct()
