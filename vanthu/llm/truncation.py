"""Problem 9: texts cut off by field limits or in transfer.

Method: a vocabulary trie of the corpus; a text whose final token is an unknown proper prefix of known words was cut. Two
further kinds of evidence are combined with it: lengths at which a source's unfinished texts pile up, and the corpus's own
n-grams (a final token that, after the word before it, is far more often the beginning of a longer word; final words that
never end a sentence or line elsewhere). Only texts without a finished ending are looked at: a sentence end, table row or
bracketed closing note, or a last line of a shape (capitals and numbers masked) in which at least one document in a thousand
ends, as signatures, distribution lists and closing notes do; a last line of more than 80 characters is none of these. What
a transfer leaves behind a cut (dots, replacement characters, half escapes) is taken off first.

The trie is a table, one row for each node and each word below it, so it is as distributed as the vocabulary; only the nodes
that some text ends in are kept. Whether a word is known is told by its share of all words, so the same text is judged alike
in a corpus of any size.

Defined cases: null, empty and blank texts are no case; texts of any length are read whole; a null source has its own
length statistics; repeated rows give one row; ties in counts change nothing; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from vanthu.runtime import cut

#: What a transfer leaves behind a cut: white space, dots, replacement characters, half escapes and entities.
_RESIDUE = re.compile(r"(?:\s+|…|\.{2,}|�+|\\u?[0-9a-fA-F]{0,4}|&#?\w{0,6}|\[…\]|\[\.\.\.\]|<[^<>\n]{0,40})+\Z")
_STRONG = re.compile(r"�|\\u?[0-9a-fA-F]{0,3}\s*\Z|…|\.{3}|&#?\w{0,6}\s*\Z")
_AND_SO_ON = re.compile(r"(?:v\.\s?v|etc)\s*\.{0,3}\s*\Z", re.I)
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_ENDS = tuple(".;:!?|")
MIN_SHARE = 1e-6  # a word is known from this share of all words on (and three occurrences), so at most 10^6 are known
#: n-grams seen at least so often decide; an end in less than this share of them means the sentence went on.
SEEN, END_SHARE = 6, 0.02
#: A last line closes documents if at least this share of all documents, and three, end in its shape; so at most 1,000 shapes do.
CLOSING_SHARE = 1e-3
_DIGIT = re.compile(r"\d")
_CAPITAL = re.compile(r"[^\W_]+")


def core_of(text: str) -> tuple[str, bool]:
    """(the text without what a transfer left behind, whether it left something that no author writes)."""
    stripped = text.rstrip()
    if _AND_SO_ON.search(stripped[-12:]):
        return stripped, False
    at, go_on = len(text), True
    while go_on:  # a residue that reaches back to where the search began may go on before it
        begin = max(0, at - 80)
        m = _RESIDUE.search(text, begin, at)
        go_on = bool(m) and m.start() == begin and begin > 0
        at = m.start() if m else at
    left = text[at:]
    if not left.strip():
        return stripped, False
    return text[:at], bool(_STRONG.search(left))


def finished(core: str) -> bool:
    """Whether the last line ends as a sentence, table row or bracketed note does."""
    if _AND_SO_ON.search(core[-12:]) or core[-1:] in (".", "!", "?", "|"):
        return True
    line = core[core.rfind("\n") + 1 :].strip()
    return line.startswith("(") and line.endswith(")")


def shape_of(core: str) -> str | None:
    """The last line with tokens of capitals and digits masked; null for lines longer than a closing line."""
    line = unicodedata.normalize("NFC", core[core.rfind("\n") + 1 :]).strip()
    if len(line) > 80:
        return None
    return " ".join("A" + t[len(_CAPITAL.match(t).group()) :] if _CAPITAL.match(t) and t.upper() == t else t for t in line.split())


def word_of(token: str) -> str:
    return _DIGIT.sub("0", _EDGE.sub("", token).lower())


def _code(word: str) -> int:
    b = word.encode()
    return zlib.crc32(b) << 31 ^ zlib.crc32(b[::-1] + b"#")


def _grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of two and three consecutive words, by the position of the last."""
    c = codes.astype(np.uint64)
    two = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] * np.uint64(0xFF51AFD7ED558CCD) + c[2:] * np.uint64(0x165667B19E3779F9) + np.uint64(7)
    return two.view(np.int64), three.view(np.int64)


def gram_key(words: list[str]) -> int:
    two, three = _grams(np.array([_code(w) for w in words], dtype=np.uint64))
    return int(three[0]) if len(words) == 3 else int(two[0])


class _Tokens(dict):
    """token -> (code, whether it ends a sentence)."""

    def __missing__(self, token: str) -> tuple[int, int]:
        got = (_code(word_of(token)), int(token.rstrip("\"')”").endswith(_ENDS)))
        if len(token) < 40:
            self[token] = got
        return got


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partition sums: ('w', word, n) and ('g', n-gram key, n, ends). The last word of a text is left out of the n-grams: whether it ends anything is the question."""
    words: Counter = Counter()
    tokens = _Tokens()
    keys, ends = [], []
    sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fold() -> None:
        nonlocal keys, ends
        if keys:
            k, e = np.concatenate(keys), np.concatenate(ends)
            u, inv, n = np.unique(k, return_inverse=True, return_counts=True)
            sums.append((u, n, np.bincount(inv, weights=e, minlength=len(u)).astype(np.int64)))
            keys, ends = [], []
            if len(sums) > 1:  # merge, so memory follows the number of distinct n-grams
                k = np.concatenate([s[0] for s in sums])
                u, inv = np.unique(k, return_inverse=True)
                merged = [np.bincount(inv, weights=np.concatenate([s[j] for s in sums]), minlength=len(u)).astype(np.int64) for j in (1, 2)]
                sums[:] = [(u, *merged)]

    held = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            flat: list[str] = []
            line_ends: list[int] = []
            for line in text.splitlines():
                flat += line.split()
                line_ends.append(len(flat) - 1)
            if len(tokens) > 300_000:
                tokens.clear()
            words.update(flat)
            if len(flat) < 3:
                continue
            pairs = np.array(list(map(tokens.__getitem__, flat)), dtype=np.uint64)
            end = pairs[:, 1].astype(np.int64)
            end[[i for i in line_ends if i >= 0]] = 1
            two, three = _grams(pairs[:, 0])
            keys += [two[:-1], three[:-1]]
            ends += [end[1:-1], end[2:-1]]
            held += 2 * len(flat)
            if held > 2_000_000:
                fold()
                held = 0
    fold()
    folded: Counter = Counter()
    for token, n in words.items():
        folded[word_of(token)] += n
    rows = [(w, n) for w, n in folded.items() if w]
    for at in range(0, len(rows), 100_000):
        part = rows[at : at + 100_000]
        none = pa.nulls(len(part), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), none, pa.array([n for _, n in part], pa.int64()), none], names=["word", "gram", "n", "ends"])
    for u, n, e in sums:
        for at in range(0, len(u), 100_000):
            s = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(u[s]), pa.string()), pa.array(u[s]), pa.array(n[s]), pa.array(e[s])], names=["word", "gram", "n", "ends"])


_TAIL = "doc_id long, source string, chars int, bytes int, open boolean, strong boolean, w1 string, w2 string, g2 long, g3 long, stop boolean, shape string"


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text that is not blank: its core's lengths, and the last words where the ending is open."""
    for batch in batches:
        rows = []
        for doc_id, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not text or not text.strip():
                continue
            core, strong = core_of(text)
            is_open = not finished(core)
            w1 = w2 = None
            g2 = g3 = None
            stop, shape = False, None
            if is_open:
                shape = shape_of(core)
                words = core.rsplit(None, 3)[-3:]
                last = words[-1] if words else ""
                stop = last[-1:] in (",", ";", ":", "(", "/")
                tail = [word_of(w) for w in words[-3:]]
                if tail:
                    w2 = tail[-1]
                    if len(tail) > 1 and not words[-2].endswith(_ENDS):
                        w1, g2 = tail[-2], gram_key(tail[-2:])
                    if len(tail) == 3:
                        g3 = gram_key(tail)
            rows.append((doc_id, source, len(core), len(core.encode()), is_open, strong, w1, w2, g2, g3, stop, shape))
        cols = list(zip(*rows)) if rows else [[] for _ in range(12)]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _TAIL.split(", ")])


def trie(words: DataFrame, ends: DataFrame) -> DataFrame:
    """(node, word): of the vocabulary trie of ``words`` (word) the nodes in ``ends`` (node), with the words that properly extend them."""
    nodes = words.where(F.length("word") > 1).select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring("word", F.lit(1), k))).alias("node"))
    return nodes.join(ends, "node")


def _gram_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1, w2, gram) of (w1, w2, word): the key of w1 and word."""
    for batch in batches:
        grams = [gram_key([a, w]) for a, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grams, pa.int64())], names=["w1", "w2", "gram"])


def _piles(tails: DataFrame) -> DataFrame:
    """(doc_id): open texts whose length in characters or bytes is one at which their source's open texts pile up.

    Lengths are counted before any window is formed. A pile holds at least four texts, and eight times as many as lengths
    within 300 on either side would let expect; a byte limit can split a character, so three lengths count as one.
    """
    lens = tails.select("doc_id", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("unit"), F.col(k).alias("len")) for k in ("chars", "bytes")])).alias("l")).select("doc_id", "source", "l.unit", "l.len")
    counts = lens.groupBy("source", "unit", "len").agg(F.count(F.lit(1)).alias("n"))
    key = W.partitionBy("source", "unit").orderBy("len")
    wide = F.when(F.col("unit") == "bytes", 5).otherwise(1)
    near = F.when(F.col("unit") == "bytes", F.sum("n").over(key.rangeBetween(-2, 2))).otherwise(F.col("n"))
    around = F.sum("n").over(key.rangeBetween(-300, 300))
    piles = counts.withColumn("near", near).withColumn("around", around).where((F.col("near") >= 4) & (F.col("near") >= 8 * wide * (F.col("around") - F.col("near")) / 600))
    same = (piles["unit"] == lens["unit"]) & (piles["len"] == lens["len"]) & piles["source"].eqNullSafe(lens["source"])
    return lens.join(piles.select("source", "unit", "len"), same, "left_semi").select("doc_id").distinct()


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, evidence) of the texts that were cut."""
    docs = documents.select("doc_id", "source", "text")
    stats = cut(docs.select("text").mapInArrow(_gather, "word string, gram long, n long, ends long").groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).where("word is null or n >= 3"))
    tails = cut(docs.mapInArrow(_tails, _TAIL))
    least = max(3, CLOSING_SHARE * tails.count())
    closing = tails.where("open and not strong and shape is not null").groupBy("shape").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least).select("shape")
    tails = cut(tails.where("open").join(F.broadcast(closing), "shape", "left_anti"))
    words = stats.where("word is not null").select("word", "n")
    total = words.agg(F.sum("n")).first()[0] or 0
    known = words.where(F.col("n") >= max(3, MIN_SHARE * total)).select("word")
    grams = stats.where("word is null").select("gram", "n", "ends")
    pairs = tails.where(F.col("w2").rlike(r"^[\p{L}]+$")).select("w1", "w2").distinct()
    below = cut(trie(known, pairs.select(F.col("w2").alias("node")).distinct()))
    unknown = below.select(F.col("node").alias("w2")).distinct().join(known, F.col("w2") == F.col("word"), "left_anti").select("w2", F.lit(True).alias("unknown"))
    asked = pairs.where("w1 is not null").join(unknown, "w2", "left_anti").join(below.withColumnRenamed("node", "w2"), "w2").select("w1", "w2", "word")
    longer = asked.mapInArrow(_gram_of, "w1 string, w2 string, gram long").join(grams, "gram").groupBy("w1", "w2").agg(F.sum("n").alias("longer"))
    two, three = (grams.select(F.col("gram").alias(f"g{i}"), F.col("n").alias(f"n{i}"), F.col("ends").alias(f"e{i}")) for i in (2, 3))
    rows = tails.join(two, "g2", "left").join(three, "g3", "left").join(unknown, "w2", "left").join(longer, ["w1", "w2"], "left").join(_piles(tails).withColumn("pile", F.lit(True)), "doc_id", "left")
    n2, e2, n3, e3 = (F.coalesce(F.col(c), F.lit(0)) for c in ("n2", "e2", "n3", "e3"))
    goes_on = F.when(n3 >= SEEN, e3 < END_SHARE * n3).when(n2 >= SEEN, e2 < END_SHARE * n2).otherwise(False)
    fragment = (F.coalesce(F.col("longer"), F.lit(0)) >= 3) & (F.col("longer") > 5 * n2) & (e2 <= F.col("longer") / 20)
    evidence = F.when(F.col("strong"), "transfer").when(F.col("unknown"), "word").when(F.col("pile"), "length").when(F.col("stop"), "stop").when(fragment, "fragment").when(goes_on, "sentence")
    return rows.select("doc_id", "source", evidence.alias("evidence")).where("evidence is not null")


def found(documents: DataFrame) -> DataFrame:
    """(doc_id) of the texts that were cut."""
    return truncated(documents).select("doc_id").distinct()


def by_source(documents: DataFrame) -> DataFrame:
    """(source, documents, cut, share): for each source the share of its documents that are cut."""
    cuts = truncated(documents).groupBy("source").agg(F.count_distinct("doc_id").alias("cut"))
    all_docs = documents.groupBy("source").agg(F.count_distinct("doc_id").alias("documents"))
    joined = all_docs.join(cuts, all_docs["source"].eqNullSafe(cuts["source"]), "left")
    return joined.select(all_docs["source"], "documents", F.coalesce("cut", F.lit(0)).alias("cut"), F.round(F.coalesce("cut", F.lit(0)) / F.col("documents"), 6).alias("share"))
