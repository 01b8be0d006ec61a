"""Problem 7: encoding of the whole corpus with a public byte-level BPE tokenizer.

Method: the merge list is compiled into a deterministic automaton over tokens, one gadget for each merge in order. The
gadget of (u, v) -> w removes the arc v after u, adds the arc w wherever u was an arc, and gives w the state of v at
that moment. A token sequence is the encoding of its bytes exactly if every arc exists, and each prefix of a word has
exactly one last token, so a word is encoded by table-driven transitions over its prefixes and read back from the end;
decoding emits arc labels. Arcs are composed from the gadgets when first needed and kept in a table.

Defined cases: null and empty text give an empty list; special-token strings in a text are ordinary text; texts of any
length are encoded whole; extra columns are ignored; repeated rows are encoded as they are.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The public pre-split pattern of byte-level BPE vocabularies of this family.
PRE_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded pieces kept by a worker; beyond that the table starts anew, which changes no result.
KEPT_PIECES = 200_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1 stands for itself, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """The automaton of a merge list. Tokens are ids; ``born`` is the gadget that made a token, -1 for single bytes."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids: dict[bytes, int] = {bytes([b]): vocabulary[c] for c, b in letters.items()}
        self.labels: dict[int, bytes] = {i: b for b, i in self.ids.items()}
        self.born: dict[int, int] = dict.fromkeys(self.labels, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.gadget: dict[tuple[int, int], int] = {}
        for time, (a, b) in enumerate(merges):
            u, v, w = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.gadget[u, v] = time
            if w not in self.born:  # a second merge to the same token is never reached by valid input
                self.born[w], self.parts[w] = time, (u, v)
                label = raw(a + b)
                self.ids[label], self.labels[w] = w, label
        self.longest = max(map(len, self.ids))
        self.arcs: dict[tuple[int, int], bool] = {}

    def follows(self, q: int, x: int) -> bool:
        """Whether the compiled automaton has an arc x after q."""
        key = (q, x)
        known = self.arcs.get(key)
        if known is None:
            known = self.arcs[key] = self._arc(q, x)
        return known

    def _arc(self, q: int, x: int) -> bool:
        limit, inclusive = len(self.gadget), True  # the time up to which gadgets count, and whether that one counts
        while True:
            at = self.gadget.get((q, x))
            if at is not None and (at < limit or inclusive and at == limit):
                return False
            a, b = self.born[q], self.born[x]
            if a < 0 and b < 0:
                return True
            if a > b:  # q got the state of its right part just before gadget a took effect
                limit, inclusive, q = a, False, self.parts[q][1]
            elif b > a:  # x became an arc wherever its left part was one when gadget b took effect
                limit, inclusive, x = b, True, self.parts[x][0]
            else:
                limit, inclusive, q, x = a, False, self.parts[q][1], self.parts[x][0]

    def encode(self, word: bytes) -> list[int]:
        """The ids of one pre-split word: for each prefix the only last token that the automaton reaches."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        n, ids, follows = len(word), self.ids, self.follows
        last: list[int] = [-1] * (n + 1)
        length = [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                token = ids.get(word[start:end])
                if token is not None and (start == 0 or follows(last[start], token)):
                    last[end], length[end] = token, end - start
                    break
        out, end = [], n
        while end:
            out.append(last[end])
            end -= length[end]
        return out[::-1]

    def decode(self, ids) -> bytes:
        return b"".join(self.labels[i] for i in ids)


class _Kept(dict):
    """Encodings of pieces, each made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str):
        got = self.make(piece)
        if len(piece) < 64:
            self[piece] = got
        return got


class Encoder:
    """Whole texts by the automaton; pieces between single spaces are encoded once and kept.

    A space between two characters that are not white space always starts a pre-split word, so a text is cut there. A text
    with other white space beside a space is pre-split as a whole.
    """

    def __init__(self, automaton: MergeAutomaton):
        self.automaton, self.split = automaton, regex.compile(PRE_SPLIT)
        self.mixed = re.compile(r"\s \S|\S \s|\s \s|^ | $")
        self.kept = _Kept(lambda piece: self._bytes(" " + piece))
        self.lengths = _Kept(lambda piece: len(self._bytes(" " + piece)) // 4)

    def _bytes(self, piece: str) -> bytes:
        out = array("i")
        for word in self.split.findall(piece):
            out.extend(self.automaton.encode(word.encode("utf-8")))
        return out.tobytes()

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as consecutive native 32-bit integers."""
        if not text:
            return b""
        if self.mixed.search(text):
            return self._bytes(text)
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        head, *rest = text.split(" ")
        return self._bytes(head) + b"".join(map(self.kept.__getitem__, rest))

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.encode_bytes(text)).tolist()

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.mixed.search(text):
            return len(self._bytes(text)) // 4
        if len(self.lengths) > KEPT_PIECES:
            self.lengths.clear()
        head, *rest = text.split(" ")
        return len(self._bytes(head)) // 4 + sum(map(self.lengths.__getitem__, rest))


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, compiled once for each Python worker."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        _LOADED[path] = Encoder(MergeAutomaton(model["vocab"], merges))
    return _LOADED[path]


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of every text; an empty list for empty and null. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                coded = [enc.encode_bytes(text) for text in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} long, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, n_tokens) of every text; 0 for empty and null. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            counts = pa.array([enc.count(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=[id_col, "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} long, n_tokens long")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, text): the text of every list of ids, by the labels of the arcs; empty for none. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = encoder(path).automaton
        for batch in batches:
            texts = [automaton.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"{id_col} long, text string")
