"""Count-only unigram tokenisation.

The text is cut before each space, as the public unigram tokenizers do: a piece never
reaches over a word's start, so a text's count is the sum of its words' counts.  For a
word, an Aho-Corasick automaton lists the vocabulary entries that end at each place,
longest first; dynamic programming carries the best score and its number of pieces.

Tie rules: a candidate replaces the best one only if its score is greater, so of equal
segmentations the one whose last piece is longest wins.  A character that no entry
covers alone is unknown, with the lowest score less 10; neighbouring unknown
characters are one piece, or as many byte pieces as they have bytes where the
vocabulary has all of them.

The vocabulary comes from a public model file whose place is a parameter; it is read
once by the driver and refused above ``MAX_BYTES``, so what is sent to the tasks is
bounded.  Counts of words of up to ``LONGEST`` characters are remembered by each task, up to ``CACHE`` words.

Defined results: a null or empty text has 0 tokens.  Repeated rows each get a result.
``count_tokens`` gives the id and counts only, so no column can clash.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_BYTES, CACHE = 16_000_000, 400_000
#: Longer words are counted each time, so that what is remembered is bounded in bytes too.
LONGEST = 64
SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift += 7
            at += 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        elif key & 7 == 2:
            size, at = number(at)
            value, at = raw[at : at + size], at + size
        else:
            size = 4 if key & 7 == 5 else 8
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def read_vocabulary(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a model file; kinds: 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte."""
    with open(path, "rb") as f:
        raw = f.read(MAX_BYTES + 1)
    if len(raw) > MAX_BYTES:
        raise ValueError(f"{path} has more than {MAX_BYTES} bytes")
    out = []
    for field, value in _fields(raw):
        if field == 1:
            piece, score, kind = "", 0.0, 1
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    (score,) = struct.unpack("<f", v)
                elif k == 3:
                    kind = v
            out.append((piece, score, kind))
    return out


class Unigram:
    """Counts the pieces of the best segmentation under unigram scores."""

    def __init__(self, vocabulary: list[tuple[str, float, int]]):
        entries = {p: s for p, s, kind in vocabulary if kind in (1, 4) and p}
        self.automaton = ahocorasick.Automaton()
        for piece, score in entries.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = frozenset(p for p in entries if len(p) == 1)
        self.unknown = min((s for _, s, _ in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.bytes = sum(kind == 6 for *_, kind in vocabulary) == 256
        self.cache: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of one word, its leading space mark included."""
        n = len(word)
        # best[k]: score, pieces, and whether the last piece is unknown, of the first k characters.
        best: list = [None] * (n + 1)
        best[0] = (0.0, 0, False)
        ends: list[list] = [[] for _ in range(n + 1)]
        for end, entry in self.automaton.iter(word):
            ends[end + 1].append(entry)
        for end in range(1, n + 1):
            top = None
            for size, score in sorted(ends[end], reverse=True):
                before = best[end - size]
                if top is None or before[0] + score > top[0]:
                    top = (before[0] + score, before[1] + 1, False)
            c = word[end - 1]
            if c not in self.single:
                score, pieces, unknown = best[end - 1]
                if top is None or score + self.unknown > top[0]:
                    more = len(c.encode("utf-8", "surrogatepass")) if self.bytes else int(not unknown)
                    top = (score + self.unknown, pieces + more, True)
            best[end] = top
        return best[n][1]

    def count(self, text: str | None) -> int:
        """Pieces of a text."""
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        words = text[text[0] == SPACE :].split(SPACE)
        total, cache = 0, self.cache
        for w in words:
            k = cache.get(w)
            if k is None:
                if len(cache) >= CACHE:
                    cache.clear()
                k = self.word(SPACE + w)
                if len(w) <= LONGEST:
                    cache[w] = k
            total += k
        return total


def _counter(vocabulary) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram(vocabulary.value)
        for batch in batches:
            counts = [model.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, *, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_counter(vocabulary), f"doc_id {kind}, n_tokens long")
