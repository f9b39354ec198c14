"""Alignment of two tokenizers over the same texts.

Each text is cut into tokens by a byte-level BPE file (A, over a space and the text) and by
a piece BPE model (B, which adds the space itself).  Both cover the same bytes, so the ends
of their tokens are two rising lists; merging them tells which tokens overlap and where
both end, which cuts the tokens into groups.

The merge is partitioned by merge paths: on each diagonal of the grid of A ends and B
ends, ``PIECE`` steps apart, a binary search finds how many ends of either side come
before it.  Between two diagonals lies a piece of exactly that many steps, independent of
all others; the pieces of a batch advance side by side, one step at a time.  Every piece
emits its overlaps and the places where both end; laid in order these are the whole merge,
and a group that a diagonal has cut is stitched, as it reaches from one common end to the
next, whatever pieces they lie in.  A long text is many pieces, a short one a part of one.

Token texts aren't shuffled.  Rows are written once with their tokens' digest and the pairs
of ids that they link (each pair once, with its count); the counts of the pairs are summed
over all rows, and sent to the tasks in blocks of at most ``BLOCK`` pairs.  Each block is one
pass over the written pairs, and what the passes add up is summed by row.

Tokenizing is exact for any text.  A text is cut at the single spaces between two
characters that aren't white space, where both tokenizers always cut (A's pattern begins
a word there, and no piece of B goes on past a space); parts of up to ``LONGEST``
characters are tokenized once and remembered, up to ``CACHE`` of them.

Defined results: a null or empty text, and one whose B tokens don't spell it (because it
has U+2581, or characters that the model changes), has no tokens: zeros and an empty
digest.  Repeated rows count each.  An empty table gives an empty result.  Only named
columns are read, so no column can clash.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import cut

FILE_A, FILE_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Steps of a piece; characters of texts that are merged together, a longer text alone.
PIECE, BATCH_CHARS = 512, 2_000_000
CACHE, LONGEST = 800_000, 64
#: Parts that are tokenized in one text.
IN_LINE = 20_000
#: Pairs that are sent to the tasks at once, 13 bytes each.
BLOCK = 4_000_000
SPACE = "▁"
#: A pair of ids as one number.
RADIX = 1 << 15
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r" \s|\s |^\s|\s$")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizer:
    """Ids of parts of texts, and the length in bytes of every id's token."""

    def __init__(self, encode: Callable[[list[str]], list[Sequence[int]]], tokens: list[bytes]):
        self.encode, self.tokens = encode, tokens
        self.length = np.array([len(t) for t in tokens], np.int64)


@lru_cache(1)
def tokenizer_a(path: str) -> Tokenizer:
    from tokenizers import Tokenizer as Library

    t = Library.from_file(path)
    t.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        special = {x["id"] for x in json.load(f).get("added_tokens", ())}
    letters, size = byte_letters(), t.get_vocab_size()
    entries = [t.id_to_token(k) for k in range(size)]
    tokens = [x.encode() if k in special else bytes(letters[c] for c in x) for k, x in enumerate(entries)]
    return Tokenizer(lambda texts: [e.ids for e in t.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)], tokens)


@lru_cache(1)
def tokenizer_b(path: str) -> Tokenizer:
    import sentencepiece

    t = sentencepiece.SentencePieceProcessor(model_file=path)
    if (size := t.get_piece_size()) > RADIX:
        raise ValueError(f"{path} has more than {RADIX} pieces")
    tokens = [bytes([int(p[3:5], 16)]) if t.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(map(t.id_to_piece, range(size)))]
    if any(re.search(f"[^{SPACE}]{SPACE}", t.id_to_piece(k)) for k in range(size)):
        raise ValueError(f"{path} has pieces that go on past a space")
    return Tokenizer(lambda texts: t.encode(texts, num_threads=1), tokens)


def parts_of(text: str) -> list[str]:
    """The parts of a text between single spaces with no white space beside them."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


class Parts:
    """Token ids of parts of texts, remembered side by side in the order in which they were learnt."""

    def __init__(self, a: Tokenizer, b: Tokenizer):
        self.of = (a, b)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.size = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.good = np.zeros(0, bool)

    def _add(self, parts: list[str], ids: list[np.ndarray], sizes: list, good: list[bool]) -> None:
        self.index.update(zip(parts, range(len(self.good), len(self.good) + len(parts)), strict=True))
        self.good = np.append(self.good, good)
        for k in (0, 1):
            self.ids[k] = np.append(self.ids[k], ids[k])
            self.size[k] = np.append(self.size[k], sizes[k])

    def _spelt(self, k: int, ids: np.ndarray) -> bytes:
        return b"".join(map(self.of[k].tokens.__getitem__, ids.tolist()))

    def _alone(self, parts: list[str]) -> None:
        """Tokenize each part by itself."""
        ids = [[np.array(x, np.int32) for x in t.encode(parts)] for t in self.of]
        good = [all(self._spelt(k, ids[k][m]) == b" " + p.encode() for k in (0, 1)) for m, p in enumerate(parts)]
        self._add(parts, [np.concatenate(x) for x in ids], [[len(y) for y in x] for x in ids], good)

    def _in_line(self, parts: list[str]) -> None:
        """Tokenize parts without white space at their ends in one text, and each by itself if that doesn't spell them all."""
        ends, line = np.cumsum([1 + len(p.encode()) for p in parts]), " ".join(parts)
        ids = [np.array(t.encode([line])[0], np.int32) for t in self.of]
        if any(self._spelt(k, ids[k]) != b" " + line.encode() for k in (0, 1)):
            return self._alone(parts)
        place = [np.searchsorted(np.cumsum(t.length[x]), ends) + 1 for t, x in zip(self.of, ids, strict=True)]
        self._add(parts, ids, [np.diff(p, prepend=0) for p in place], [True] * len(parts))

    def tokens(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Ids of all texts side by side and their number by text, of A and of B, and which texts both spell.

        Texts aren't empty.
        """
        if len(self.index) > CACHE:
            self.clear()
        cut_up = [parts_of(t) for t in texts]
        flat = [p for parts in cut_up for p in parts]
        new = [p for p in dict.fromkeys(flat) if p not in self.index]
        short = [p for p in new if len(p) <= LONGEST]
        plain = [p for p in short if p and not p[0].isspace() and not p[-1].isspace()]
        for k in range(0, len(plain), IN_LINE):
            self._in_line(plain[k : k + IN_LINE])
        if odd := [p for p in short if p not in self.index]:
            self._alone(odd)
        stay = len(self.good)
        if long := [p for p in new if len(p) > LONGEST]:
            self._alone(long)
        n = np.array([len(p) for p in cut_up])
        begin = np.append(0, np.cumsum(n))[:-1]
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        good = np.logical_and.reduceat(self.good[at], begin)
        out = []
        for k in (0, 1):
            start = np.append(0, np.cumsum(self.size[k]))[:-1]
            mine = self.size[k][at]
            mine[~np.repeat(good, n)] = 0
            ids = self.ids[k][np.repeat(start[at] - np.append(0, np.cumsum(mine))[:-1], mine) + np.arange(mine.sum())]
            out.append((ids, np.add.reduceat(mine, begin)))
        for p in long:  # so that what is remembered is bounded in bytes too
            del self.index[p]
        self.good = self.good[:stay]
        for k in (0, 1):
            self.size[k] = self.size[k][:stay]
            self.ids[k] = self.ids[k][: self.size[k].sum()]
        return *out, good


def split_points(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many ends of a lie before each diagonal of the merge of two sorted lists, a first of equals: binary searches of all at once."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (live := np.flatnonzero(low < high)).size:
        mid = (low[live] + high[live]) // 2
        more = a[mid] <= b[diagonals[live] - mid - 1]
        low[live[more]] = mid[more] + 1
        high[live[~more]] = mid[~more]
    return low


def merge(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of two token lists over the same bytes -> (A token, B token) of each overlap, and (A, B tokens) before each common end.

    The third array holds the common ends as rows of two.
    """
    total = len(a) + len(b)
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none.reshape(0, 2)
    starts = np.arange(0, total, piece)
    i = split_points(a, b, starts)
    j = starts - i
    lanes = len(starts)
    steps = np.minimum(piece, total - starts)
    far_a, far_b = np.append(a, np.iinfo(np.int64).max), np.append(b, np.iinfo(np.int64).max)
    last = np.maximum(np.where(i > 0, a[i - 1], 0), np.where(j > 0, b[j - 1], 0))
    shape = (min(piece, total), lanes)
    link, left, right = np.zeros(shape, bool), np.zeros(shape, np.int32), np.zeros(shape, np.int32)
    both = np.zeros(shape, bool)
    for t in range(shape[0]):
        x, y = far_a[i], far_b[j]
        from_a = x <= y
        end = np.minimum(x, y)
        live = t < steps
        link[t] = live & (end > last)
        left[t], right[t] = i, j
        # A common end is met twice, A's first; the second meeting moves no byte.
        both[t] = live & ~from_a & (end == last)
        last = np.where(live, end, last)
        i = i + (from_a & live)
        j = j + (~from_a & live)
    # Pieces in order, the steps of each in order: groups that a diagonal cut are whole again.
    link, both, left, right = link.T.ravel(), both.T.ravel(), left.T.ravel(), right.T.ravel()
    return left[link], right[link], np.stack([left[both], right[both] + 1], 1)


@lru_cache(4)
def _digits(size: int) -> np.ndarray:
    """Ids with each of the three marks after them, as fixed-width bytes; id * 3 + mark."""
    return np.array([f"{k}{m}".encode() for k in range(size) for m in ",|;"])


def group_bytes(ids_a: np.ndarray, ids_b: np.ndarray, ends: np.ndarray, first: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text; first are the numbers of groups before each text, with the whole number last."""
    n_a, n_b = np.diff(ends[:, 0], prepend=0), np.diff(ends[:, 1], prepend=0)
    of_a, of_b = np.repeat(np.arange(len(ends)), n_a), np.repeat(np.arange(len(ends)), n_b)
    width = max(int(ids_a.max(initial=0)), int(ids_b.max(initial=0))) + 1
    keys = np.zeros(len(ids_a) + len(ids_b), np.int64)
    mark_a, mark_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    mark_a[ends[:, 0] - 1], mark_b[ends[:, 1] - 1] = 1, 2
    keys[np.arange(len(ids_a)) + np.append(0, ends[:, 1])[of_a]] = ids_a.astype(np.int64) * 3 + mark_a
    keys[np.arange(len(ids_b)) + ends[of_b, 0]] = ids_b.astype(np.int64) * 3 + mark_b
    table = _digits(1 << (width - 1).bit_length())
    at = np.append(0, ends.sum(1))[first]
    return [table[keys[s:e]].tobytes().translate(None, b"\0")[:-1] for s, e in zip(at[:-1], at[1:], strict=True)]


@dataclass
class Aligned:
    """What a batch of texts gives, by text: numbers, digests, and the distinct pairs with their counts."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    pairs: list[np.ndarray]
    times: list[np.ndarray]


def align(parts: Parts, texts: list[str], piece: int = PIECE) -> Aligned:
    (ids_a, n_a), (ids_b, n_b), _ = parts.tokens(texts)
    n = len(texts)
    left, right, ends = merge(np.cumsum(parts.of[0].length[ids_a]), np.cumsum(parts.of[1].length[ids_b]), piece)
    text_of = np.repeat(np.arange(n), n_a)
    ends_of = np.searchsorted(np.cumsum(n_a), ends[:, 0], side="left")
    n_groups, n_links = np.bincount(ends_of, minlength=n), np.bincount(text_of[left], minlength=n)
    groups = group_bytes(ids_a, ids_b, ends, np.append(0, np.cumsum(n_groups)))
    key = np.sort(text_of[left] << 32 | ids_a[left].astype(np.int64) * RADIX + ids_b[right])
    fresh = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(fresh, len(key))).astype(np.int32)
    own = np.searchsorted(key[fresh] >> 32, np.arange(1, n))
    return Aligned(n_a, n_b, n_groups, n_links, groups, np.split((key[fresh] & 0xFFFFFFFF).astype(np.uint32), own), np.split(times, own))


_OUT = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())]


def _aligner(file_a: str, file_b: str, batch_chars: int, piece: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(tokenizer_a(file_a), tokenizer_b(file_b))

        def solve(ids: list, texts: list[str | None], id_type: pa.DataType) -> pa.RecordBatch:
            full = [k for k, t in enumerate(texts) if t]
            x = align(parts, [texts[k] for k in full], piece) if full else None
            cols: list[list] = [[0] * len(texts) for _ in range(4)] + [[""] * len(texts), [b""] * len(texts), [b""] * len(texts)]
            for at, k in enumerate(full):
                if x.n_a[at]:
                    row = (int(x.n_a[at]), int(x.n_b[at]), int(x.n_groups[at]), int(x.n_links[at]), hashlib.sha256(x.groups[at]).hexdigest(), x.pairs[at].tobytes(), x.times[at].tobytes())
                    for c, v in zip(cols, row, strict=True):
                        c[k] = v
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *[pa.array(c, t) for c, (_, t) in zip(cols, _OUT, strict=True)]], names=["doc_id", *[k for k, _ in _OUT]])

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(i)
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size >= batch_chars:
                    yield solve(ids, texts, batch.column("doc_id").type)
                    ids, texts, size = [], [], 0
            if ids:
                yield solve(ids, texts, batch.column("doc_id").type)

    return run


def aligned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", file_a: str = FILE_A, file_b: str = FILE_B, batch_chars: int = BATCH_CHARS, piece: int = PIECE) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of every row; pairs are 32-bit numbers A * RADIX + B."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = slim.mapInArrow(_aligner(file_a, file_b, batch_chars, piece), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")
    return out.withColumn("row", F.monotonically_increasing_id())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): in how many rows of a run of rows a pair stands."""
    held, size = [], 0

    def give() -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

    for batch in batches:
        for x in batch.column("pairs"):
            held.append(np.frombuffer(x.as_py(), np.uint32))
            size += len(held[-1])
            if size >= BLOCK:
                yield give()
                held, size = [], 0
    if held:
        yield give()


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (rows that hold it linked) and best (no pair of its A id stands in more rows)."""
    n = cut(rows.select("pairs").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    a = F.floor(F.col("pair") / RADIX)
    top = n.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return n.withColumn("a", a).join(top, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _adder(block) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = block.value
        for batch in batches:
            of = [np.frombuffer(x.as_py(), np.uint32) for x in batch.column("pairs")]
            size = np.array([len(x) for x in of])
            flat = np.concatenate(of).astype(np.int64) if of else np.zeros(0, np.int64)
            times = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in batch.column("times")]).astype(np.int64) if of else flat
            at = np.minimum(np.searchsorted(pairs, flat), len(pairs) - 1)
            here = pairs[at] == flat
            row = np.repeat(np.arange(len(of)), size)[here]
            sums = []
            for value in (best[at[here]] * times[here], n[at[here]] * times[here]):
                total = np.append(0, np.cumsum(value))
                ends = np.searchsorted(row, np.arange(len(of) + 1))
                sums.append(pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")] + sums, names=[*_KEPT, "n_best", "count_sum"])

    return run


_KEPT = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def links(rows: DataFrame, counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of rows that ``aligned`` gave, written before."""
    counts = cut(counts)
    blocks = max(1, -(-counts.count() // block))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    out = None
    for k in range(blocks):
        mine = counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k) if blocks > 1 else counts
        table = mine.toArrow().sort_by("pair")
        pairs, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
        if not len(pairs):
            pairs, n, best = np.array([-1]), np.array([0]), np.array([False])
        shared = rows.sparkSession.sparkContext.broadcast((pairs, n, best))
        part = rows.select(*_KEPT, "pairs", "times").mapInArrow(_adder(shared), schema)
        part = cut(part) if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    if blocks > 1:
        out = out.groupBy(*_KEPT).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def alignment(docs: DataFrame, *, block: int = BLOCK, **options) -> DataFrame:
    """The links of every row, with what the corpus says of them."""
    rows = cut(aligned(docs, **options))
    return links(rows, pair_counts(rows), block)
