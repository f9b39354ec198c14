"""Benchmark decontamination with suffix arrays over the training text.

The words of a block of benchmark items are numbered; each task turns its documents
into one sequence of those numbers, in which 0 stands for every word that no item
has and for the end of a document.  A match never holds a 0, so the shard's suffix
array needs only the suffixes whose run of known words is as long as the shortest
match of interest; it is built by prefix doubling down to the length of the longest
item.  Every benchmark suffix is then looked up in it by binary search: its longest
verbatim match lies beside the place where it would be inserted, and the shard's
suffixes that begin with the same window form one range of the array.

Shards are made in the tasks that read the documents: texts aren't shuffled, and a
lost shard is made again from its input.  Items come in blocks of at most
``block_bytes``; a block is sent to all tasks, so that its size is bounded whatever
the size of the benchmark, and hits of several blocks are merged by row.

Defined results: words are lower-cased in A-Z.  A null or empty text has no words,
no hits and no items.  Repeated rows each get a result.  An empty benchmark leaves
all documents clean; an empty table gives an empty result.  A document's longest match
is its longest run of words that stands in an item, of those that hold a window; of equal
ones the first in the document counts.  Without a match it has length 0 and no place.
``remove`` passes on all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import cut, free_names, text_key

WINDOW = 10
#: Words in a shard, and UTF-8 bytes of items in a block.
SHARD_WORDS, BLOCK_BYTES = 2_000_000, 16_000_000
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of digits, letters and non-ASCII characters."""
    return text.translate(_WORD_BYTES).split() if text else []


class Items:
    """A block of benchmark items as one numbered sequence, with its windows."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        seq, self.names, place, width, owner = [0], [], [], [], []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not ids:
                continue
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1):
                place.append(len(seq) + k)
                width.append(size)
                owner.append(len(self.names))
            self.names.append(name)
            seq += [*ids, 0]
        self.seq = np.array(seq, np.int32)
        self.place, self.width, self.owner = np.array(place, np.int64), np.array(width, np.int64), np.array(owner, np.int64)
        self.run = run_lengths(self.seq)
        self.shortest = int(self.width.min()) if len(self.width) else window
        self.longest = int(self.run.max())


def run_lengths(seq: np.ndarray) -> np.ndarray:
    """For each place, the number of words up to the next 0."""
    ends = np.flatnonzero(np.append(seq, 0) == 0)
    return ends[np.searchsorted(ends, np.arange(len(seq)))] - np.arange(len(seq))


def suffix_array(seq: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The given places in the order of their suffixes, each cut at its first 0 or at depth words; ties by place.

    Prefix doubling over the runs that hold the places: ranks by the first word are
    refined to 2, 4, ... words.  All places of a run take part, as the rank of a
    longer prefix is made of the ranks of two shorter ones.
    """
    if not len(places):
        return places
    rank = seq.astype(np.int64)
    n = len(seq)
    known = np.flatnonzero(rank)
    length = 1
    while length < depth:
        ahead = np.where(known + length < n, rank[np.minimum(known + length, n - 1)], 0)
        # A prefix that meets a 0 ends there: what follows the 0 plays no part.
        ahead[_meets_zero(seq, known, length)] = 0
        pair = rank[known] * (int(rank.max()) + 1) + ahead
        values, fresh = np.unique(pair, return_inverse=True)
        rank = np.zeros(n, np.int64)
        rank[known] = fresh + 1
        length *= 2
        if len(values) == len(known):
            break
    return places[np.argsort(rank[places], kind="stable")]


def _meets_zero(seq: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    zeros = np.cumsum(np.append(seq == 0, True))
    return zeros[np.minimum(places + length, len(seq))] - zeros[places] > 0


def compare(shard: np.ndarray, at: np.ndarray, test: np.ndarray, start: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix of shard suffixes and test suffixes, most words at most, and the sign of shard against test after it."""
    n = len(at)
    common, sign, open_ = np.zeros(n, np.int64), np.zeros(n, np.int8), np.arange(n)
    k = 0
    while len(open_):
        open_ = open_[most[open_] > k]
        a, b = shard[at[open_] + k], test[start[open_] + k]
        same = (a == b) & (a != 0)
        differ = open_[~same]
        sign[differ] = np.sign(a[~same].astype(np.int64) - b[~same])
        open_ = open_[same]
        k += 1
        common[open_] = k
    return common, sign


def bound(shard: np.ndarray, order: np.ndarray, test: np.ndarray, start: np.ndarray, most: np.ndarray, above: bool) -> np.ndarray:
    """Binary search of all test suffixes at once: suffixes before them, or not above them, in their first ``most`` words."""
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
    while (live := np.flatnonzero(low < high)).size:
        mid = (low[live] + high[live]) // 2
        _, sign = compare(shard, order[mid], test, start[live], most[live])
        right = sign <= 0 if above else sign < 0
        low[live[right]] = mid[right] + 1
        high[live[~right]] = mid[~right]
    return low


def search(shard: np.ndarray, items: Items, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """(place in the shard, number of the window) of every occurrence of a window, and (test place, longest match, shard place) of every test suffix of ``shortest`` words or more."""
    # Only the runs that are long enough take part, each with the 0 after it, so that sorting follows their number.
    zeros = np.flatnonzero(shard == 0)
    starts = np.append(0, zeros[:-1] + 1)
    long = zeros - starts >= shortest
    mark = np.zeros(len(shard) + 1, np.int8)
    mark[starts[long]] += 1
    mark[zeros[long] + 1] -= 1
    back = np.flatnonzero(np.cumsum(mark[:-1]))
    seq = shard[back]
    order = suffix_array(seq, np.flatnonzero(run_lengths(seq) >= shortest), items.longest)
    tests = np.flatnonzero(items.run >= shortest)
    none = np.zeros(0, np.int64)
    if not len(order) or not len(tests):
        return none, none, (none, none, none)
    at = bound(seq, order, items.seq, tests, items.run[tests], False)
    best, where = np.zeros(len(tests), np.int64), np.full(len(tests), len(shard), np.int64)
    for beside in (at - 1, at):
        ok = (beside >= 0) & (beside < len(order))
        common = np.zeros(len(tests), np.int64)
        common[ok] = compare(seq, order[beside[ok]], items.seq, tests[ok], items.run[tests[ok]])[0]
        found = np.full(len(tests), len(shard), np.int64)
        found[ok] = back[order[beside[ok]]]
        better = (common > best) | (common == best) & (found < where)
        best, where = np.where(better, common, best), np.where(better, found, where)
    hit = np.flatnonzero(best[np.searchsorted(tests, items.place)] >= items.width)
    place, width = items.place[hit], items.width[hit]
    first = bound(seq, order, items.seq, place, width, False)
    last = bound(seq, order, items.seq, place, width, True)
    count = last - first
    index = np.repeat(first - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum()) if len(count) else none
    long = best >= shortest
    return back[order[index]], np.repeat(hit, count), (tests[long], best[long], where[long])


def matches(at: np.ndarray, window: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Places and lengths of the maximal matches that occurrences of windows make up: windows that follow each other in the shard and in an item."""
    apart = at - items.place[window]
    order = np.lexsort((at, apart))
    a, d = at[order], apart[order]
    first = np.flatnonzero(np.append(True, (np.diff(a) != 1) | (np.diff(d) != 0))) if len(a) else order
    last = np.append(first[1:], len(a)) - 1 if len(a) else order
    return a[first], a[last] - a[first] + items.width[window[order[last]]]


_OUT = [("key", pa.int64()), ("row", pa.int64()), ("doc_id", None), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), ("longest_match", pa.int64()), ("longest_at", pa.int64())]


def _shards(items: Items, shard_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def solve(heads: list[tuple], ids: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
        sizes = np.array([len(x) - 1 for x in ids], np.int64)
        begins = np.append(0, np.cumsum(sizes + 1))
        shard = np.concatenate(ids)
        at, window, _ = search(shard, items, items.shortest)
        width, owner = items.width[window], items.owner[window]
        doc = np.searchsorted(begins, at, side="right") - 1
        # Covered words: +1 where an occurrence begins, -1 after its end.
        steps = np.zeros(len(shard) + 1, np.int32)
        np.add.at(steps, at, 1)
        np.add.at(steps, at + width, -1)
        covered = np.append(False, np.cumsum(steps[:-1]) > 0)
        edge = np.flatnonzero(covered[1:] != covered[:-1])
        edge = np.append(edge, len(shard)) if len(edge) % 2 else edge
        spans: dict[int, list] = {}
        for s, e in edge.reshape(-1, 2):
            d = int(np.searchsorted(begins, s, side="right") - 1)
            spans.setdefault(d, []).append({"start": int(s - begins[d]), "end": int(e - begins[d])})
        found: dict[int, set] = {}
        for d, o in set(zip(doc.tolist(), owner.tolist(), strict=True)):
            found.setdefault(d, set()).add(items.names[o])
        longest: dict[int, tuple] = {}
        for w, size in zip(*(x.tolist() for x in matches(at, window, items)), strict=True):
            d = int(np.searchsorted(begins, w, side="right") - 1)
            longest[d] = max(longest.get(d, (0, 0)), (size, int(begins[d]) - w))
        n = range(len(heads))
        cols = [[h[0] for h in heads], [h[1] for h in heads], [h[2] for h in heads], sizes, [spans.get(d, []) for d in n], [sorted(found.get(d, ())) for d in n], [longest.get(d, (0, 0))[0] for d in n], [-longest[d][1] if d in longest else None for d in n]]
        return pa.RecordBatch.from_arrays([pa.array(c, t or id_type) for c, (_, t) in zip(cols, _OUT, strict=True)], names=[k for k, _ in _OUT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, ids, total, id_type = [], [], 0, None
        number = items.vocabulary.get
        for batch in batches:
            id_type = batch.column("doc_id").type
            texts = batch.column("text").cast(pa.large_binary())
            for key, row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("key", "row", "doc_id")), texts, strict=True):
                words = words_of(text.as_py())
                numbered = np.zeros(len(words) + 1, np.int32)
                numbered[:-1] = np.fromiter(map(number, words, repeat(0)), np.int32, len(words))
                heads.append((key, row, doc))
                ids.append(numbered)
                total += len(numbered)
                if total >= shard_words:
                    yield solve(heads, ids, id_type)
                    heads, ids, total = [], [], 0
        if heads:
            yield solve(heads, ids, id_type)

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Item ids as text and texts, in lists of block_bytes at most or of one item; only one list is held at a time."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    block, size = [], 0
    for r in rows.toLocalIterator():
        text = r["t"].encode("utf-8", "surrogatepass")
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["i"], text))
        size += len(text)
    yield block


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, doc_id, n_words, hits (word spans), items, longest_match (words) and longest_at of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"key long, row long, doc_id {kind}, n_words long, hits array<struct<start:long,end:long>>, items array<string>, longest_match long, longest_at long"
    slim = docs.select(text_key(id_col, text_col).alias("key"), F.lit(0).cast("long").alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts: list[DataFrame] = []
    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col, block_bytes)):
        items = slim.sparkSession.sparkContext.broadcast(Items(block, window))
        if k == 1:
            parts[0] = cut(parts[0])
        # Each block's part is written once, so that no more than one block is held.
        one = slim.mapInArrow(_task(items, shard_words), schema).withColumn("row", F.lit(k).cast("long"))
        parts.append(cut(one.where(_FOUND)) if k else one)
    out = parts[0] if len(parts) == 1 else _merged(reduce(DataFrame.union, parts))
    return out.drop("row")


def _task(items, shard_words: int) -> Callable:
    return lambda batches: _shards(items.value, shard_words)(batches)


#: Rows of the second and later blocks that say more than the first block's row.
_FOUND = "size(hits) > 0"


def _merged(parts: DataFrame) -> DataFrame:
    """Results of several blocks by row; equal rows have equal results, so that they meet by key and are counted."""
    step = lambda a, h: F.when(  # noqa: E731  spans in order: the last one grows or a new one begins
        (F.size(a) > 0) & (F.element_at(a, -1)["end"] >= h["start"]),
        F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], h["end"]).alias("end")).cast("struct<start:bigint,end:bigint>"))),
    ).otherwise(F.concat(a, F.array(h)))
    g = parts.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.count(F.when(F.col("row") == 0, 1)).alias("times"), F.first("n_words").alias("n_words"), F.flatten(F.collect_set("hits")).alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.max(F.struct("longest_match", F.negative("longest_at").alias("at"))).alias("best"),
    )  # a match comes from one block, as items do
    hits = F.aggregate(F.array_sort("h"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), step)
    return g.select("key", F.lit(0).alias("row"), "doc_id", "n_words", hits.alias("hits"), "items", F.col("best.longest_match").alias("longest_match"), F.negative("best.at").alias("longest_at"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("t")).drop("t")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of a scan."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])
    return scanned.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "longest_match", "longest_at")


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any window of the benchmark, with their own columns."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    (key,) = free_names(docs, "_key")
    bad = scan(docs, benchmark, **options).where(F.size("hits") > 0).select(F.col("key").alias(key))
    return docs.withColumn(key, text_key(id_col, text_col)).join(bad, key, "left_anti").select(*[F.col(c) for c in docs.columns])


def sha256_of(items: list[str]) -> str:
    """Lower-case hex digest of sorted item ids, comma-joined."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
