"""Quality rules with cross-document line frequency.

Each text is measured once (words, symbols, repeated lines and three-word
windows) and its lines are normalised and hashed.  A line is boilerplate of its
host if it stands in more than ``max_docs`` of the host's documents, however many the
host has.  A document is rejected if it fails the base rules or if,
without its boilerplate lines, less than ``min_left`` of its word characters is
left.

Documents count as distinct by their whole set of lines, of which each has one hash.
Copies of one document, whose lines are all equal after normalisation, therefore count
once and are left to the near-duplicate stage; a document with a line of its own counts
for each of its lines, however many of them it shares.  A near copy with an edited line
is such a document.

Only line hashes are shuffled.  Distinct (host, line, set) triples are formed
before lines are counted, so that a line of a third of all documents is spread over
all tasks; frequent lines come back to the documents by a join salted by row.

Defined results: a null or empty text has no words and fails the base rules.  A
null host is a host of its own.  Repeated rows each get a result.  An empty table
gives an empty result.  Further columns are passed on by ``keep_good`` and
``clean``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockweave.llm.common import cut, free_names, text_key

MIN_WORDS, MAX_REPEAT = 50, 50
MAX_DOCS, MIN_LEFT = 10, 0.2
#: Copies of the table of frequent lines; each document line meets one of them.
SALTS = 32
SYMBOLS = re.compile(rb"[#*$%&|<>]")
NOT_SPACE = str.maketrans("", "", " \t\n\r\x0b\x0c")
DIGITS = re.compile(r"\d+")


def normal_line(line: str) -> str:
    """Lower case, runs of white space as one space, runs of digits as 0."""
    return DIGITS.sub("0", " ".join(line.lower().split()))


def repeated_words(words: list[bytes]) -> int:
    """Words inside a three-word window that the text has twice or more, its first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    # Three numbers below 2**21 fit in 63 bits; larger vocabularies rank their pairs first.
    if len(number) < 1 << 21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        pairs = np.unique((ids[:-1] << 31) | ids[1:], return_inverse=True)[1]
        windows = (pairs[:-1] << 31) | ids[2:]
    order = np.argsort(windows)
    run = windows[order]
    same = run[1:] == run[:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line hashes, word characters of each line."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, dup, hashes, sizes = set(), 0, [], []
    for line in text.split("\n"):
        chars = len(line.translate(NOT_SPACE))
        if not chars:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        hashes.append(xxhash.xxh3_64_intdigest(normal_line(line).encode("utf-8", "surrogatepass")) - (1 << 63))
        sizes.append(chars)
    return len(words), sum(sizes), len(SYMBOLS.findall(raw)), dup, repeated_words(words), hashes, sizes


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lines = pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64())]))
    for batch in batches:
        made = [measure(t) for t in batch.column("text").to_pylist()]
        listed, wholes = [], []
        for *_, hashes, sizes in made:
            total: dict[int, int] = {}
            for h, c in zip(hashes, sizes, strict=True):
                total[h] = total.get(h, 0) + c
            listed.append([{"h": h, "c": c} for h, c in total.items()])
            wholes.append(xxhash.xxh3_64_intdigest(np.array(sorted(total), np.int64).tobytes()) - (1 << 63))
        cols = [pa.array([m[k] for m in made], pa.int64()) for k in range(5)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "doc_id", "host")] + cols + [pa.array(wholes, pa.int64()), pa.array(listed, lines)], names=["key", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "whole", "lines"])


def _slim(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    # The window counts hold for null hosts too, and a host that can't be compared becomes text.
    return docs.select(text_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), F.concat(F.lit("="), F.col(host_col).cast("string")).alias("host"), F.col(text_col).alias("text")).withColumn("host", F.coalesce("host", F.lit("")))


def _frequent(measured: DataFrame, max_docs: int) -> tuple[DataFrame, DataFrame]:
    """Lines of each row, and (host, h) of the lines above the limit."""
    rows = measured.select("rid", "host", "whole", F.explode("lines").alias("l")).select("rid", "host", "whole", "l.h", "l.c")
    counts = rows.groupBy("host", "h", "whole").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs)
    return rows, counts


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """The measures of every row with boilerplate_chars, base_failed and kept; ``key`` joins back to the documents."""
    kind = docs.schema[id_col].dataType.simpleString()
    # The number of a row is written with it, so that it stays the same wherever the rows are read.
    schema = f"key long, doc_id {kind}, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, whole long, lines array<struct<h:long,c:long>>"
    measured = cut(_slim(docs, id_col, text_col, host_col).mapInArrow(_measures, schema).withColumn("rid", F.monotonically_increasing_id()))
    rows, frequent = _frequent(measured, max_docs)
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    removed = rows.join(salted, ["host", "h", "salt"]).groupBy("rid").agg(F.sum("c").alias("boilerplate_chars"), F.sort_array(F.collect_list("h")).alias("boilerplate"))
    out = measured.drop("lines", "whole").join(removed, "rid", "left").withColumn("boilerplate_chars", F.coalesce("boilerplate_chars", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    depleted = (F.col("word_chars") - F.col("boilerplate_chars")) < F.col("word_chars") * F.lit(float(min_left))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).drop("rid")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with their own columns and whole texts."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    (key,) = free_names(docs, "_key")
    good = judge(docs, **options).where("kept").select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, text_key(id_col, text_col)).join(good, key, "left_semi").select(*[F.col(c) for c in docs.columns])


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, hashes: pa.Array) -> pa.Array:
    out = []
    for text, drop in zip(texts.to_pylist(), hashes.to_pylist(), strict=True):
        if text is not None and drop:
            gone = set(drop)
            text = "\n".join(x for x in text.split("\n") if not x.strip() or xxhash.xxh3_64_intdigest(normal_line(x).encode("utf-8", "surrogatepass")) - (1 << 63) not in gone)
        out.append(text)
    return pa.array(out, pa.string())


def clean(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, their texts without boilerplate lines."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    key, gone = free_names(docs, "_key", "_gone")
    good = judge(docs, **options).where("kept").groupBy(F.col("key").alias(key)).agg(F.first("boilerplate").alias(gone))
    kept = docs.withColumn(key, text_key(id_col, text_col)).join(good, key)
    return kept.withColumn(text_col, _without(F.col(text_col), F.col(gone))).select(*[F.col(c) for c in docs.columns])
