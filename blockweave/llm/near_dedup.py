"""Near-duplicate groups by fast similarity sketches, banding and exact verification.

A document's set holds its distinct shingles.  The sketch of t places is filled in
rounds: round i throws each element into a hashed bin with a hashed value, and a bin
keeps the smallest (round, value); rounds t to 2t - 1 throw all elements into bin
i - t, so that after 2t rounds each place is filled.  Two sets agree in a place with
the probability of their similarity, with concentration like that of t independent
hashes, at about the cost of a few.

Rows with equal sets are one node.  Sketch places are hashed in bands, and nodes that
share a band's hash are in a bucket.  Pairs of a bucket aren't all formed: each member
is first compared with the bucket's smallest node, on full sets, and what is linked
becomes one component.  In buckets that still hold several components, members are
compared with the centre of the bucket's largest component and with the member next to
it.  Pairs of components that are apart even then are compared unless a bound forbids
the link: parity words of 4096 bits, whose differing bits are never more than the
elements that differ, or the distances to the centre, as the Jaccard distance is a
metric.  So every pair in a bucket is linked, connected or excluded by a proof.

With 40 bands of 5 places a pair of similarity 0.8 misses all buckets with a
probability of 1.2e-7 (0.9: below 1e-15).  No bucket or list of partners is cut off.

Sets travel only for nodes with a candidate; the second scan finds their rows by a
bitmap of fixed size, so a third of all rows in one group costs its members' sets and
no more.  Pivots with many partners are copied over as many salts as their partners
need.

Defined results: lower case in A-Z.  A null or empty text has an empty set and is
linked with nothing.  Repeated rows have one set and one component.  A null id takes
part; component ids are the smallest ids that aren't null, and a component without
any keeps its rows with a null id.  An empty table gives an empty result.  Other
columns are passed on by ``dedupe``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import cut, free_names, join_hot, text_key
from blockweave.llm.components import components

BANDS, ROWS = 40, 5
#: Bits of the bitmap of rows whose sets travel, and partners of a pivot per salt.
BITS, PARTNERS = 1 << 24, 32
#: 64-bit words in a set's parity.
WORDS = 64
#: Bytes of the longest word whose hash is remembered.
LONGEST = 64
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on all input bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    """Hash of a word, made once for each of the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            self[word] = h
        return h


def shingle_set(text: str | None, width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a text; with fewer words than the width, the whole sequence is one."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    size = min(width, n)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[k : n - size + 1 + k])
    return np.unique(out)


def parity(items: np.ndarray) -> np.ndarray:
    """Bit k: whether an odd number of the elements falls on k, as words."""
    bits = np.bincount(items.view(np.uint64) % _U(64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def sketches(sets: list[np.ndarray], places: int) -> np.ndarray:
    """One row of ``places`` filled places for each of the sets, none of which is empty."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), places), np.iinfo(np.uint64).max, np.uint64)
    live, flat, owner = np.arange(len(sets)), np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * places):
        h = mix(flat ^ mix(np.full(1, 2 * i + 1, np.uint64)))
        place = ((h >> _U(40)) * _U(places) >> _U(24)).astype(np.int64) if i < places else i - places
        value = (_U(i) << _U(40)) | (h & _U((1 << 40) - 1))
        np.minimum.at(out.reshape(-1), owner * places + place, value)
        open_ = (out[live] == np.iinfo(np.uint64).max).any(axis=1)
        if not open_.any():
            break
        live = live[open_]
        keep = np.zeros(len(sets), bool)
        keep[live] = True
        stay = keep[owner]
        flat, owner = flat[stay], owner[stay]
    return out


def band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band of each sketch."""
    parts = sketch.reshape(len(sketch), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(rows):
        h = mix(h * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return h.view(np.int64)


def _sketcher(width: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingle_set(t, width, hashes) for t in batch.column("text").to_pylist()]
                full = [k for k, s in enumerate(sets) if len(s)]
                signs = iter(band_hashes(sketches([sets[k] for k in full], bands * rows), bands, rows)) if full else iter(())
                nodes = [int(np.bitwise_xor.reduce(mix(s + _U(len(s)))).view(np.int64)) ^ len(s) if len(s) else None for s in sets]
                listed = [next(signs) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(listed, pa.list_(pa.int64()))],
                    names=["key", "doc_id", "n_shingles", "node", "bands"],
                )

    return run


def _set_maker(width: int, bitmap) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = _Hashes(), bitmap.value
        for batch in batches:
            place = batch.column("key").to_numpy() % BITS
            wanted = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            for at in range(0, len(wanted), 512):
                some = pa.array(wanted[at : at + 512])
                sets = [shingle_set(t, width, hashes).view(np.int64) for t in batch.column("text").take(some).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(some), pa.array(sets, pa.list_(pa.int64())), pa.array([parity(s) for s in sets], pa.list_(pa.int64()))], names=["key", "items", "parity"])

    return run


def _bitmap(keys: DataFrame):
    """Bits of the keys modulo BITS; its size doesn't depend on their number, and a false bit only costs a row."""
    place = F.pmod(F.col("key"), F.lit(BITS)) + 1
    rows = keys.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m")).collect()
    bits = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        at = 4096 * (r["b"] - 1)
        bits[at : at + 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, centres: DataFrame | None = None) -> DataFrame:
    """(a, b) -> (a, b, inter, total, linked), on full sets; ``a`` may be hot, and is one of the centres if any are given."""
    salts = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts")))
    left = salts.join((sets if centres is None else centres).select(F.col("node").alias("a"), F.col("items").alias("items_a")).hint("merge"), "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    # Both sides know a pivot's number of salts; the pairs get it with their salt.
    right = pairs.join(salts.hint("merge"), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts")
    right = right.join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")).hint("merge"), "b")
    inter = F.size(F.array_intersect("items_a", "items_b")).cast("long")
    out = right.join(left.select("a", "salt", "items_a").hint("merge"), ["a", "salt"]).select("a", "b", inter.alias("inter"), (F.size("items_a") + F.size("items_b")).cast("long").alias("sizes"))
    out = out.select("a", "b", "inter", (F.col("sizes") - F.col("inter")).alias("total"))
    return cut(out.withColumn("linked", 100 * F.col("inter") >= percent * F.col("total")))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links (a, b); components that are linked get the smallest label."""
    label = lambda c: F.coalesce(F.col("l_" + c), F.col(c))
    for c in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(c), F.col("label").alias("l_" + c)).hint("merge"), c, "left")
    links = cut(links.select(label("a").alias("a"), label("b").alias("b")).where("a <> b").distinct())
    if not links.limit(1).count():
        return labels
    over = components(links).select(F.col("node").alias("label"), F.col("label").alias("top"))
    known = labels.groupBy("label").agg(F.count("*").alias("w")).join(over.hint("merge"), "label", "left")
    renamed = join_hot(labels, known, ["label"], "w").select("node", F.coalesce("top", "label").alias("label"))
    alone = over.join(labels.select(F.col("node").alias("label")).hint("merge"), "label", "left_anti").select(F.col("label").alias("node"), F.col("top").alias("label"))
    return cut(renamed.union(alone))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their labels, of buckets that hold several components."""
    place = cut(members.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")))
    several = place.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count("*").alias("w")).where("l < m").select("bucket", "w")
    return cut(join_hot(place, several, ["bucket"], "w"))


def _apart(x: str, y: str, percent: int) -> Column:
    """True if the parity words of two sets show that they can't be linked.

    A word's bit is the parity of the elements that fall on it, so the bits in which two
    sets differ are at most the elements that only one of them has.
    """
    apart = F.zip_with(x + ".parity", y + ".parity", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    differ = F.aggregate(apart, F.lit(0), lambda total, k: total + k)
    return (100 + percent) * differ > (100 - percent) * (F.col(x + ".n") + F.col(y + ".n"))


def _beside_centre(members: DataFrame, star: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Further labels from the buckets that hold several components after the star.

    A component's centre is the elements that half of its nodes have: of edited copies,
    about their original; its first node where no element reaches half.  In each bucket the member next to the centre of the largest
    component is compared with all others; then pairs that are still apart are formed,
    unless a bound forbids the link.
    """
    place = _mixed(members.select("bucket", "node", "n"), labels)
    if not place.limit(1).count():
        return labels
    chief = place.groupBy("bucket", "label").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("w")).select("bucket", F.col("m.label").alias("centre"), "w")
    place = cut(join_hot(place, chief, ["bucket"], "w"))
    wanted = place.select(F.col("centre").alias("label")).distinct()
    some = cut(place.select("node", "label").distinct().join(wanted.hint("merge"), "label", "left_semi").join(sets.select("node", "items").hint("merge"), "node"))
    items = some.select("label", F.explode("items").alias("item")).groupBy("label", "item").agg(F.count("*").alias("c"))
    # A large component's elements meet its size in several tasks.
    sizes = cut(some.groupBy("label").agg(F.count("*").alias("size"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PARTNERS - 1))))
    half = items.withColumn("salt", F.pmod("item", F.lit(PARTNERS)).cast("int")).join(sizes.hint("merge"), ["label", "salt"]).where("2 * c >= size")
    centres = cut(half.groupBy(F.col("label").alias("node")).agg(F.collect_list("item").alias("items")))
    # Texts of a component that drifts may share no element; any set of elements serves as centre.
    first = some.join(centres.select(F.col("node").alias("label")).hint("merge"), "label", "left_anti").groupBy("label").agg(F.min_by("items", "node").alias("items"))
    centres = cut(centres.union(first.select(F.col("label").alias("node"), "items")))
    known = _verified(cut(place.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()), sets, percent, centres)
    distance = known.select(F.col("a").alias("centre"), F.col("b").alias("node"), (1 - F.col("inter") / F.col("total")).alias("d"))
    place = cut(place.join(distance.hint("merge"), ["centre", "node"]).select("bucket", "node", "n", "d"))
    heart = place.groupBy("bucket").agg(F.min(F.struct("d", "node")).alias("m"), F.count("*").alias("w")).select("bucket", F.col("m.node").alias("a"), "w")
    again = join_hot(place, heart, ["bucket"], "w").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    tried = _verified(cut(again.join(star.select("a", "b").hint("merge"), ["a", "b"], "left_anti")), sets, percent)
    labels = _merged(labels, tried.where("linked").select("a", "b"))
    place = cut(_mixed(place, labels).join(sets.select("node", "parity").hint("merge"), "node"))
    x, y = place.alias("x"), place.alias("y")
    near = F.abs(F.col("x.d") - F.col("y.d")) <= 1 - percent / 100 + 1e-9
    rest = x.join(y.hint("merge"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") < F.col("y.label")) & near & ~_apart("x", "y", percent))
    rest = rest.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    done = star.select("a", "b").union(tried.select(F.least("a", "b"), F.greatest("a", "b")))
    rest = cut(rest.join(done.hint("merge"), ["a", "b"], "left_anti"))
    if not rest.limit(1).count():
        return labels
    return _merged(labels, _verified(rest, sets, percent).where("linked").select("a", "b"))


def group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, doc_id, n_shingles, component_id and kept of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(text_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketched = cut(slim.mapInArrow(_sketcher(width, bands, rows), f"key long, doc_id {kind}, n_shingles long, node long, bands array<long>"))
    full = sketched.where("node is not null")
    # The bands of equal sets are equal; each task keeps one list of a node before any is shuffled.
    nodes = cut(full.groupBy("node").agg(F.min("key").alias("key"), F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    members = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("c"), F.min(F.struct("node", "n")).alias("p")).where("c > 1").select("bucket", F.col("p.node").alias("pivot"), "c")
    members = cut(join_hot(members, shared, ["bucket"], "c"))
    pairs = cut(members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "key").hint("merge"), "node"))
    made = slim.mapInArrow(_set_maker(width, _bitmap(wanted)), "key long, items array<long>, parity array<long>")
    sets = cut(wanted.hint("merge").join(made, "key").groupBy("node").agg(F.first("items").alias("items"), F.first("parity").alias("parity")))
    star = _verified(pairs, sets, percent)
    labels = components(star.where("linked").select("a", "b"))
    labels = _beside_centre(members, star, sets, labels, percent)
    named = cut(nodes.select("node", "first_id").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")))
    ids = named.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("w"))
    named = join_hot(named, ids, ["label"], "w").select("node", "component_id")
    out = sketched.drop("bands").join(named.hint("merge"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("key", "doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def dedupe(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, with its own columns; of repeated rows one stays."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    (key,) = free_names(docs, "_key")
    good = group(docs, **options).where("kept").select(F.col("key").alias(key)).distinct()
    kept = docs.withColumn(key, text_key(id_col, text_col)).join(good, key, "left_semi")
    return kept.dropDuplicates([key]).select(*[F.col(c) for c in docs.columns])
