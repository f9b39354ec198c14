"""Merkle manifest of a dataset: digests of rows, of sources and of the whole, with proofs.

A leaf is the digest of a row's fields.  The leaves of a source stand in the order of
their ids; each ``FANOUT`` of them make a parent, and so on up to the source's subroot.
Subroots in the order of the sources make the root in the same way.

A level is a slot pivot: conditional aggregates spread the children of each parent into
``FANOUT`` columns.  Joining the columns' digests and hashing them gives the parent;
leaving out a child's own column gives its siblings, those to the left and those to the
right.  Going down from the root each level hands its children the siblings of all levels
above, so that a leaf arrives with its whole proof.  Only parents meet by key on the way,
so a source of any size is spread over all tasks, and no level is held by one.

Places within a source come from ranges: rows are range-sorted by source and id, with a
number of their own last, so that no source or id fills a range alone; a running sum of the
ranges' counts and a place within the range add up.

Defined results: a null field is ``-``; texts of no length have a field of their own.
A null id comes first in its source and is never tampered with; rows of equal id stand in
the order of their leaves, so that equal rows are interchangeable.  A null source is a
source of its own, the first one.  An empty table has no root and gives an empty result.
Only named columns are read, so no column can clash.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockweave.llm.common import cut

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows in a range on average, at most; there are at least as many ranges as shuffle partitions.
ROWS_IN_RANGE = 1_000_000
PATH = "array<struct<l:binary,r:binary>>"


def sha256(hex_text: Column) -> Column:
    """Digest of a text, as 32 bytes."""
    return F.unhex(F.sha2(hex_text.cast("binary"), 256))


def hex_of(digest: Column) -> Column:
    """Bytes as lower-case hex."""
    return F.lower(F.hex(digest))


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row's fields, each with its length in bytes before it."""
    text = [c.cast("string") for c in fields]
    return sha256(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]))


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of a written table with at -> and idx, their place in their group ``at`` from 0, and n, the group's size."""
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS_IN_RANGE + 1)
    rows = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    ranged = cut(rows.repartitionByRange(ranges, "at", *order, "tie").withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("at", "range").agg(F.count("*").alias("c"))
    of = W.partitionBy("at")
    counts = counts.select("at", "range", F.sum("c").over(of).alias("n"), F.coalesce(F.sum("c").over(of.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.row_number().over(W.partitionBy("at", "range").orderBy(*order, "tie")) - 1
    return ranged.join(counts.hint("merge"), ["at", "range"]).withColumn("idx", F.col("base") + within).drop("tie", "range", "base")


def _slot(k: int) -> str:
    return f"c{k}"


def pivot(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """at, idx, n and node (a struct with a digest) of a level -> at, idx and n of the parents, with a column for each child."""
    own = F.pmod("idx", F.lit(fanout))
    columns = [F.max(F.when(own == k, F.col("node"))).alias(_slot(k)) for k in range(fanout)]
    g = nodes.groupBy("at", F.floor(F.col("idx") / fanout).alias("idx"), F.ceil(F.col("n") / fanout).alias("n"))
    return g.agg(*columns)


def _joined(slots: Sequence[int]) -> Column:
    """The digests of some slots side by side; empty slots add nothing."""
    none = F.lit(b"")
    return F.concat(none, *[F.coalesce(F.col(_slot(k))["digest"], none) for k in slots])


def parents(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The parents of a pivoted level as nodes of the next one."""
    return level.select("at", "idx", "n", F.struct(sha256(hex_of(_joined(range(fanout)))).alias("digest")).alias("node"))


@dataclass
class Tree:
    """Nodes at the bottom (at, idx, n, node) and the pivoted levels above them, the lowest first."""

    bottom: DataFrame
    fanout: int = FANOUT
    levels: list[DataFrame] = field(default_factory=list)

    def __post_init__(self) -> None:
        nodes, most = self.bottom, self.bottom.agg(F.max("n")).first()[0] or 0
        while most > 1:
            self.levels.append(cut(pivot(nodes.where("n > 1"), self.fanout)))
            nodes, most = parents(self.levels[-1], self.fanout), -(-most // self.fanout)

    def heads(self) -> DataFrame:
        """at, height and digest of the last node of each group."""
        each = [self.bottom, *[parents(x, self.fanout) for x in self.levels]]
        tops = [x.where("n = 1").select("at", F.lit(k).alias("height"), F.col("node")["digest"].alias("digest")) for k, x in enumerate(each)]
        return reduce(DataFrame.unionByName, tops)

    def nodes(self) -> DataFrame:
        """at, level, idx and digest of every node."""
        each = [self.bottom, *[parents(x, self.fanout) for x in self.levels]]
        return reduce(DataFrame.unionByName, [x.select("at", F.lit(k).alias("level"), "idx", F.col("node")["digest"].alias("digest")) for k, x in enumerate(each)])

    def paths(self, tops: DataFrame) -> DataFrame:
        """tops: at, height, path and more columns of each group -> node and path of every bottom node, with those columns.

        A path holds the siblings to the left and to the right for each level upwards.
        """
        more = [c for c in tops.columns if c not in ("at", "height", "path")]
        above = None
        for k in range(len(self.levels), 0, -1):
            start = tops.where(F.col("height") == k).select("at", F.lit(0).cast("long").alias("idx"), "path", *more)
            above = start if above is None else start.unionByName(above)
            met = self.levels[k - 1].drop("n").hint("merge").join(above, ["at", "idx"])
            slots = [F.struct(F.lit(s).alias("slot"), F.col(_slot(s)).alias("node"), _joined(range(s)).alias("l"), _joined(range(s + 1, self.fanout)).alias("r")) for s in range(self.fanout)]
            child = met.select("at", "idx", "path", *more, F.explode(F.filter(F.array(*slots), lambda s: s["node"].isNotNull())).alias("child"))
            path = F.concat(F.array(F.struct(F.col("child.l").alias("l"), F.col("child.r").alias("r"))), F.col("path"))
            below = child.select("at", (F.col("idx") * self.fanout + F.col("child.slot")).alias("idx"), F.col("child.node").alias("node"), path.alias("path"), *more)
            above = below.drop("node") if k == 1 else cut(below.drop("node"))
        alone = self.bottom.where("n = 1").select("at", "node").join(tops.where("height = 0").drop("height").hint("merge"), "at").select("node", "path", *more)
        return alone if not self.levels else below.select("node", "path", *more).unionByName(alone)


@dataclass
class Manifest:
    """The trees of the sources, the tree of their subroots, and the root as hex, null for an empty table."""

    sources: Tree
    top: Tree
    root: str | None

    def proofs(self) -> DataFrame:
        """node (doc_id, digest, seen), subroot and path of every row."""
        start = F.array().cast(PATH)
        tops = self.top.heads().select("at", "height", start.alias("path"))
        below = self.top.paths(tops).select(F.col("node.key").alias("at"), F.col("node.digest").alias("subroot"), "path")
        heads = self.sources.heads().select("at", "height")
        return self.sources.paths(cut(below.join(heads.hint("merge"), "at").select("at", "height", "path", "subroot")))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, *, id_col: str = "doc_id", source_col: str = "source", fanout: int = FANOUT, seen: Mapping[str, Column] | None = None) -> Manifest:
    """Trees over all rows.  ``seen`` has other values of fields, of which each row's ``seen`` digest is made: what a reader finds."""
    digest = leaf([F.col(c) for c in fields])
    found = leaf([(seen or {}).get(c, F.col(c)) for c in fields]) if seen else digest
    # A null source comes first, and all others in the order of their bytes.
    at = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = cut(docs.select(at.alias("at"), F.col(id_col).alias("doc_id"), digest.alias("digest"), found.alias("seen")))
    node = F.struct("doc_id", "digest", "seen").alias("node")
    sources = Tree(cut(placed(rows, ["doc_id", "digest", "seen"]).select("at", "idx", "n", node)), fanout)
    subroots = cut(sources.heads().select(F.lit("").alias("at"), F.col("at").alias("key"), "digest"))
    top = Tree(cut(placed(subroots, ["key"]).select("at", "idx", "n", F.struct("key", "digest").alias("node"))), fanout)
    head = top.heads().first()
    return Manifest(sources, top, head["digest"].hex() if head else None)


def proof_text(path: Column) -> Column:
    """All siblings of a path as hex, level by level, from left to right."""
    return F.array_join(F.transform(path, lambda s: hex_of(F.concat(s["l"], s["r"]))), "")


def folded(digest: Column, path: Column) -> Column:
    """The root, as hex, that a leaf and its siblings make."""
    return F.aggregate(path, hex_of(digest), lambda acc, s: F.sha2(F.concat(hex_of(s["l"]), acc, hex_of(s["r"])).cast("binary"), 256))


def verify(m: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the row as seen) and verified of every row."""
    root = F.lit(m.root)
    p = m.proofs().withColumn("folded_root", folded(F.col("node.seen"), F.col("path")))
    return p.select(
        "node.doc_id", hex_of(F.col("node.digest")).alias("leaf"), hex_of(F.col("subroot")).alias("subroot"), root.alias("root"),
        F.sha2(proof_text(F.col("path")).cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"),
    )


def lowered_for(id_col: str = "doc_id", text_col: str = "text", one_in: int = 5) -> dict[str, Column]:
    """Texts as seen after tampering: A-Z in lower case where the crc32 of the id as decimal text is divisible by ``one_in``."""
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % one_in == 0, F.lit(False))
    return {text_col: F.when(hit, F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col(text_col))}
