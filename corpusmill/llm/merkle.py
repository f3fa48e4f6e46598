"""A Merkle manifest of a dataset: a digest per row, a tree per source, a tree over the sources, and a proof per row.

A leaf is the hash of a row's fields. Leaves of a source ascend by identifier; while more than one node is left, every
``ARITY`` consecutive ones become the hash of their digests as text. The last of each source (its subroot) make a tree of
the same kind, in the order of sources, whose last node is the root.

Nodes are dealt by aligned block: ``BLOCK`` consecutive nodes of one tree, two levels. A block keeps each level as one
string of hexadecimal digests, so a run of siblings is a fixed-width substring, its hash is the parent, and what stands
before and after a node's own digest are its siblings. The last digests of the blocks are the nodes of the next stage, until
each tree is one node. Proofs go the other way: a block's own proof (one row) is joined to the block one stage below and
continued for each of its nodes, so a proof is never shuffled once a row, and texts are never shuffled at all.

Positions come from range partitions: sorted rows are written, counted per partition and source, and prefix sums of the
counts number them. A source with most of the rows is cut by identifier like any other.

Defined cases: a null field is ``-``; null identifiers come first and are never altered; rows with one identifier are ordered by leaf,
and rows that repeat are separate leaves; a null source is a source of its own, before all others; a source with one row
has its leaf for a subroot; one source alone has its subroot for a root; an empty table gives no rows; texts are
hashed whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialise

ARITY, WIDTH = 16, 64
#: Nodes of a block: two levels.
LEVELS = 2
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEGMENTS = "array<struct<before:string,after:string>>"


def framed(value: Column) -> Column:
    """A field of a leaf: its size in bytes, a colon and its value, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaves(docs: DataFrame, altered: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, doc_id, leaf, altered): the leaf of each row and the one it would have with ``altered`` fields. The key
    orders sources bytewise, null first."""
    values = {c: F.col(c) for c in fields}
    leaf = lambda v: digest(F.concat(*(framed(v[c]) for c in fields)))
    id_col, source = fields[0], fields[1]
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    return docs.select(key.alias("key"), F.col(id_col).alias("doc_id"), leaf(values).alias("leaf"), leaf({**values, **(altered or {})}).alias("altered"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with pos (from 0, within its key, by ``order``) and n (rows of the key)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows that are alike in all of ``order`` may trade places: the salt only spreads them over partitions
    salted = materialise(rows.withColumn("salt", F.monotonically_increasing_id()), "leaves")
    ranged = salted.repartitionByRange(n, "key", *order, "salt").sortWithinPartitions("key", *order, "salt").drop("salt")
    place = F.monotonically_increasing_id()
    ranged = materialise(ranged.withColumn("part", F.shiftright(place, 33)).withColumn("place", place.bitwiseAND(F.lit((1 << 33) - 1))), "ordered-leaves")
    counts = ranged.groupBy("key", "part").agg(F.count("*").alias("here"), F.min("place").alias("first"))
    upto = Window.partitionBy("key").orderBy("part")
    counts = counts.select("key", "part", "first", (F.sum("here").over(upto) - F.col("here")).alias("before"), F.sum("here").over(Window.partitionBy("key")).alias("n"))
    return ranged.join(counts, ["key", "part"]).withColumn("pos", F.col("before") + F.col("place") - F.col("first")).drop("part", "place", "first", "before")


def depth_of(n: Column) -> Column:
    """Levels above n leaves."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda t: n > F.pow(F.lit(ARITY), t).cast("long")))


def runs(level: Column) -> Column:
    """A level's string in runs of siblings."""
    size = ARITY * WIDTH
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(level) - 1) / size).cast("int")), lambda i: F.substring(level, i * size + 1, F.lit(size)))


def blocks(nodes: DataFrame) -> DataFrame:
    """nodes(key, pos, depth, digest, item) -> per block of a tree: key, block, depth (levels left above its nodes), items in
    order, level0, level1 (null where the tree ends below) and top, the digest that stands for the block one stage up."""
    held = nodes.groupBy("key", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("depth").alias("depth"), F.array_sort(F.collect_list(F.struct("pos", "digest", "item"))).alias("held"))
    level0 = F.array_join(F.col("held.digest"), "")
    above = lambda level: F.array_join(F.transform(runs(level), digest), "")
    held = held.withColumn("level0", level0)
    held = held.withColumn("level1", F.when(F.col("depth") >= 1, above(F.col("level0"))))
    top = F.when(F.col("depth") >= 2, digest(F.col("level1"))).when(F.col("depth") == 1, F.col("level1")).otherwise(F.col("level0"))
    return held.select("key", "block", "depth", F.col("held.item").alias("items"), "level0", "level1", top.alias("top"))


def own_segments(i: Column, level0: Column, level1: Column, runs0: Column, depth: Column) -> Column:
    """What stands before and after node i of a block among its siblings, at each level of the block."""
    inner, outer = i % ARITY, F.floor(i / ARITY).cast("int")
    cut = lambda run, at: F.struct(F.substring(run, F.lit(1), at * WIDTH).alias("before"), F.substring(run, (at + 1) * WIDTH + 1, F.lit(ARITY * WIDTH)).alias("after"))
    none = F.array().cast(SEGMENTS)
    first = F.array(cut(F.get(runs0, outer), inner))
    return F.when(depth >= 2, F.concat(first, F.array(cut(level1, outer)))).when(depth == 1, first).otherwise(none)


def fold(start: Column, segments: Column) -> Column:
    """The root that a node's digest and its siblings give."""
    return F.aggregate(segments, start, lambda node, s: digest(F.concat(s["before"], node, s["after"])))


def proof_text(segments: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(segments, lambda s: F.concat(s["before"], s["after"])), "")


@dataclass
class Tree:
    """One tree for each key: its blocks stage by stage, and (key, digest) of the last nodes."""

    stages: list[DataFrame] = field(default_factory=list)
    tops: DataFrame | None = None


def grow(rows: DataFrame) -> Tree:
    """rows(key, pos, n, digest, item) -> the trees over them, one stage of blocks a pass."""
    nodes, tree = rows.withColumn("depth", depth_of(F.col("n"))), Tree()
    while True:
        stage = materialise(blocks(nodes.select("key", "pos", "depth", "digest", "item")), "merkle-blocks")
        tree.stages.append(stage)
        above = stage.select("key", F.col("block").alias("pos"), F.greatest(F.col("depth") - LEVELS, F.lit(0)).alias("depth"), F.col("top").alias("digest"), F.lit(None).cast("string").alias("item"))
        if not stage.filter(F.col("block") > 0).limit(1).count():
            tree.tops = above.select("key", "digest")
            return tree
        nodes = above


def descend(tree: Tree, proofs: DataFrame) -> DataFrame:
    """proofs(key, pos, proof) of the last nodes -> the same of the lowest blocks, each proof one row."""
    for stage in reversed(tree.stages[1:]):
        held = stage.join(proofs.withColumnRenamed("pos", "block"), ["key", "block"]).withColumn("runs0", runs(F.col("level0")))
        each = F.transform(F.sequence(F.lit(0), F.size("items") - 1), lambda i: F.struct((F.col("block") * BLOCK + i).alias("pos"), F.concat(own_segments(i, F.col("level0"), F.col("level1"), F.col("runs0"), F.col("depth")), F.col("proof")).alias("proof")))
        proofs = held.select("key", F.inline(each))
    return proofs


@dataclass
class Manifest:
    """The trees of all sources (items: struct of doc_id, altered leaf), the tree over the sources, and their roots."""

    sources: Tree
    top: Tree

    def subroots(self) -> DataFrame:
        """(key, digest) of each source."""
        return self.sources.tops

    def root(self) -> DataFrame:
        """(digest): one row, or none for an empty table."""
        return self.top.tops.select("digest")

    def proofs(self) -> DataFrame:
        """(key, doc_id, leaf, altered, segments): siblings of each leaf from its run to the root."""
        start = self.top.stages[-1].select("key", F.col("block").alias("pos"), F.array().cast(SEGMENTS).alias("proof"))
        upper = descend(self.top, start)
        stage = self.top.stages[0].join(upper.withColumnRenamed("pos", "block"), ["key", "block"]).withColumn("runs0", runs(F.col("level0")))
        each = F.transform("items", lambda x, i: F.struct(x.alias("key"), F.lit(0).cast("long").alias("pos"), F.concat(own_segments(i, F.col("level0"), F.col("level1"), F.col("runs0"), F.col("depth")), F.col("proof")).alias("proof")))
        lower = descend(self.sources, materialise(stage.select(F.inline(each)), "source-proofs"))
        stage = self.sources.stages[0].join(lower.withColumnRenamed("pos", "block"), ["key", "block"]).withColumn("runs0", runs(F.col("level0")))
        each = F.transform(
            "items",
            lambda x, i: F.struct(
                x["doc_id"].alias("doc_id"),
                F.substring(F.get(F.col("runs0"), F.floor(i / ARITY).cast("int")), i % ARITY * WIDTH + 1, F.lit(WIDTH)).alias("leaf"),
                x["altered"].alias("altered"),
                F.concat(own_segments(i, F.col("level0"), F.col("level1"), F.col("runs0"), F.col("depth")), F.col("proof")).alias("segments"),
            ),
        )
        return stage.select("key", F.inline(each))


def build(docs: DataFrame, altered: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS) -> Manifest:
    """The manifest of ``docs``; ``altered`` are fields as a later holder of the rows may have them."""
    rows = numbered(leaves(docs, altered, fields), ["doc_id", "leaf"])
    sources = grow(rows.select("key", "pos", "n", F.col("leaf").alias("digest"), F.struct("doc_id", "altered").alias("item")))
    tops = numbered(sources.tops.select(F.lit("").alias("key"), F.col("key").alias("item"), "digest"), ["item"])
    return Manifest(sources, grow(tops))


def tampered_text(id_col: str = "doc_id", text_col: str = "text", every: int = 5) -> Column:
    """The text in lower case (A-Z only) where ``every`` divides the checksum of the identifier, else as it is."""
    chosen = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    return F.when(chosen, F.translate(F.col(text_col), UPPER, LOWER)).otherwise(F.col(text_col))


def verify(manifest: Manifest) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root (of the altered leaf) and verified."""
    subroots = manifest.subroots().withColumnRenamed("digest", "subroot")
    root = manifest.root().withColumnRenamed("digest", "root")
    folded = manifest.proofs().join(subroots, "key").crossJoin(F.broadcast(root))
    folded = folded.select("doc_id", "leaf", "subroot", "root", digest(proof_text(F.col("segments"))).alias("proof_sha256"), fold(F.col("altered"), F.col("segments")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
