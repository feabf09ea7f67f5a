"""Merkle dataset manifest: leaves of rows, trees of eight-fold runs, proofs by fractal traversal, verification.

Leaves are made in the JVM and ranged by (tree, place), so that no tree needs one task. A tree's leaves are
cut into aligned blocks of 8^4; a block is one packed row. Going up, each block gives its root, and block
roots are leaves of the next, 4096 times smaller forest, until each tree has one node. Going down, a task
walks the leaves of a block by fractal traversal: of each layer of stacked subtrees it keeps the existing one,
which holds the siblings of the present leaf, and a desired one, which grows by one leaf a step and replaces
it in time. Successive paths come out of bounded memory, and the block's own path (from the distributed forest
above) is appended to each.

Odd rows: fields that are null are ``-``; leaves of one tree ascend by doc_id (null first), then by leaf, so
that repeated rows are leaves of their own; an empty table has no rows. A text is changed as tampering only
where doc_id is not null. Columns beyond the five are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from narae.llm.shared import materialise, parts_for, small_batches, tidy

ARITY = 8
#: Levels of a block, and of a stacked subtree within it.
BLOCK_LEVELS, LAYER = 4, 2
BLOCK = ARITY**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEAF_BYTES = 32
#: Trees (one row each, some KB) up to which what stands above them is broadcast.
MOST_TREES = 4096


def node(text: bytes) -> bytes:
    """H of digests that are already joined: its lowercase hex form."""
    return hashlib.sha256(text).hexdigest().encode()


def levels_of(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    out = 0
    while leaves > 1:
        leaves, out = -(-leaves // ARITY), out + 1
    return out


def root_of(leaves: list[bytes], levels: int) -> bytes:
    """The node that stands ``levels`` above the leaves of a block."""
    for _ in range(levels):
        leaves = [node(b"".join(leaves[k : k + ARITY])) for k in range(0, len(leaves), ARITY)]
    return leaves[0]


class Subtree:
    """A stacked subtree while it grows: its nodes by level (the root left out), and the open runs below them.

    Leaves go in one at a time; at each level at most seven nodes wait for their run to close, and nodes below
    the subtree's own levels are dropped as soon as they are joined.
    """

    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high  # the levels whose nodes are kept: low to high - 1
        self.kept: list[list[bytes]] = [[] for _ in range(low, high)]
        self.open: list[list[bytes]] = [[] for _ in range(high)]

    def add(self, leaf: bytes) -> None:
        self._put(0, leaf)

    def _put(self, level: int, digest: bytes) -> None:
        while level < self.high:
            if level >= self.low:
                self.kept[level - self.low].append(digest)
            run = self.open[level]
            run.append(digest)
            if len(run) < ARITY or level + 1 == self.high:
                if level + 1 == self.high:
                    run.clear()  # the subtree's root is another layer's node
                return
            digest = node(b"".join(run))
            run.clear()
            level += 1

    def close(self) -> None:
        """No leaf follows: runs that are short are joined as they are."""
        for level in range(self.high - 1):
            if run := self.open[level]:
                digest = node(b"".join(run))
                run.clear()
                self._put(level + 1, digest)


class Traversal:
    """Successive authentication paths of a block's leaves.

    ``leaves`` gives the k-th leaf; ``levels`` of them stand in the block. A layer of ``height`` levels keeps two
    subtrees at most: 2 * (8 + 64) nodes and some open runs, whatever the block's size.
    """

    def __init__(self, leaves, size: int, levels: int, height: int = LAYER) -> None:
        self.leaves, self.size, self.levels = leaves, size, levels
        self.bounds = [(low, min(low + height, levels)) for low in range(0, levels, height)]
        self.existing, self.desired, self.fed = [], [], []
        for low, high in self.bounds:
            first = Subtree(low, high)
            for k in range(min(size, ARITY**high)):
                first.add(leaves(k))
            if size <= ARITY**high:
                first.close()
            self.existing.append(first)
            self.desired.append(Subtree(low, high))
            self.fed.append(ARITY**high)

    def __iter__(self) -> Iterator[list[tuple[bytes, bytes]]]:
        for at in range(self.size):
            path = []
            for j, (low, high) in enumerate(self.bounds):
                wide = ARITY**high
                if at and at % wide == 0:  # the desired subtree is whole by now
                    self.existing[j], self.desired[j] = self.desired[j], Subtree(low, high)
                for level in range(low, high):
                    place = at // ARITY**level % ARITY ** (high - level)
                    first = place - place % ARITY
                    run = self.existing[j].kept[level - low][first : first + ARITY]
                    path.append((b"".join(run[: place - first]), b"".join(run[place - first + 1 :])))
                if self.fed[j] < self.size:
                    self.desired[j].add(self.leaves(self.fed[j]))
                    self.fed[j] += 1
                    if self.fed[j] == self.size:
                        self.desired[j].close()
            yield path


def folded(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf has by a path of siblings to its left and right, level by level."""
    for left, right in path:
        leaf = node(left + leaf + right)
    return leaf


# --- leaves and their places -----------------------------------------------------------------


def tree_key(lang: Column) -> Column:
    """Names of trees in order: null first, then by UTF-8 bytes."""
    return F.when(lang.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), lang))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column | None = None) -> Column:
    """The digest of a row's five fields, as 32 bytes; ``text`` takes the place of the row's own."""
    columns = [F.col(c) for c in FIELDS[:-1]] + [F.col("text") if text is None else text]
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tampered_text() -> Column:
    """Lower-cased A-Z of the rows whose id's crc32 is divisible by 3; the row's own text for others."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return F.when(chosen, F.translate("text", _UPPER, _UPPER.lower())).otherwise(F.col("text"))


def placed(leaves: DataFrame, *order: str) -> DataFrame:
    """``leaves`` with ``place``, the number of a row in its ``tree``, from 0, by the order, and ``leaves``, the tree's rows.

    Rows are dealt by sampled ranges of (tree, order) and sorted there; what stands before comes from counts of
    (tree, part), so that no task holds a tree. Those counts are as many as parts and trees together.
    """
    ranged = leaves.repartitionByRange(parts_for(leaves), "tree", *order)
    numbered = ranged.sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id())
    held = materialise(numbered, "merkle-ranged").withColumn("_part", F.shiftright("_at", 33))
    counts = held.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    own = W.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("leaves"))
    return held.join(offsets, ["tree", "_part"]).withColumn("place", F.col("_shift") + F.col("_at")).drop("_part", "_at", "_shift")


# --- blocks ----------------------------------------------------------------------------------


def _hexes(raw: bytes) -> list[bytes]:
    text = raw.hex().encode()
    return [text[k : k + 2 * LEAF_BYTES] for k in range(0, len(text), 2 * LEAF_BYTES)]


def _block_levels(leaves: int) -> int:
    """Levels within a block of a tree: all of a tree of one block, else those of a full block."""
    return levels_of(leaves) if leaves <= BLOCK else BLOCK_LEVELS


def blocks(leaves: DataFrame) -> DataFrame:
    """One row a block of (tree, leaves, place, leaf, more...) rows: its digests packed in order, and its root.

    A block has 4096 rows at most, some 400 KB; a tree has as many blocks as it needs, so a large one is spread.
    """
    extra = [c for c in leaves.columns if c not in ("tree", "leaves", "place", "leaf")]
    rows = leaves.withColumn("block", F.expr(f"place div {BLOCK}"))
    members = F.array_sort(F.collect_list(F.struct("place", "leaf", *extra)))
    packed = rows.groupBy("tree", "leaves", "block").agg(members.alias("m"))

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for members, leaves in zip(batch.column("m"), batch.column("leaves").to_pylist()):
                digests = _hexes(b"".join(members.values.field("leaf").to_pylist()))
                out.append(bytes.fromhex(root_of(digests, _block_levels(leaves)).decode()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "root"])

    return packed.mapInArrow(tidy(roots), StructType([*packed.schema, StructField("root", BinaryType())]))


PATH = "array<struct<left:string,right:string>>"


def authenticated(leaves: DataFrame) -> DataFrame:
    """(tree, place, root, path) of (tree, leaves, place, leaf) rows whose places are 0, 1, ... in each tree.

    root: hex form of the tree's; path: siblings to the left and right of each level, from the leaf up.
    """
    held = materialise(blocks(leaves), "merkle-blocks")
    joined = held.drop("root").join(upper(held), ["tree", "block"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, size, block, members, root, above in zip(*(batch.column(c) for c in ("tree", "leaves", "block", "m", "root", "path"))):
                digests = _hexes(b"".join(members.values.field("leaf").to_pylist()))
                more = above.as_py()
                walk = Traversal(digests.__getitem__, len(digests), _block_levels(size.as_py()))
                paths = [[{"left": a.decode(), "right": b.decode()} for a, b in path] + more for path in walk]
                n = len(digests)
                kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree.as_py()] * n, pa.string()), members.values.field("place").cast(pa.int64()), pa.array([root.as_py()] * n, pa.string()), pa.array(paths, kind)], names=["tree", "place", "root", "path"]
                )

    return joined.mapInArrow(tidy(rows), f"tree string, place long, root string, path {PATH}")


def upper(held: DataFrame) -> DataFrame:
    """(tree, block, root, path): what stands above each block of a materialised block table.

    Block roots are the leaves of a forest 4096 times smaller; where each tree is one block, nothing is above.
    """
    if held.agg(F.max("block")).first()[0] in (None, 0):
        return held.select("tree", "block", F.lower(F.hex("root")).alias("root"), F.array().cast(PATH).alias("path"))
    fewer = F.ceil(F.col("leaves") / BLOCK).alias("leaves")
    above = authenticated(held.select("tree", fewer, F.col("block").alias("place"), F.col("root").alias("leaf")))
    return above.withColumnRenamed("place", "block")


# --- the manifest ----------------------------------------------------------------------------


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row; see the module's text.

    Each language is a tree, and their roots in order are the leaves of the last one. ``tampered``: the text that
    is presented for verification, by default that of ``tampered_text``. proof_sha256: H of all siblings, level
    by level, left to right; folded_root: the root that the presented row has by the proof of the original.
    """
    small_batches(docs.sparkSession)
    shown = leaf_of(tampered_text() if tampered is None else tampered)
    made = docs.select("doc_id", tree_key(F.col("lang")).alias("tree"), leaf_of().alias("leaf"), shown.alias("shown"))
    made = materialise(made.withColumn("shown", F.when(F.col("shown") != F.col("leaf"), F.col("shown"))), "merkle-leaves")
    held = materialise(blocks(placed(made, "doc_id", "leaf")), "merkle-blocks")
    inner = materialise(upper(held), "merkle-upper")
    roots = inner.select(F.col("tree").alias("own"), F.lit("").alias("tree"), F.unhex("root").alias("leaf")).distinct()
    trees = materialise(placed(materialise(roots, "merkle-roots"), "own"), "merkle-trees")
    last = authenticated(trees.drop("own")).select("place", F.col("root").alias("top"), F.col("path").alias("tail"))
    named = trees.select("place", F.col("own").alias("tree")).join(last, "place").select("tree", "top", "tail")
    if trees.count() <= MOST_TREES:  # else a tree with many blocks is left to the adaptive skew join
        named = F.broadcast(named)
    joined = held.drop("root").join(inner, ["tree", "block"]).join(named, "tree")
    joined = joined.select("leaves", "m", "root", "top", F.concat("path", "tail").alias("path"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, members, root, top, above in zip(*(batch.column(c) for c in ("leaves", "m", "root", "top", "path"))):
                values = members.values
                digests, shown = _hexes(b"".join(values.field("leaf").to_pylist())), values.field("shown").to_pylist()
                more = [(x["left"].encode(), x["right"].encode()) for x in above.as_py()]
                tail = b"".join(a + b for a, b in more)
                proofs, ends, top = [], [], top.as_py()
                for leaf, other, path in zip(digests, shown, Traversal(digests.__getitem__, len(digests), _block_levels(size.as_py()))):
                    proofs.append(hashlib.sha256(b"".join([a + b for a, b in path]) + tail).hexdigest())
                    ends.append(folded(other.hex().encode() if other else leaf, path + more).decode())
                n = len(digests)
                yield pa.RecordBatch.from_arrays(
                    [values.field("doc_id"), pa.array([d.decode() for d in digests]), pa.array([root.as_py()] * n, pa.string()), pa.array([top] * n, pa.string()), pa.array(proofs), pa.array(ends), pa.array(np.array([e == top for e in ends], bool))],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    return joined.mapInArrow(tidy(rows), f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
