"""N-gram Jaccard join: blocked sparse products of the document by n-gram incidence matrix.

A document's row of the matrix is its set of hashed word n-grams. Equal rows collapse to one. Blocks
come from an exact bound: linked sets differ in at most k elements, k by their size band, so of more than k
ranges of the hash space some hold the same elements; documents that share the contents of a range
share a block, named by its smallest document. Parity sketches, which differ in no more bits than sets
do in elements, leave out what links to nothing in its block before rows are fetched. Within a block, products of matrix rows
accumulate overlap counts; pairs beyond the bounds of sizes and sketches are discarded before, and pairs already connected are not multiplied again.
Large blocks are split, with the few rows that do not link to the block's own document compared
across the parts. Every link between different rows is found or implied by others, so components
are exact.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narae.llm.components import components
from narae.llm.shared import (
    MOST_BROADCAST, NO_ID, PIECE, join_texts, lower_ascii, materialise, mix, only_listed, parts_for, pieces, raw_texts, row_key, runs_of, signed, small_batches, window_hashes, windows_inside, word_bounds, word_hashes, tidy,
)

#: Elements of the rows of a block at most; larger blocks are split.
BLOCK_ELEMENTS = 1_000_000
#: Members of a block whose sketches are compared with one another before their rows are fetched.
MOST_COMPARED = 4096
#: Sketch words that a comparison holds at once.
MOST_WORDS = 1 << 21
#: Ratio of a size band's borders.
BAND = 1.3


class Bounds:
    """Size bands and the numbers that a similarity of num / den implies."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the similarity must be in (0, 1]")
        self.num, self.den = num, den
        self._ranges: dict[int, tuple[int, int]] = {}
        ratio = max(BAND, 1.05 * den / num)
        self.borders = [1]
        while self.borders[-1] < 1 << 40:
            self.borders.append(max(self.borders[-1] + 1, -int(-self.borders[-1] * ratio // 1)))

    def bands(self, size: int) -> list[int]:
        """A document's own band, and the next if it may link to a document in that."""
        own = bisect_right(self.borders, size) - 1
        return [own, own + 1] if size * self.den >= self.num * self.borders[own + 1] else [own]

    def ranges(self, band: int) -> tuple[int, int]:
        """Ranges of a band, and how many of them beyond k + 1: so many may be empty in a document
        before empty ranges count as contents. A document of the band hardly ever has more."""
        if band not in self._ranges:
            most = self.most_apart(self.borders[band + 1] - 1, self.borders[band + 1] - 1)
            least = max(1, -(-self.borders[band] * self.num // self.den))
            spare = 2
            for _ in range(8):
                n = most + 1 + spare
                empty = n * (1 - 1 / n) ** least
                spare = max(spare, int(empty + 3 * empty**0.5 + 2))
            self._ranges[band] = (most + 1 + spare, spare)
        return self._ranges[band]

    def linked(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)

    def most_apart(self, a, b):
        """Elements in one of two linked sets alone, at most."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of each text, and where each text's begin (one more at the end)."""
    buf, starts = join_texts([lower_ascii(t) for t in texts])
    begin, end, first = word_bounds(buf, starts)
    words = word_hashes(buf, begin, end)
    at, text = windows_inside(first, n)
    hashes = window_hashes(words, n)[at] if len(at) else np.empty(0, np.uint64)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < n))
    if len(short):
        whole = [window_hashes(words[first[k] : first[k + 1]], int(first[k + 1] - first[k]), 1)[0] for k in short]
        hashes, text = np.concatenate([hashes, np.array(whole, np.uint64)]), np.concatenate([text, short])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(texts) + 1))


def signatures(hashes: np.ndarray, edge: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the ranges' contents for all sets, and the set each belongs to."""
    size = np.diff(edge)
    tasks = [(k, band) for k in np.flatnonzero(size) for band in bounds.bands(int(size[k]))]
    if not tasks:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    owner = np.array([k for k, _ in tasks])
    band = np.array([b for _, b in tasks])
    n_ranges, spare = np.array([bounds.ranges(int(b)) for b in band]).T
    n = size[owner]
    task = np.repeat(np.arange(len(tasks)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + edge[owner][task]
    part = (hashes[place] >> np.uint64(32)) * n_ranges[task].astype(np.uint64) >> np.uint64(32)
    # Sets are sorted by hash, so the elements of a range are neighbours.
    offset = np.cumsum(n_ranges) - n_ranges
    ident = offset[task] + part.astype(np.int64)
    run = runs_of(ident)[:-1]
    content = np.add.reduceat(mix(hashes[place], 3), run)
    name = band[task[run]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part[run] * np.uint64(0xC2B2AE3D27D4EB4F)
    out, of = mix(content + mix(name, 5), 7), owner[task[run]]
    full = np.bincount(task[run], minlength=len(tasks))
    extra, extra_of = [], []
    at = np.searchsorted(task[run], np.arange(len(tasks) + 1))
    for k in np.flatnonzero(n_ranges - full > spare):
        empty = np.setdiff1d(np.arange(n_ranges[k]), part[run[at[k] : at[k + 1]]].astype(np.int64)).astype(np.uint64)
        extra.append(mix(mix(band[k : k + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + empty * np.uint64(0xC2B2AE3D27D4EB4F), 5), 11))
        extra_of.append(np.full(len(empty), owner[k]))
    return np.concatenate([out, *extra]), np.concatenate([of, *extra_of])


# --- products within a block -----------------------------------------------------------------


class Forest:
    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.parent = [first.setdefault(label, k) for k, label in enumerate(labels)]

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = k = self.parent[self.parent[k]]
        return k

    def roots(self) -> np.ndarray:
        return np.array([self.root(k) for k in range(len(self.parent))])

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def sketch_bits(size: int, bounds: Bounds) -> int:
    """Bits of a set's sketch: a power of two, several times the differences that a link allows."""
    return min(1 << 16, max(64, 1 << (6 * int(bounds.most_apart(size, size))).bit_length()))


def sketches(hashes: np.ndarray, edge: np.ndarray, bounds: Bounds) -> list[bytes]:
    """Parities of the elements of each set in each of its classes: sets differ in as many elements at
    least as their sketches do in bits. Halves of a sketch, one on the other, make a shorter one."""
    size = np.diff(edge)
    bits = np.array([sketch_bits(int(n), bounds) for n in size], dtype=np.int64)
    offset = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(size)), size)
    place = offset[owner] + (mix(hashes, 13) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(place, minlength=int(offset[-1])) & 1
    packed = np.packbits(odd.astype(np.uint8)).tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(offset, offset[1:])]


def folded(sketch: bytes, width: int) -> np.ndarray:
    out = np.frombuffer(sketch, np.uint8)
    while len(out) > width:
        half = len(out) // 2
        out = out[:half] ^ out[half:]
    return out


def may_link(size: list[int], sketch: list[bytes], bounds: Bounds) -> np.ndarray:
    """Which sets may link to another of those given, by sizes and sketches."""
    n, width = np.array(size, dtype=np.int64), min(map(len, sketch))
    rows = np.stack([folded(x, width) for x in sketch]).view(np.uint64)
    out = np.zeros(len(n), dtype=bool)
    step = max(1, MOST_WORDS // rows.size)
    for a in range(0, len(n), step):
        some = slice(a, a + step)
        apart = np.bitwise_count(rows[some, None, :] ^ rows[None, :, :]).sum(axis=2, dtype=np.int64)
        close = apart <= bounds.most_apart(n[some, None], n[None, :])
        close &= bounds.den * np.minimum(n[some, None], n[None, :]) >= bounds.num * np.maximum(n[some, None], n[None, :])
        close[np.arange(len(close)), np.arange(a, a + len(close))] = False
        out[some] |= close.any(axis=1)
    return out


def block_links(rows: list[np.ndarray], bounds: Bounds, labels: list[int] | None = None, probes: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning set of the links among a block's rows, as index pairs.

    The first row is multiplied with all others; then each row outside its component with those that
    the bounds leave and that it is not connected with. ``labels``: what is connected already;
    ``probes``: the rows to multiply (default: all).
    """
    size = np.array(list(map(len, rows)), dtype=np.int64)
    if len(rows) < 2:
        return []
    hashes = np.concatenate(rows)
    edge = np.concatenate([[0], np.cumsum(size)])
    forest = Forest(labels or list(range(len(rows))))
    out: list[tuple[int, int]] = []
    parities, roots, known = None, forest.roots(), 0
    for turn, p in enumerate(range(len(rows)) if probes is None else probes):
        if len(out) > known:
            roots, known = forest.roots(), len(out)
        if turn and probes is None and roots[p] == roots[0]:
            continue
        others = np.flatnonzero((roots != roots[p]) & (bounds.den * np.minimum(size, size[p]) >= bounds.num * np.maximum(size, size[p])))
        if turn or probes is not None:
            if probes is None:
                others = others[(others > p) | (roots[others] == roots[0])]  # each pair once
            if not len(others):
                continue
            if parities is None:
                own = sketches(hashes, edge, bounds)
                parities = np.stack([folded(x, min(map(len, own))) for x in own]).view(np.uint64)
            apart = np.bitwise_count(parities[others] ^ parities[p]).sum(axis=1)
            others = others[apart <= bounds.most_apart(size[others], size[p])]
        if not len(others):
            continue
        if len(others) * 3 > len(rows):
            there = _in_sorted(hashes, rows[p])
            total = np.concatenate([[0], np.cumsum(there)])
            common = (total[edge[1:]] - total[edge[:-1]])[others]
        else:
            common = np.array([np.count_nonzero(_in_sorted(rows[q], rows[p])) for q in others])
        for q in others[bounds.linked(common, size[others], size[p])]:
            if forest.join(p, int(q)):
                out.append((p, int(q)))
    return out


def _in_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


# --- DataFrames ------------------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(row_key().alias("_key"), F.encode("text", "UTF-8").alias("_text"))


#: Rows of the first exchange: documents, and packed signatures or block members for a part.
DOCUMENT, PACKED = 0, 1
_FIRST = "kind int, part int, key long, n_shingles long, d1 long, d2 long, payload binary"
_NAMES = [c.split()[0] for c in _FIRST.split(", ")]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_NAMES)


def _packed(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(rows)
    return _batch([[PACKED] * n, [r[0] for r in rows], *[[None] * n] * 4, [r[1] for r in rows]])


def _deal(found: np.ndarray, of: np.ndarray, nodes: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Signatures by part: each payload has its nodes, the signatures, and whose each is (two bytes)."""
    part = (found % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edge = runs_of(part[order])
    rows = []
    for a, b in zip(edge, edge[1:]):
        some = order[a:b]
        own, where = np.unique(of[some], return_inverse=True)
        head = np.array([len(own), len(some)], dtype=np.int64)
        rows.append((int(part[some[0]]), head.tobytes() + nodes[own].tobytes() + found[some].tobytes() + where.astype(np.uint16).tobytes()))
    return rows


def _dealt(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and nodes of payloads."""
    found, nodes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for data in payloads:
        n, m = np.frombuffer(data, np.int64, 2)
        own = np.frombuffer(data, np.int64, n, 16)
        found.append(np.frombuffer(data, np.uint64, m, 16 + 8 * n))
        nodes.append(own[np.frombuffer(data, np.uint16, m, 16 + 8 * n + 8 * m)])
    return np.concatenate(found), np.concatenate(nodes)


def _first_pass(docs: DataFrame, n: int, bounds: Bounds, parts: int) -> DataFrame:
    """Documents (key, size and digest of the set, sketch) and block members of all rows of docs.

    Signatures go to their part; there, documents with a signature in common become members (hub,
    node) of a block, dealt out by hub. Of what repeats, each part sends on one pair.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, all_texts = batch.column(0).to_numpy(), raw_texts(batch.column(1))
            for start, stop in pieces(all_texts, PIECE // 2):
                for a in range(start, stop, 1 << 16):
                    b = min(stop, a + (1 << 16))
                    hashes, edge = shingle_sets(all_texts[a:b], n)
                    sums = [np.concatenate([[0], np.cumsum(mix(hashes, seed))]).astype(np.uint64) for seed in (21, 22)]
                    digests = [signed(s[edge[1:]] - s[edge[:-1]]) for s in sums]
                    spread = keys[a:b] & 0x7FFFFFFF
                    yield _batch([np.zeros(b - a, np.int32), spread.astype(np.int32), keys[a:b], np.diff(edge), *digests, sketches(hashes, edge, bounds)])
                    found, of = signatures(hashes, edge, bounds)
                    yield _packed(_deal(found, of, keys[a:b], parts))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payloads: list[bytes] = []
        for batch in batches:
            packed = batch.column(0).to_numpy() == PACKED
            payloads += batch.filter(pa.array(packed)).column(6).to_pylist()
            yield batch.filter(pa.array(~packed))
        found, nodes = _dealt(payloads)
        order = np.lexsort((nodes, found))
        found, nodes = found[order], nodes[order]
        edge = runs_of(found)
        hub = np.repeat(nodes[edge[:-1]], np.diff(edge))
        several = np.repeat(nodes[edge[1:] - 1], np.diff(edge)) != hub
        yield _packed(_pairs(*_distinct(hub[several], nodes[several]), parts))

    return _texts(docs).mapInArrow(tidy(rows), _FIRST).repartition(parts, "part").mapInArrow(tidy(gather), _FIRST)


def _pairs(hub: np.ndarray, nodes: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    part = (mix(hub.view(np.uint64), 41) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edge = runs_of(part[order])
    return [(int(part[order[a]]), np.stack([hub[order[a:b]], nodes[order[a:b]]]).tobytes()) for a, b in zip(edge, edge[1:])]


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.ones(len(first), dtype=bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    return first[new], second[new]


def _members(first: DataFrame, parts: int) -> DataFrame:
    """(hub, node): the distinct members of blocks, the hub of each included."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.frombuffer(v.as_buffer(), np.int64).reshape(2, -1) for batch in batches for v in batch.column(1)]
        hub, nodes = _distinct(*np.concatenate(got, axis=1)) if got else np.empty((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(hub), pa.array(nodes)], names=["hub", "node"])

    packed = first.where(F.col("kind") == PACKED).select("part", "payload")
    return packed.repartition(parts, "part").mapInArrow(tidy(members), "hub long, node long")


def _promising(members: DataFrame, bounds: Bounds, parts: int) -> DataFrame:
    """The members (hub, node) of (hub, node, size, sketch) rows that may link to another of their block.

    Sketches of a block are compared with one another where sizes allow a link; blocks beyond
    MOST_COMPARED members pass whole.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        hub = None

        def done() -> pa.RecordBatch:
            keep = block
            if len(block) > 1:
                near = may_link([r[1] for r in block], [r[2] for r in block], bounds)
                keep = [r for r, k in zip(block, near) if k]
            nodes = {r[0] for r in keep} | ({hub} if keep else set())
            return pa.RecordBatch.from_arrays([pa.array([hub] * len(nodes), pa.int64()), pa.array(sorted(nodes), pa.int64())], names=["hub", "node"])

        for batch in batches:
            for name, node, size, sketch in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if name != hub:
                    if block:
                        yield done()
                    block, hub = [], name
                block.append((node, size, sketch))
        if block:
            yield done()

    # Large blocks pass where they stand: only those that are compared are brought together.
    large = members.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_COMPARED).select("hub")
    small = members.select("hub", "node", "size", "sketch").join(large, "hub", "left_anti")
    placed = small.repartition(parts, "hub").sortWithinPartitions("hub", "node")
    return placed.mapInArrow(tidy(rows), "hub long, node long").unionByName(members.select("hub", "node").join(large, "hub", "left_semi"))


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(_key, set): packed sorted n-gram hashes of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts = raw_texts(batch.column(1))
            for a, b in pieces(all_texts):
                hashes, edge = shingle_sets(all_texts[a:b], n)
                packed = [hashes[x:y].tobytes() for x, y in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(packed, pa.binary())], names=["_key", "set"])

    return docs.mapInArrow(tidy(rows), "_key long, set binary")


def _multiply(rows: DataFrame, bounds: Bounds, parts: int) -> DataFrame:
    """Links (a, b) found in the blocks of (hub, sub, node, label, probe, set) rows.

    Rows stream in sorted by block, the hub's own first; one block is held at a time.
    """

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        name = None

        def done() -> pa.RecordBatch:
            sets = [np.frombuffer(r[3], np.uint64) for r in block]
            labels = [r[1] if r[1] is not None else -1 - k for k, r in enumerate(block)]
            probes = [k for k, r in enumerate(block) if r[2]] if any(r[2] is not None for r in block) else None
            pairs = block_links(sets, bounds, labels, probes)
            return pa.RecordBatch.from_arrays([pa.array([block[p[k]][0] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(5)]
            for hub, sub, node, label, probe, packed in zip(*columns, batch.column(5)):
                if name != (hub, sub):
                    if block:
                        yield done()
                    block, name = [], (hub, sub)
                block.append((node, label, probe, packed.as_buffer().to_pybytes()))
        if block:
            yield done()

    placed = rows.select("hub", "sub", "node", "label", "probe", "set").withColumn("_first", F.col("node") != F.col("hub"))
    placed = placed.repartition(parts, "hub", "sub").sortWithinPartitions("hub", "sub", "_first", "node").drop("_first")
    return placed.mapInArrow(tidy(links), "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row.

    Words are lower-cased (A-Z). A set holds the distinct n-grams, or the whole sequence where there
    are fewer words than n. Sets link at ``den * intersection >= num * union``; a document without
    words has an empty set and links with nothing. Rows with the same doc_id are one document, with
    the links of all of them; a null doc_id comes after all others and stays null as component.
    """
    spark = docs.sparkSession
    parts = parts_for(docs)
    bounds = Bounds(num, den)
    small_batches(spark)
    first = materialise(_first_pass(docs, n, bounds, parts), "jaccard-first")
    rows = first.where(F.col("kind") == DOCUMENT).select("key", "n_shingles", "d1", "d2", F.col("payload").alias("sketch"))
    full = rows.where("n_shingles > 0")
    classes = materialise(full.groupBy("d1", "d2", "n_shingles").agg(F.min("key").alias("rep")), "jaccard-classes")
    own = full.select("key", "d1", "d2", "n_shingles").join(classes, ["d1", "d2", "n_shingles"]).select("key", "rep")
    links = own.where("key != rep").select(F.col("key").alias("a"), F.col("rep").alias("b"))

    # Of equal rows the first alone takes part in blocks; it is the hub wherever they share one.
    chosen = full.join(classes.select(F.col("rep").alias("key"), "d1", "d2"), ["key", "d1", "d2"], "left_semi").dropDuplicates(["key", "d1", "d2"])
    chosen = chosen.select(F.col("key").alias("node"), F.col("n_shingles").alias("size"), "sketch")
    blocks = materialise(_promising(_members(first, parts).join(chosen, "node"), bounds, parts), "jaccard-blocks")
    wanted = blocks.select(F.col("node").alias("_key")).distinct()
    sets = materialise(_sets(only_listed(_texts(docs), wanted, "_key"), n), "jaccard-sets", "lz4").withColumnRenamed("_key", "node")

    elements = blocks.join(sets.groupBy("node").agg(F.sum(F.octet_length("set") / 8).alias("n")), "node")
    parts_of = elements.groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK_ELEMENTS).cast("int").alias("subs"))
    placed = blocks.join(parts_of, "hub")
    sub = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0), F.col("subs") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("subs")).cast("int")))
    members = placed.select("hub", "node", "subs", F.explode(sub).alias("sub"))
    none = F.lit(None)
    near = materialise(_multiply(members.join(sets, "node").withColumn("label", none.cast("long")).withColumn("probe", none.cast("boolean")), bounds, parts), "jaccard-near")

    large = members.where("subs > 1").drop("subs")
    if large.limit(1).count():
        near = near.unionByName(_across(large, near, sets, bounds, parts))
    return _labelled(rows, components(links.unionByName(near)), docs)


def _across(large: DataFrame, near: DataFrame, sets: DataFrame, bounds: Bounds, parts: int) -> DataFrame:
    """Links across the parts of split blocks: rows not connected to the block's own document meet
    every part of it, in groups of bounded size."""
    found = components(near)
    own = large.join(found, "node", "left").select("hub", "node", "sub", F.coalesce("component", "node").alias("label")).distinct()
    of_hub = own.where("node = hub").select("hub", F.col("label").alias("_hub_label")).distinct()
    own = materialise(own.join(of_hub, "hub"), "jaccard-split")
    rest = own.where("label != _hub_label").join(sets.groupBy("node").agg(F.sum(F.octet_length("set") / 8).alias("n")), "node")
    turns = rest.groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK_ELEMENTS).cast("int").alias("turns"))
    subs = own.groupBy("hub").agg((F.max("sub") + 1).alias("subs"))
    # A group is a part and a turn: its members, and the remaining rows of that turn, which are multiplied with them.
    name = F.col("sub") * F.col("turns") + F.col("turn")
    turn = F.pmod(F.xxhash64("node", F.lit(1)), F.col("turns")).cast("int")
    members = own.join(turns, "hub").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select("hub", name.alias("sub"), "node", "label", F.lit(False).alias("probe"))
    probes = rest.join(turns, "hub").join(subs, "hub").withColumn("turn", turn).drop("sub").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    probes = probes.select("hub", name.alias("sub"), "node", "label", F.lit(True).alias("probe"))
    groups = members.unionByName(probes).groupBy("hub", "sub", "node", "label").agg(F.max("probe").alias("probe"))
    return materialise(_multiply(groups.join(sets, "node"), bounds, parts), "jaccard-across")


def _labelled(rows: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    joined = rows.select("key", "n_shingles").join(found.withColumnRenamed("node", "key"), "key", "left")
    kind = docs.schema["doc_id"].dataType
    plain = lambda c: F.when(c != NO_ID, c).cast(kind)
    return joined.select(plain(F.col("key")).alias("doc_id"), "n_shingles", plain(F.coalesce("component", "key")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component, the one of smallest doc_id, as it is."""
    found = materialise(jaccard_components(docs, n, num, den), "jaccard-components")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(row_key().alias("_key")).distinct()
    keyed = docs.withColumn("_key", row_key())
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    kept = keyed.join(gone, "_key", "left_anti")
    if found.groupBy(row_key()).count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["_key"])  # rows with the same doc_id are one document
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
