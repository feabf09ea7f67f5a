"""Hierarchical Pitman-Yor language model.

Each word (and the start of a text, which is the end of another) has a restaurant of the tokens that
follow it in training texts. Its tables send their customers to one restaurant of words, where no
word before counts; the dishes there are drawn from a hierarchy of restaurants over the bytes of a word, where a context's parent is the context without its farthest
byte, down to no context and then to even odds. Every table of the word restaurant sends one customer
for each byte of its word (and the word's end) to the deepest byte restaurants, their tables send
customers to their parents, and so on. The end of a text is the empty word. All words that training
texts don't have are one event, as in the base score: its probability is what known words leave.

Seating is resampled level by level: all customers of a dish leave and come back one by one by the
restaurant's rule, given everyone else (for dishes with many customers, later ones in groups with the
expected number of new tables, randomly rounded). Predictive probabilities are averaged over samples.

Counts of words and of pairs (word before, token) over all training texts and their seatings stay
distributed. Texts are written once in blocks; what a block has of words and pairs travels packed, by ranges
of hashes (64 bits a word, PAIR_BITS a pair), and answers come back in the same order. Random numbers hang on
the pair, so that every block seats its pairs alike and tables need no exchange. Up to MOST_WINDOWS
windows, the byte hierarchy is gathered. Beyond, it stays distributed in blocks of contexts with the same
two nearest bytes, each with its own discounts; only the contexts of one byte and none are gathered, and
the blocks' predictions are broadcast in turn. Contexts have the same length either way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narae.llm.shared import (
    byte_slices, discard, grouped, join_texts, lower_ascii, materialise, merged, mix, pack, range_cuts, raw_texts, release, signed, small_batches, squeeze, tidy, tight, unpack, unsqueeze, word_bounds, word_hashes,
)

FOLDS, HELD_OUT = 5, 1
#: Bytes of context, and distinct (context, byte) pairs of the byte hierarchy that are held at once.
CONTEXT, MOST_WINDOWS = 4, 2_000_000
#: Bytes of context that blocks of the hierarchy share.
SPLIT = 2
#: Sweeps of the bytes' seating for each of the words', and samples that are averaged at the end.
SWEEPS, KEPT = 3, 2
#: Concentration of byte and word restaurants.
BYTE_STRENGTH, WORD_STRENGTH = 1.0, 10.0
#: Concentration of the restaurants after a word, and how often their customers are seated anew.
PAIR_STRENGTH, PAIR_ROUNDS = 1.0, 2
#: The end of a text, and what stands before its first word.
END = mix(np.zeros(1, dtype=np.uint64))[0]
#: Even odds over what may follow: all bytes but white space, and the end.
EVEN = 1.0 / 251
#: Customers of a dish that are seated one by one.
ONE_BY_ONE = 48
#: Pairs are seated by word probabilities to so many steps of a log10.
STEPS = 512
#: Bits of the hash that stands for a pair.
PAIR_BITS = 56
#: Bytes of text of a block, and for each range of words and pairs.
BLOCK_BYTES, PART_BYTES = 16 << 20, 24 << 20
SEED = 20


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, seeds: np.ndarray) -> np.ndarray:
    """Tables of each dish after its customers came back one by one.

    weight: (strength + discount * tables of the restaurant) * the parent's probability of the dish.
    The n-th next to a dish's t tables opens another with odds weight : n - discount * t. The random
    numbers depend on the seeds alone.
    """
    order = np.argsort(-customers)
    c, w, s = customers[order].astype(np.float64), weight[order], mix(seeds[order], SEED)
    tables = np.minimum(c, 1.0)
    low = -c
    n = 1
    while True:
        m = int(np.searchsorted(low, -n, side="left"))  # those with more than n customers
        if not m:
            break
        step = 1 if n < ONE_BY_ONE else max(1, n // 24)
        s[:m] *= np.uint64(0x5851F42D4C957F2D)  # a linear congruential generator a dish, of which the high bits count
        s[:m] += np.uint64(0x14057B7EF767814F)
        chance = (s[:m] >> np.uint64(11)) * 2.0**-53
        if step == 1:
            odds = tables[:m] * -discount
            odds += w[:m]
            odds += n
            tables[:m] += w[:m] > odds * chance
        else:
            come = np.minimum(c[:m] - n, step)
            odds = w[:m] / (w[:m] + n + (come - 1) / 2 - discount * tables[:m])
            tables[:m] = np.minimum(tables[:m] + np.floor(come * odds + chance), c[:m])
        n += step
    out = np.empty_like(tables)
    out[order] = tables
    return out


def _discount(customers: np.ndarray) -> float:
    """From the dishes with one and two customers."""
    ones, twos = int((customers == 1).sum()), int((customers == 2).sum())
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


@dataclass
class ByteModel:
    """Predictive tables of one sample: by level the known (context, byte) pairs and contexts."""

    context: int
    pairs: list[np.ndarray]
    odds: list[np.ndarray]
    contexts: list[np.ndarray]
    shares: list[np.ndarray]
    #: A block of a larger hierarchy has levels from SPLIT on, and the model of those above.
    above: ByteModel | None = None
    block: int = 0
    blocks: int = 1

    def log_odds(self, windows: np.ndarray) -> np.ndarray:
        """Natural log probability of the last byte of each window, given those before."""
        if self.blocks > 1:  # windows of other blocks count nothing
            mine, out = block_of(windows, self.context, self.blocks) == self.block, np.zeros(len(windows))
            out[mine] = replace(self, blocks=1).log_odds(windows[mine])
            return out
        out = np.empty(len(windows))
        at, known = _find(self.pairs[-1], windows)
        out[known] = self.odds[-1][at[known]]
        rest = windows[~known]
        if len(rest):
            lowest = self.context + 1 - len(self.pairs)
            p = np.exp(self.above.log_odds(rest >> np.uint64(8 * (self.context + 1 - lowest)))) if self.above else np.full(len(rest), EVEN)
            for k, level in enumerate(range(lowest, self.context + 1)):
                key = rest >> np.uint64(8 * (self.context - level))
                p *= _take(self.contexts[k], self.shares[k], key & np.uint64((1 << (8 * level)) - 1), 1.0)
                p = _take(self.pairs[k], self.odds[k], key, p)
            out[~known] = p
        return np.log(out)


def _take(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other) -> np.ndarray:
    at, known = _find(keys, wanted)
    return np.where(known, values[at], other) if len(keys) else np.broadcast_to(other, len(wanted)).copy()


def _find(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return at, keys[at] == values


def block_of(windows: np.ndarray, context: int, blocks: int) -> np.ndarray:
    """The block of each window: by the two nearest bytes of its context."""
    nearest = (windows >> np.uint64(8 * (context - SPLIT))) & np.uint64((1 << (8 * SPLIT)) - 1)
    return (mix(nearest, 5) % np.uint64(blocks)).astype(np.int32)


class ByteRestaurants:
    """The byte hierarchy's seating, from the customers of its deepest restaurants.

    With a model of the levels above, only those from SPLIT on.
    """

    def __init__(self, context: int, windows: np.ndarray, customers: np.ndarray, top: ByteModel | None = None):
        self.context, self.top = context, top
        self.levels: list[dict] = []
        keys = windows
        for level in range(context, SPLIT - 1 if top else -1, -1):
            names, restaurant = np.unique(keys & np.uint64((1 << (8 * level)) - 1), return_inverse=True)
            above, parent = np.unique(keys >> np.uint64(8), return_inverse=True) if level else (np.empty(0, np.uint64), np.zeros(len(keys), np.int64))
            self.levels.insert(0, {"keys": keys, "contexts": names, "restaurant": restaurant, "parent": parent})
            keys = above
        self.first = np.exp(top.log_odds(above)) if top else np.full(1, EVEN)
        self.seats(customers)

    def seats(self, customers: np.ndarray) -> None:
        """New customers at the deepest level; one table a dish wherever nothing is sampled yet."""
        for level in reversed(self.levels):
            level["customers"] = customers
            level["tables"] = np.minimum(customers, np.maximum(level.get("tables", 1.0), 1.0)) if len(customers) else customers
            customers = np.bincount(level["parent"], level["tables"], minlength=int(level["parent"].max(initial=-1)) + 1)

    def _shares(self, level: dict, discount: float) -> tuple[np.ndarray, np.ndarray]:
        n = len(level["contexts"])
        tables = np.bincount(level["restaurant"], level["tables"], minlength=n)
        customers = np.bincount(level["restaurant"], level["customers"], minlength=n)
        return BYTE_STRENGTH + discount * tables, BYTE_STRENGTH + customers

    def predict(self) -> ByteModel:
        odds, shares, above = [], [], self.first
        for k, level in enumerate(self.levels):
            d = _discount(level["customers"])
            new, total = self._shares(level, d)
            r = level["restaurant"]
            base = above[level["parent"]]
            above = (level["customers"] - d * level["tables"] + new[r] * base) / total[r]
            odds.append(above)
            shares.append(new / total)
        return ByteModel(self.context, [x["keys"] for x in self.levels], odds, [x["contexts"] for x in self.levels], shares, self.top)

    def sweep(self, seed: int) -> None:
        """Resamples all seatings, deepest first, so that each level's customers follow."""
        model = self.predict()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            d = _discount(level["customers"])
            new, _ = self._shares(level, d)
            base = (model.odds[k - 1] if k else self.first)[level["parent"]]
            level["tables"] = seat(level["customers"], new[level["restaurant"]] * base, d, mix(level["keys"], 31 + seed))
            if k:
                self.levels[k - 1]["customers"] = np.bincount(level["parent"], level["tables"], minlength=len(self.levels[k - 1]["keys"]))


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a binary column, each value's begin and size."""
    _, offsets, data = words.buffers()
    edge = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), edge[:-1], np.diff(edge)


def word_windows(words: pa.Array | list[bytes], context: int) -> tuple[np.ndarray, np.ndarray]:
    """The (context, byte) windows of words with their ends, and where each word's begin.

    Blanks stand before a word's start and as its end.
    """
    words = pa.array(words, pa.binary()) if isinstance(words, list) else words
    data, begin, size = _bytes_of(words)
    start = np.cumsum(size + context + 1) - size - context - 1
    buf = np.full(int(size.sum()) + (context + 1) * len(size) + 9, 32, np.uint8)
    if len(size):
        skip = np.cumsum(size) - size
        buf[np.arange(int(size.sum())) + np.repeat(start + context - skip, size)] = byte_slices(data, begin, size)
    edge = np.concatenate([[0], np.cumsum(size + 1)])
    at = np.arange(edge[-1]) - np.repeat(edge[:-1] - start, size + 1)
    wide = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    return wide[at] & np.uint64((1 << (8 * (context + 1))) - 1), edge


def log_spelling(model: ByteModel, words: pa.Array | list[bytes]) -> np.ndarray:
    """Natural log probability of the bytes of each word."""
    windows, edge = word_windows(words, model.context)
    known, where = np.unique(windows, return_inverse=True)
    logs = np.concatenate([[0.0], np.cumsum(model.log_odds(known)[where])])
    return logs[edge[1:]] - logs[edge[:-1]]


@dataclass
class Blocks:
    """One sample of a distributed byte hierarchy: (block, kind, level, key, value) rows, and the model above."""

    tables: DataFrame
    blocks: int
    top: ByteModel
    context: int

    def model(self, block: int) -> ByteModel:
        rows = self.tables.where((F.col("block") == block) & (F.col("kind") < 2)).select("kind", "level", "key", "value").toArrow()
        kind, level, key, value = (c.to_numpy() for c in rows.columns)
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for at in range(SPLIT, self.context + 1):
            for k in (0, 1):
                mine = np.flatnonzero((kind == k) & (level == at))
                keys = key[mine].astype(np.uint64)
                order = np.argsort(keys)
                parts[2 * k].append(keys[order])
                parts[2 * k + 1].append(value[mine][order])
        return ByteModel(self.context, *parts, self.top, block, self.blocks)


@dataclass
class WordSample:
    """What the predictive probability of a word needs of one sample."""

    model: ByteModel | Blocks
    discount: float
    tokens: int
    number: int
    tables: float  # of the whole restaurant, before its words are seated
    seated: float = 0.0  # and after
    known: float = 0.0  # probability that the bytes give to all training words together
    taken: float = 0.0  # discount of a table in predictions

    def settle(self, seated: float, known: float, once: int) -> None:
        """Takes in the seating, and the discount that leaves new words what they had in training:
        left out and met anew, a token is a new word as often as tokens are their word's only one."""
        self.seated, self.known = seated, known
        wanted = once / max(self.tokens, 1) * (WORD_STRENGTH + self.tokens) / max(1.0 - known, 1e-12)
        self.taken = min(0.95, max(0.01, (wanted - WORD_STRENGTH) / max(seated, 1.0)))

    @property
    def unseen(self) -> float:
        """Probability of the next token being any word that training texts don't have."""
        return (WORD_STRENGTH + self.taken * self.seated) * max(1.0 - self.known, 1e-12) / (WORD_STRENGTH + self.tokens)

    @property
    def fresh(self) -> float:
        """Probability of another table."""
        return (WORD_STRENGTH + self.taken * self.seated) / (WORD_STRENGTH + self.tokens)

    def probabilities(self, ids: np.ndarray, counts: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Of words with these ids and customers, given the probabilities of their spelling."""
        tables = self.seat(ids, counts, base)
        own = (counts - self.taken * tables + (WORD_STRENGTH + self.taken * self.seated) * base) / (WORD_STRENGTH + self.tokens)
        return np.where(counts > 0, own, self.unseen)

    def seat(self, ids: np.ndarray, counts: np.ndarray, base: np.ndarray) -> np.ndarray:
        return seat(counts, (WORD_STRENGTH + self.discount * self.tables) * base, self.discount, mix(ids, 61 + self.number))


# --- distributed -----------------------------------------------------------------------------


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def text_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the tokens of lower-cased texts with their ends, of the tokens before, and each text's begin."""
    buf, starts = join_texts(texts)
    begin, end, first = word_bounds(buf, starts)
    edge = np.concatenate([[0], np.cumsum(np.diff(first) + 1)])
    tokens = np.full(edge[-1], END, dtype=np.uint64)
    inner = np.ones(len(tokens), dtype=bool)
    inner[edge[1:] - 1] = False
    tokens[inner] = word_hashes(buf, begin, end)
    return tokens, np.concatenate([[END], tokens[:-1]]).astype(np.uint64)[: len(tokens)], edge


def pair_keys(contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """A hash of each pair, of PAIR_BITS bits."""
    return mix(mix(contexts, 7) * np.uint64(0x9FB21C651E98DF25) + tokens) >> np.uint64(64 - PAIR_BITS)


def _lowered(column) -> list[bytes]:
    return [lower_ascii(t) for t in raw_texts(column)]


def packed_texts(docs: DataFrame) -> DataFrame:
    """(block, size, data): the rows of docs in blocks of some BLOCK_BYTES, numbered by task, each compressed.

    Everything later refers to blocks, so they are written once.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block, size = TaskContext.get().partitionId() << 24, 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                for batch in held:
                    stream.write_batch(batch)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "size", "data"])

        for batch in batches:
            if len(batch):
                held.append(batch)
                size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield out()
                block, size = block + 1, 0
                held.clear()
        if held:
            yield out()

    texts = docs.select("doc_id", _held_out().alias("held_out"), F.encode("text", "UTF-8").alias("text"))
    return texts.mapInArrow(tidy(rows), "block long, size long, data binary")


def _block(data: bytes) -> tuple[pa.Table, list[bytes]]:
    """The rows of a block, and its texts in lower case."""
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    return table, [lower_ascii(t) for c in table.column("text").chunks for t in raw_texts(c)]


def _rows(names: list[str], columns: list) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "part": pa.int32(), "kind": pa.int32(), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, columns)], names=names)


def _spread(keys: np.ndarray, values: list[np.ndarray], parts: int, bits: int = 64) -> Iterator[tuple[int, bytes]]:
    """(range, packed keys and values) of sorted keys."""
    for part, a, b in range_cuts(keys, parts, bits):
        yield part, pack(squeeze(keys[a:b]), np.array([b - a]), *[tight(v[a:b]) for v in values])


def _training(table: pa.Table, edge: np.ndarray) -> np.ndarray:
    """Whether each token belongs to a training text."""
    held_out = np.array(table.column("held_out").combine_chunks().to_numpy(zero_copy_only=False), dtype=bool)
    return np.repeat(~held_out, np.diff(edge))


def word_counts(blocks: DataFrame, parts: int) -> DataFrame:
    """(part, id, word, seen) of all words of all texts, counting those of training texts only.

    Words travel by the ranges of their ids, once a block. Words with equal ids count as one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                table, texts = _block(data.as_buffer())
                buf, starts = join_texts(texts)
                begin, end, first = word_bounds(buf, starts)
                ids, at, where = grouped(word_hashes(buf, begin, end))
                training = _training(table, first)
                count = np.bincount(where[training], minlength=len(ids))
                size = (end - begin)[at]
                found = [(part, pack(np.array([b - a]), squeeze(ids[a:b]), tight(count[a:b]), tight(size[a:b]), byte_slices(buf, begin[at[a:b]], size[a:b]))) for part, a, b in range_cuts(ids, parts)]
                ends = len(texts) - sum(table.column("held_out").to_pylist())
                found.append((range_cuts(np.array([END]), parts)[0][0], pack(np.array([1]), squeeze(np.array([END])), tight(np.array([ends])), np.zeros(1, np.uint8), np.empty(0, np.uint8))))
                yield _rows(["part", "data"], list(zip(*found)))

    def reduce(table: pa.Table) -> pa.Table:
        found = [unpack(d.as_buffer()) for d in table.column("data")]
        ids = np.concatenate([unsqueeze(f[1], int(f[0][0])) for f in found])
        count, size, data = (np.concatenate([f[k] for f in found]) for k in (2, 3, 4))
        size = size.astype(np.int64)
        ids, at, where = grouped(ids)
        offsets = np.concatenate([[0], np.cumsum(size[at])])
        chars = byte_slices(data, (np.cumsum(size) - size)[at], size[at])
        words = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(chars)])
        part = np.full(len(ids), table.column("part")[0].as_py(), np.int32)
        return pa.table({"part": part, "id": signed(ids), "word": words, "seen": np.bincount(where, count).astype(np.int64)})

    packed = blocks.select("data").mapInArrow(tidy(rows), "part int, data binary")
    return packed.repartition(parts, "part").groupBy("part").applyInArrow(reduce, "part int, id long, word binary, seen long")


@dataclass
class Grouped:
    """Distinct words and pairs of a block: ids, the places in ids of each token and of the one before, each
    text's begin; pairs, a token at which each ends, and the pair that ends at each token."""

    ids: np.ndarray
    token: np.ndarray
    context: np.ndarray
    edge: np.ndarray
    pairs: np.ndarray
    at: np.ndarray
    where: np.ndarray


def _grouped(texts: list[bytes]) -> Grouped:
    tokens, contexts, edge = text_tokens(texts)
    ids, _, token = grouped(tokens)  # the end is among them
    context = np.empty_like(token)
    context[0], context[1:] = np.searchsorted(ids, END), token[:-1]
    return Grouped(ids, token, context, edge, *grouped(pair_keys(contexts, tokens), PAIR_BITS))


def pair_counts(blocks: DataFrame, parts: int) -> DataFrame:
    """(block, part, data) with, for the distinct pairs of a block in order, their count in all training texts
    and whether the block is the first to have them; with block -1, how many pairs occur once and twice."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                table, texts = _block(data.as_buffer())
                tokens, contexts, edge = text_tokens(texts)
                pairs, _, where = grouped(pair_keys(contexts, tokens), PAIR_BITS)
                count = np.bincount(where[_training(table, edge)], minlength=len(pairs))
                part, found = zip(*_spread(pairs, [count], parts, PAIR_BITS))
                yield _rows(["block", "part", "data"], [[block] * len(part), part, found])

    def reduce(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_numpy()
        order = np.argsort(blocks)
        found = [unpack(table.column("data")[int(k)].as_buffer()) for k in order]
        size = np.array([int(f[1][0]) for f in found])
        pairs = np.concatenate([unsqueeze(f[0], n) for f, n in zip(found, size)])
        _, first, where = np.unique(pairs, return_index=True, return_inverse=True)
        total = np.bincount(where, np.concatenate([f[2] for f in found])).astype(np.int64)
        owner = np.zeros(len(pairs), bool)
        owner[first] = True
        edge = np.concatenate([[0], np.cumsum(size)])
        out = [pack(tight(total[where[a:b]]), np.packbits(owner[a:b])) for a, b in zip(edge, edge[1:])]
        part = table.column("part")[0].as_py()
        out.append(pack(np.array([(total == 1).sum(), (total == 2).sum()])))
        return pa.Table.from_batches([_rows(["block", "part", "data"], [[*blocks[order], -1], [part] * len(out), out])])

    packed = blocks.select("block", "data").mapInArrow(tidy(rows), "block long, part int, data binary")
    return packed.repartition(parts, "part").groupBy("part").applyInArrow(reduce, "block long, part int, data binary")


def _replies(table: pa.Table, kind: int) -> list[list[np.ndarray]]:
    """The packed replies of one kind to a block, by range."""
    mine = sorted((p.as_py(), k) for k, (p, c) in enumerate(zip(table.column("part"), table.column("kind"))) if c.as_py() == kind)
    return [unpack(table.column("data")[k].as_buffer()) for _, k in mine]


def _counted(replies: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a block's pairs, and which are its own."""
    count = np.concatenate([r[0].astype(np.int64) for r in replies])
    return count, np.concatenate([np.unpackbits(r[1], count=len(r[0])).astype(bool) for r in replies])


def _by_block(left: DataFrame, right: DataFrame, parts: int):
    """Both sides by block, over a number of tasks that grows with the input."""
    return left.repartition(parts, "block").groupBy("block").cogroup(right.repartition(parts, "block").groupBy("block"))


def owned_pairs(blocks: DataFrame, counts: DataFrame, parts: int) -> DataFrame:
    """(block, kind, part, data) of the pairs that each block is the first to have, so of each pair once.

    Kind 0, by range of word ids: pairs met once after each word and with each token, and those met more
    often. Kind 1: the latter by (ids, their number, context, token, count), the middle two as places in ids.
    """

    def split(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.column("block")[0].as_py()
        _, texts = _block(left.column("data")[0].as_buffer())
        own = _grouped(texts)
        count, first = _counted(_replies(right, 0))
        sides = (own.context, own.token)
        sums = [np.bincount(side[own.at[first & some]], minlength=len(own.ids)) for some in (count == 1, count > 1) for side in sides]
        met = np.flatnonzero(np.any(sums, axis=0))
        out = [(0, part, data) for part, data in _spread(own.ids[met], [x[met] for x in sums], parts)]
        more = np.flatnonzero(first & (count > 1))
        if len(more):
            met = np.flatnonzero(sums[2] + sums[3])
            place = np.zeros(len(own.ids), np.int64)
            place[met] = np.arange(len(met))
            out.append((1, 0, pack(squeeze(own.ids[met]), np.array([len(met)]), *[tight(place[side[own.at[more]]]) for side in sides], tight(count[more]))))
        kind, part, data = list(zip(*out)) if out else ([], [], [])
        release()
        return pa.Table.from_batches([_rows(["block", "kind", "part", "data"], [[block] * len(out), kind, part, data])])

    replies = counts.where("block >= 0").select("block", F.lit(0).alias("kind"), "part", "data")
    return _by_block(blocks.select("block", "data"), replies, parts).applyInArrow(split, "block long, kind int, part int, data binary")


def word_sums(packed: DataFrame, names: list[str]) -> DataFrame:
    """(id, names) added up by id, from (part, data) rows."""

    def reduce(table: pa.Table) -> pa.Table:
        found = [unpack(d.as_buffer()) for d in table.column("data")]
        ids, where = np.unique(np.concatenate([unsqueeze(f[0], int(f[1][0])) for f in found]), return_inverse=True)
        sums = [np.bincount(where, np.concatenate([f[2 + k] for f in found])).astype(np.int64) for k in range(len(names))]
        return pa.table({"id": signed(ids)} | dict(zip(names, sums)))

    return packed.select("part", "data").groupBy("part").applyInArrow(reduce, "id long, " + ", ".join(f"{n} long" for n in names))


def answers(asked: DataFrame, words: DataFrame, names: list[str]) -> DataFrame:
    """(block, kind 1, part, data): the named columns of the words that (block, part, data) rows ask for, as
    they are in the table; asking ids is in their order."""
    kinds = [words.schema[n].dataType.simpleString() for n in names]

    def reply(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("id").to_numpy().view(np.uint64)
        order = np.argsort(ids)
        ids = ids[order]
        values = [right.column(n).to_numpy()[order] for n in names]
        out = []
        for block, data in zip(left.column("block").to_pylist(), left.column("data")):
            planes, n = unpack(data.as_buffer())
            at = np.searchsorted(ids, unsqueeze(planes, int(n[0])))
            out.append((block, pack(*[tight(v[at]) if kind == "bigint" else v[at] for v, kind in zip(values, kinds)])))
        blocks, data = list(zip(*out)) if out else ([], [])
        part = left.column("part")[0].as_py() if out else 0
        return pa.Table.from_batches([_rows(["block", "kind", "part", "data"], [blocks, [1] * len(out), [part] * len(out), data])])

    return asked.groupBy("part").cogroup(words.select("part", "id", *names).groupBy("part")).applyInArrow(reply, "block long, kind int, part int, data binary")


def _joined(replies: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*replies)]


def pair_seats(pairs: np.ndarray, context: np.ndarray, token: np.ndarray, count: np.ndarray, values: tuple[np.ndarray, np.ndarray], discount: float, number: int) -> np.ndarray:
    """Tables of each pair in one round, from the round's (odds, tables) of the words that context and token
    point to; odds are in 1/STEPS of a negative log10. Pairs met once have one table. Random numbers depend on the pair and the round alone:
    whoever seats a pair seats it alike."""
    odds, tables = values
    out = np.minimum(count, 1).astype(np.float64)
    some = np.flatnonzero(count > 1)
    weight = (PAIR_STRENGTH + discount * tables[context[some]].astype(np.float64)) * 10.0 ** (odds[token[some]] / -STEPS)
    out[some] = seat(count[some], weight, discount, mix(pairs[some], 91 + number))
    return out


def seat_pairs(owned: DataFrame, state: DataFrame, parts: int, discount: float, number: int) -> DataFrame:
    """(id, context_now, token_now): tables of the pairs met more than once, by the word before and by the token.

    Seated anew given the columns odds_N and tables_N of the words, N being the round's number.
    """
    several = owned.where("kind = 1").select("block", "data")

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                planes, size = unpack(data.as_buffer())[:2]
                part, found = zip(*_spread(unsqueeze(planes, int(size[0])), [], parts))
                yield _rows(["block", "part", "data"], [[block] * len(part), part, found])

    def seated(left: pa.Table, right: pa.Table) -> pa.Table:
        planes, size, context, token, count = unpack(left.column("data")[0].as_buffer())
        ids = unsqueeze(planes, int(size[0]))
        tables = pair_seats(pair_keys(ids[context], ids[token]), context, token, count.astype(np.int64), _joined(_replies(right, 1)), discount, number)
        sums = [np.bincount(side, tables, minlength=len(ids)).astype(np.int64) for side in (context, token)]
        part, data = zip(*_spread(ids, sums, parts))
        return pa.Table.from_batches([_rows(["part", "data"], [part, data])])

    asked = several.mapInArrow(tidy(asking), "block long, part int, data binary")
    reply = answers(asked, state, [f"odds_{number}", f"tables_{number}"])
    return word_sums(_by_block(several, reply, parts).applyInArrow(seated, "part int, data binary"), ["context_now", "token_now"])


def _windows(counts: DataFrame, context: int, sample=None) -> DataFrame:
    """(window, customers) of the byte hierarchy: from one table a word, or from a sample's seating.

    Window -1 has the tables of the word restaurant, -2 the words' probability by their bytes.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = known = 0.0
        for batch in merged(batches):
            words, count = batch.column("word"), batch.column("count").to_numpy()
            windows, edge = word_windows(words, context)
            names, where = np.unique(windows, return_inverse=True)
            if sample is None:
                own = np.ones(len(words))
            else:
                if "log_base" in batch.schema.names:
                    base = np.exp(batch.column("log_base").to_numpy())
                else:
                    logs = np.concatenate([[0.0], np.cumsum(sample.value.model.log_odds(names)[where])])
                    base = np.exp(logs[edge[1:]] - logs[edge[:-1]])
                own = sample.value.seat(batch.column("id").to_numpy().view(np.uint64), count, base)
                known += base.sum()
            tables += own.sum()
            customers = np.bincount(where, np.repeat(own, np.diff(edge)), minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(customers)], names=["window", "customers"])
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2], pa.int64()), pa.array([tables, known])], names=["window", "customers"])

    found = counts.where("count > 0").select("id", "word", "count", *[c for c in counts.columns if c == "log_base"]).mapInArrow(tidy(rows), "window long, customers double")
    return found.groupBy("window").agg(F.sum("customers").alias("customers"))


def seat_blocks(windows: DataFrame, context: int, blocks: int, top: ByteModel, sweeps: int) -> DataFrame:
    """(block, kind, level, key, value) of each block's restaurants after so many sweeps: the odds of
    pairs (kind 0), the shares of contexts (1) and the customers that go to the level above (2)."""
    names = ["block", "kind", "level", "key", "value"]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = block_of(batch.column(0).to_numpy().astype(np.uint64), context, blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], names=["block", "window", "customers"])

    def seated(table: pa.Table) -> pa.Table:
        keys, customers = table.column("window").to_numpy().astype(np.uint64), np.round(table.column("customers").to_numpy())
        order = np.argsort(keys)
        restaurants = ByteRestaurants(context, keys[order], customers[order], top)
        for sweep in range(sweeps):
            restaurants.sweep(sweep)
        model, low = restaurants.predict(), restaurants.levels[0]
        upper, where = np.unique(low["keys"] >> np.uint64(8), return_inverse=True)
        found = [(0, SPLIT + k, a, b) for k, (a, b) in enumerate(zip(model.pairs, model.odds))] + [(1, SPLIT + k, a, b) for k, (a, b) in enumerate(zip(model.contexts, model.shares))]
        found.append((2, SPLIT - 1, upper, np.bincount(where, low["tables"], minlength=len(upper))))
        block = table.column("block")[0].as_py()
        size = [len(f[2]) for f in found]
        columns = [np.full(sum(size), block, np.int32), np.repeat([f[0] for f in found], size).astype(np.int32), np.repeat([f[1] for f in found], size).astype(np.int32), signed(np.concatenate([f[2] for f in found])), np.concatenate([f[3] for f in found])]
        return pa.table({n: pa.array(c) for n, c in zip(names, columns)})

    rows = windows.where("window >= 0").mapInArrow(tidy(numbered), "block int, window long, customers double")
    return rows.groupBy("block").applyInArrow(seated, "block int, kind int, level int, key long, value double")


def with_bases(counts: DataFrame, model: Blocks, name: str) -> DataFrame:
    """Word counts with the natural log probability of each word's spelling, block by block."""

    def added(rows: DataFrame, shared) -> DataFrame:
        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in merged(batches):
                total = batch.column(batch.num_columns - 1).to_numpy() + log_spelling(shared.value, batch.column("word"))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total)], names=batch.schema.names)

        return rows.mapInArrow(tidy(one), rows.schema)

    out = counts.withColumn(name, F.lit(0.0))
    for block in range(model.blocks):
        shared = counts.sparkSession.sparkContext.broadcast(model.model(block))
        out = materialise(added(out, shared), "word-bases")
        shared.unpersist()
    return out


def _top(rows: DataFrame) -> ByteRestaurants:
    """The restaurants of the short contexts, from the (key, value) customers of the deepest."""
    found = rows.toArrow()
    keys, customers = found.column(0).to_numpy().astype(np.uint64), np.round(found.column(1).to_numpy())
    order = np.argsort(keys)
    top = ByteRestaurants(SPLIT - 1, keys[order], customers[order])
    for sweep in range(SWEEPS):
        top.sweep(sweep)
    return top


def _gathered(windows: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Sorted windows and their customers; the words' tables and their probability by their bytes."""
    rows = windows.toArrow()
    keys, customers = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    order = np.argsort(keys)
    order = order[keys[order] >= 0]
    return keys[order].astype(np.uint64), np.round(customers[order]), float(customers[keys == -1].sum()), float(customers[keys == -2].sum())


class Words:
    """The sampler of the restaurant of words and of the byte hierarchy below it; the seating of bytes is kept
    from sample to sample, and so are discounts. Samples may differ in the customers of the words, not in
    which words have any."""

    def __init__(self, counts: DataFrame):
        first = materialise(_windows(counts, CONTEXT), "windows")
        self.blocks = max(1, -(-first.count() // MOST_WINDOWS))
        self.samples: list[WordSample] = []
        self.discount = 0.0
        if self.blocks > 1:
            lower = first.where("window >= 0").select(F.shiftright("window", 8 * (CONTEXT - SPLIT)).alias("key")).distinct()
            self.top = _top(lower.groupBy(F.shiftright("key", 8).alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")))
            self.windows = first
            self.tables = float(counts.where("count > 0").count())
        else:
            keys, customers, self.tables, _ = _gathered(first)
            self.restaurants = ByteRestaurants(CONTEXT, keys, customers)  # all samples meet the same windows

    def sample(self, counts: DataFrame) -> WordSample:
        """Another sample, given the words' customers."""
        spark = counts.sparkSession
        seen = counts.where("count > 0")
        n, ones, twos = seen.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.col("count") == 1), F.count_if(F.col("count") == 2)).first()
        discount = self.discount or (min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5)
        number = len(self.samples)
        if self.blocks > 1:
            drawn = materialise(seat_blocks(self.windows, CONTEXT, self.blocks, self.top.predict(), SWEEPS * (number + 1)), "byte-tables")
            sample = WordSample(Blocks(drawn, self.blocks, self.top.predict(), CONTEXT), discount, n, number, self.tables)
            based = with_bases(seen.select("id", "word", "count"), sample.model, "log_base")
            self.windows = materialise(_windows(based, CONTEXT, spark.sparkContext.broadcast(replace(sample, model=None))), "windows")
            found = dict(self.windows.where("window < 0").select("window", "customers").collect())
            self.tables, known = found.get(-1, 0.0), found.get(-2, 0.0)
            self.top = _top(drawn.where("kind = 2").groupBy("key").agg(F.sum("value").alias("value")))
        else:
            for sweep in range(SWEEPS):
                self.restaurants.sweep(number * SWEEPS + sweep)
            sample = WordSample(self.restaurants.predict(), discount, n, number, self.tables)
            _, customers, self.tables, known = _gathered(_windows(counts, CONTEXT, spark.sparkContext.broadcast(sample)))
            self.restaurants.seats(customers)
        sample.settle(self.tables, known, ones)
        self.discount = sample.taken
        self.samples.append(sample)
        return sample


def predictions(counts: DataFrame, samples: list[WordSample]) -> DataFrame:
    """Word counts (id, word, count and more) with log_odds and spelled: log10 of the averaged predictive
    probability of each word, where words that training texts lack are one event, and by their spelling."""
    columns = counts.columns
    for k, s in enumerate(samples):
        if isinstance(s.model, Blocks):
            counts = with_bases(counts, s.model, f"log_base_{k}")
    shared = counts.sparkSession.sparkContext.broadcast([replace(s, model=None) if isinstance(s.model, Blocks) else s for s in samples])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches):
            at = batch.schema.names.index
            ids, count = batch.column(at("id")).to_numpy().view(np.uint64), batch.column(at("count")).to_numpy()
            total, spelled = 0.0, np.full(len(ids), -np.inf)
            for k, s in enumerate(shared.value):
                logs = log_spelling(s.model, batch.column(at("word"))) if s.model else batch.column(at(f"log_base_{k}")).to_numpy()
                total = total + s.probabilities(ids, count, np.exp(logs))
                spelled = np.logaddexp(spelled, logs + np.log(s.fresh))
            log_odds = np.log10(total / len(shared.value))
            spelled = np.where(count > 0, log_odds, (spelled - np.log(len(shared.value))) / np.log(10))
            kept = [batch.column(at(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(log_odds.astype(np.float32)), pa.array(spelled.astype(np.float32))], names=[*columns, "log_odds", "spelled"])

    fields = ", ".join(f"{c} {counts.schema[c].dataType.simpleString()}" for c in columns)
    return counts.mapInArrow(tidy(rows), f"{fields}, log_odds float, spelled float")


@dataclass
class Fitted:
    """The fitted model of a table of texts, all of it but the byte hierarchy distributed.

    words: (part, id, seen, log_odds, spelled, seated (tables of the restaurant after the word, added up over
    the rounds), and odds_N and tables_N from which round N seated pairs). ``spelled`` is 0 where a word is seen.
    """

    blocks: DataFrame
    words: DataFrame
    counts: DataFrame
    parts: int
    discount: float
    tokens: int
    types: int

    @property
    def values(self) -> list[str]:
        return ["seen", "log_odds", "spelled", "seated", *[f"{c}_{k}" for k in range(PAIR_ROUNDS) for c in ("odds", "tables")]]


def fit_texts(docs: DataFrame) -> Fitted:
    """Counts words and pairs, and seats them in turn. Seatings start from one table a pair."""
    spark = docs.sparkSession
    blocks = materialise(packed_texts(docs), "texts")
    size = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    words = materialise(word_counts(blocks, parts), "words")
    n, types = words.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.count_if(F.col("seen") > 0)).first()
    counts = materialise(pair_counts(blocks, parts), "pair-counts")
    ones, twos = np.sum([[0, 0], *[unpack(bytes(r.data))[0] for r in counts.where("block = -1").select("data").collect()]], axis=0).tolist()  # two numbers a part
    discount = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
    owned = materialise(owned_pairs(blocks, counts, parts), "pairs-owned")

    def with_sums(rows: DataFrame, sums: DataFrame) -> DataFrame:
        return rows.join(sums, "id", "left").na.fill(0, sums.columns[1:])

    state = with_sums(words, word_sums(owned.where("kind = 0"), ["context_once", "token_once", "context_more", "token_more"]))
    state = state.withColumns({"count": F.expr("token_once + token_more"), "tables": F.expr("context_once + context_more"), "seated": F.lit(0).cast("long")}).drop("context_more", "token_more")
    state = materialise(state, "word-customers")
    discard(words)
    words = Words(state)
    for number in range(PAIR_ROUNDS):
        words.sample(state)
        odds = predictions(state, words.samples[-1:])
        odds = odds.withColumn(f"odds_{number}", F.round(F.col("log_odds") * -STEPS).cast("long")).withColumnRenamed("tables", f"tables_{number}").drop("log_odds", "spelled")
        odds, before = materialise(odds, "word-odds"), state
        sums = seat_pairs(owned, odds, parts, discount, number)
        state = with_sums(odds, sums).withColumns({"count": F.expr("token_once + token_now"), "tables": F.expr("context_once + context_now"), "seated": F.expr("seated + context_once + context_now")})
        state = materialise(state.drop("context_now", "token_now"), "word-customers")
        discard(before, odds)
    discard(owned)
    for _ in range(KEPT):
        words.sample(state)
    odds = predictions(state, words.samples[-KEPT:]).withColumn("spelled", F.expr("if(seen > 0, cast(0 as float), spelled)"))
    out = Fitted(blocks, state, counts, parts, discount, n, types)
    out.words = materialise(odds.select("part", "id", *out.values), "word-odds")
    discard(state)
    return out


def language_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelled_score, perplexity) of each text.

    Tokens are the lower-cased (A-Z) words and one end; score is by the token before each. In base_score
    and score, words that training texts lack are one event; spelled_score, and the perplexity by it,
    tell them by their bytes. A null text is empty: its end is its only token. A null doc_id is training
    text. Repeated rows count and score each. Without training texts base_score and score are 0, as all
    words are unseen.
    """
    small_batches(docs.sparkSession)
    model = fit_texts(docs)
    n, discount, parts = model.tokens, model.discount, model.parts
    unit = n + 0.5 * (model.types + 1)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                tokens, _, _ = text_tokens(_block(data.as_buffer())[1])
                part, found = zip(*_spread(np.unique(tokens), [], parts))
                yield _rows(["block", "part", "data"], [[block] * len(part), part, found])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        table, texts = _block(left.column("data")[0].as_buffer())
        mine = _grouped(texts)
        seen, log_odds, spelled, seated, *rounds = _joined(_replies(right, 1))
        count, _ = _counted(_replies(right, 0))
        tables = np.zeros(len(count))
        for k in range(PAIR_ROUNDS):
            tables += pair_seats(mine.pairs, mine.context[mine.at], mine.token[mine.at], count, rounds[2 * k : 2 * k + 2], discount, k)
        seen, log_odds, spelled = (x.astype(np.float64) for x in (seen, log_odds, spelled))
        new, total = PAIR_STRENGTH + discount / PAIR_ROUNDS * seated.astype(np.float64), PAIR_STRENGTH + seen
        own = (count - discount / PAIR_ROUNDS * tables)[mine.where]
        model_ = np.log10((own + new[mine.context] * (10.0**log_odds)[mine.token]) / total[mine.context])
        known = seen > 0
        by_bytes = model_.copy()
        unseen = np.flatnonzero(~known[mine.token])
        by_bytes[unseen] = np.log10(new / total)[mine.context[unseen]] + spelled[mine.token[unseen]]
        values = (known.astype(np.float64)[mine.token], np.log10((seen + 0.5) / unit)[mine.token], model_, by_bytes)
        n_known, base, model_, by_bytes = (np.add.reduceat(v, mine.edge[:-1]) for v in values)
        size = np.diff(mine.edge)
        release()
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": pa.array(size.astype(np.int64)), "n_known": pa.array(n_known.astype(np.int64)),
            "train_tokens": pa.array(np.full(len(size), n, dtype=np.int64)), "base_score": pa.array(base), "score": pa.array(model_), "spelled_score": pa.array(by_bytes),
            "perplexity": pa.array(10.0 ** (-by_bytes / np.maximum(size, 1))),
        })

    asked = model.blocks.select("block", "data").mapInArrow(tidy(asking), "block long, part int, data binary")
    told = answers(asked, model.words, model.values).unionByName(model.counts.where("block >= 0").select("block", F.lit(0).alias("kind"), "part", "data"))
    ident = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {ident}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, spelled_score double, perplexity double"
    return _by_block(model.blocks.select("block", "data"), told, parts).applyInArrow(score, schema)
