"""All pairs of texts with similar n-gram sets, exactly and in bounded memory.

Every pair has to be looked at where all texts share common grams, so the pairs are dealt out: texts fall into blocks,
and each cell of the grid of blocks meets two of them. Spark moves texts, packed by block, once and never grams. The grams
of a block are numbered once, without loss, and stored with what the numbers stand for, so a cell looks at no text: it brings
two numberings together and counts. A Cartesian product reads the two rows of a cell where they are stored, so no cell
copies them; cells go round by round, and the pairs of a round are kept.

Within a cell, texts of a kind and of like size make tiles, and a tile meets another by one matrix product that bounds what
texts have in common from above; it settles unlike texts with about as many columns as a text has grams. What it leaves is
counted exactly, pair by pair, or with a column for each gram where many pairs are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narae.functions.automaton import GAP
from narae.session import discard, materialise, small_batches, tidy

#: Characters and texts of a block at most (a longer text is a block's only long one), and characters that are worth a block.
MOST_CHARS, MOST_TEXTS, LEAST_CHARS = 5_000_000, 16_384, 250_000
#: Bytes of texts that are packed together; cells of a round for each core, where that is more than a cell for each block.
PACKED, CELLS_OF_A_CORE = 32 << 20, 8
#: Into how many partitions files are dealt at least, if that many have a size of their own.
_FILES = "spark.sql.files.minPartitionNum"
#: Grams with a column of their own, at most, and the share of a tile's texts that must have them; texts of a tile; entries of a table of numbers; grams looked at one by one at once.
COMMON, SHARE, ROWS, COLUMNS, MOST_CELLS, AT_ONCE = 4096, 0.4, 512, 1024, 1 << 24, 1 << 22
#: Columns for each gram of a text, columns at most, and those multiplied at a time. A pair looked at by itself costs as much as so many columns.
WIDE, MOST_WIDE, AT_A_TIME, ONE_BY_ONE = 1.4, 1 << 15, 4096, 50_000
#: Grams that more of a tile's texts have get columns in exact counts; columns that a text of a list costs as much as; rows whose counts stay in the cache.
OFTEN, A_HIT, STRIP = 0.06, 250, 32
#: Kinds of texts in a block, at most.
KINDS = 8


def _numbered(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys below ``most`` as numbers from 0 on, in order, and the keys that there are."""
    if most <= MOST_CELLS:
        seen = np.zeros(most, bool)
        seen[keys] = True
        table = np.cumsum(seen, dtype=np.int32) - np.int32(1)
        return table[keys], np.flatnonzero(seen)
    found, numbers = np.unique(keys, return_inverse=True)
    return numbers.astype(np.int32), found


def _grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(owner, gram, book): gram_sets, and what the numbers stand for: letters, then for each length the number of what comes before * letters + letter."""
    own = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.maximum(own, n)
    if (own < n).any():  # filled up with what no text has
        full = np.full(int(size.sum()), GAP, np.uint32)
        full[np.repeat(np.cumsum(size) - size - np.cumsum(own) + own, own) + np.arange(len(codes))] = codes
        codes = full
    # Places whose gram ends within their text.
    places = np.ones(len(codes), bool)
    ends = np.cumsum(size)
    for k in range(1, n):
        places[ends - k] = False
    places = np.flatnonzero(places)
    letters, found = _numbered(codes, GAP + 1)
    book, width, grams = [found], len(found), letters
    for k in range(1, n):
        here = slice(len(codes) - k) if k < n - 1 else places
        grams, found = _numbered(grams[here] * np.int64(width) + letters[k:][here], len(book[-1]) * width)
        book.append(found)
    count = len(book[-1])
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), size - n + 1)
    keys = owner * count + (grams if n > 1 else grams[places])
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    owner = keys // count
    return owner.astype(np.int32), (keys - owner * count).astype(np.int32), book


def gram_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(owner, gram, how many numbers): the distinct n-grams of non-empty texts as numbers, by owner. A shorter text is its own only one."""
    owner, gram, book = _grams(texts, n)
    return owner, gram, len(book[-1])


def _of_both(first: list[np.ndarray], second: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of the grams of two books in a common one, and how many these are. Both keep their order."""

    def met(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        every = np.concatenate([a, b])
        every.sort(kind="stable")
        every = every[np.concatenate([[True], every[1:] != every[:-1]])]
        return np.searchsorted(every, a), np.searchsorted(every, b), len(every)

    widths = len(first[0]), len(second[0])
    letters = met(first[0], second[0])
    now = letters
    for a, b in zip(first[1:], second[1:]):
        sides = [before[keys // width] * letters[2] + letter[keys % width] for keys, width, before, letter in zip((a, b), widths, now, letters)]
        now = met(*sides)
    return now[0].astype(np.int32), now[1].astype(np.int32), now[2]


class Columns:
    """Texts of a tile by gram, as matrices of bounded width to multiply rows with."""

    def __init__(self, cell: Cell, c: int, d: int) -> None:
        self.count, self.texts = cell.count, d - c
        self.gram = cell.gram[cell.at[c] : cell.at[d]]
        self.owner = np.repeat(np.arange(d - c, dtype=np.int64), cell.size[c:d])
        self.seen = np.bincount(self.gram, minlength=cell.count)
        self.has = self.seen > 0
        self.grams = np.count_nonzero(self.has)
        self.usual = float(np.quantile(cell.size[c:d], 0.75))
        self.kept: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        self.lists = None

    def listed(self) -> tuple[np.ndarray, int, np.ndarray, np.ndarray, float]:
        """(column, width, begin, text, cost): a column for each common gram (-1: none), and of the others the texts that have each, one list after the other. cost: columns that counting with both costs as much as."""
        if self.lists is None:
            often = np.flatnonzero(self.seen > OFTEN * self.texts)
            column = np.full(len(self.seen), -1, np.int32)
            column[often] = np.arange(len(often), dtype=np.int32)
            rarer = self.seen.copy()
            rarer[often] = 0
            here = column[self.gram] < 0
            text = self.owner[here][np.argsort(self.gram[here], kind="stable")].astype(np.int32)
            cost = len(often) + A_HIT * float(np.square(rarer, dtype=np.float64).sum()) / self.texts**2
            self.lists = column, len(often), np.concatenate([[0], np.cumsum(rarer)]).astype(np.int32), text, cost
        return self.lists

    def dealt(self, width: int) -> np.ndarray:
        """Which of so many columns each gram goes to: common ones have their own, the others share; with a column for each gram, all have theirs."""
        if width == self.grams:
            return np.cumsum(self.has, dtype=np.int32) - np.int32(1)
        often = np.flatnonzero(self.seen > (SHARE * self.texts if width < 1.5 * WIDE * self.usual + 64 else 0))
        often = often[np.argsort(-self.seen[often], kind="stable")[: min(COMMON, width * 3 // 4)]]
        column = ((np.arange(self.count, dtype=np.uint64) * np.uint64(2654435769) & np.uint64(0xFFFFFFFF)) * np.uint64(width - len(often)) >> np.uint64(32)).astype(np.int32)
        column += np.int32(len(often))
        column[often] = np.arange(len(often), dtype=np.int32)
        return column

    def counts(self, column: np.ndarray, k: int, m: int, kind: type) -> np.ndarray:
        """How many grams each text has in the columns k to m."""
        place = column[self.gram]
        here = (place >= k) & (place < m)
        keys = self.owner[here] * (m - k) + (place[here] - k)
        return np.bincount(keys, minlength=self.texts * (m - k)).astype(kind).reshape(self.texts, m - k)


class Cell:
    """Grams of the texts of a cell, ready to be counted."""

    def __init__(self, texts: list[str], n: int, least: float) -> None:
        owner, gram, count = gram_sets(texts, n)
        self.hold(np.bincount(owner, minlength=len(texts)), gram, count, least)

    @classmethod
    def of_sets(cls, size: np.ndarray, gram: np.ndarray, count: int, least: float) -> Cell:
        cell = cls.__new__(cls)
        cell.hold(size, gram, count, least)
        return cell

    def hold(self, size: np.ndarray, gram: np.ndarray, count: int, least: float) -> None:
        """size: how many grams each text has; gram: these, text by text, below count."""
        self.size, self.gram, self.count, self.least = size.astype(np.int32), gram, count, least
        self.at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        self.mark = np.zeros(count, bool)
        self.dense = False
        self.lists: dict[tuple[int, int], Columns] = {}

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many grams the texts of each pair have in common; x ascends."""
        out = np.empty(len(x), np.int64)
        starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
        for s, t in zip(starts.tolist(), [*starts[1:].tolist(), len(x)]):
            own = self.gram[self.at[x[s]] : self.at[x[s] + 1]]
            self.mark[own] = True
            size = self.size[y[s:t]].astype(np.int64)
            upto = np.cumsum(size)
            k = 0
            while k < t - s:
                before = int(upto[k - 1]) if k else 0
                j = max(k + 1, int(np.searchsorted(upto, before + AT_ONCE, side="right")))
                has = self.mark[np.concatenate([self.gram[self.at[z] : self.at[z + 1]] for z in y[s + k : s + j].tolist()])]
                out[s + k : s + j] = np.add.reduceat(has, upto[k:j] - size[k:j] - before, dtype=np.int64)
                k = j
            self.mark[own] = False
        return out

    def _counted(self, gram: np.ndarray, row: np.ndarray, rows: int, columns: Columns, width: int, kind: type) -> np.ndarray:
        """At most how many grams rows have in common with the texts of a tile, exactly so with a column for each gram."""
        if width not in columns.kept:
            column = columns.dealt(width)
            columns.kept[width] = column, [columns.counts(column, 0, width, kind)] if width <= AT_A_TIME else []
        return self._product(gram, row, rows, columns, width, kind, *columns.kept[width])

    def _exactly(self, gram: np.ndarray, row: np.ndarray, rows: int, columns: Columns, kind: type) -> np.ndarray:
        """How many grams rows have in common with the texts of a tile: common grams by their columns, the others by lists."""
        column, width, begin, text, _ = columns.listed()
        if -1 not in columns.kept:
            columns.kept[-1] = column, [columns.counts(column, 0, width, kind)] if width <= AT_A_TIME else []
        often = column[gram] >= 0
        out = self._product(gram[often], row[often], rows, columns, width, kind, *columns.kept[-1]) if width else np.zeros((rows, columns.texts), kind)
        some = ~often & (begin[gram + 1] > begin[gram])
        gram, row = gram[some], row[some]
        first = begin[gram]
        many = begin[gram + 1] - first
        upto = np.cumsum(many, dtype=np.int64)
        at = np.searchsorted(row, np.arange(0, rows + STRIP, STRIP)).tolist()
        for e, s, t in zip(range(0, rows, STRIP), at, at[1:]):
            f = min(rows, e + STRIP)
            k = s
            while k < t:
                before = int(upto[k - 1]) if k else 0
                j = min(t, max(k + 1, int(np.searchsorted(upto, before + AT_ONCE, side="right"))))
                here = many[k:j]
                place = np.repeat((first[k:j] - (upto[k:j] - here - before)).astype(np.int32), here)
                place += np.arange(len(place), dtype=np.int32)
                place = text[place]
                place += np.repeat(((row[k:j] - e) * columns.texts).astype(np.int32), here)
                out[e:f] += np.bincount(place, minlength=(f - e) * columns.texts).reshape(f - e, columns.texts)
                k = j
        return out

    def _product(self, gram: np.ndarray, row: np.ndarray, rows: int, columns: Columns, width: int, kind: type, column: np.ndarray, kept: list[np.ndarray]) -> np.ndarray:
        place = column[gram]
        out = None
        for k in range(0, width, AT_A_TIME):
            m = min(width, k + AT_A_TIME)
            ones = np.zeros((rows, m - k), kind)
            if m - k == width:
                ones[row, place] = 1
            else:
                here = (place >= k) & (place < m)
                ones[row[here], place[here] - k] = 1
            more = ones @ (kept[0] if kept else columns.counts(column, k, m, kind)).T
            out = more if out is None else np.add(out, more, out=out)
        return out

    def near(self, a: int, b: int, c: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(x, y, common) of pairs of texts a to b with texts c to d, of which none that is similar is left out; common: their common grams, if these are counted already.

        Grams are dealt to columns. A text has no more in common with another than the other has grams in the columns
        where the text has any. That is one matrix product, which leaves few pairs if texts are unlike.
        """
        p, q, least = self.size[a:b], self.size[c:d], self.least
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        if p.max() < least * q.min() - 1e-6 or q.max() < least * p.min() - 1e-6:
            return none
        if (c, d) not in self.lists:
            self.lists[c, d] = Columns(self, c, d)
        columns = self.lists[c, d]
        share = least / (1 + least)
        # Rows with too few grams that any text of the tile has meet none of them; those left have these grams only.
        gram = self.gram[self.at[a] : self.at[b]]
        inside = columns.has[gram]
        known = np.add.reduceat(inside, self.at[a:b] - self.at[a], dtype=np.int64)
        rows = np.flatnonzero((known >= share * (p + int(q.min())) - 1e-2) & (p >= least * q.min() - 1e-6) & (p * least <= q.max() + 1e-6))
        if not len(rows):
            return none
        number = np.full(b - a, -1, np.int64)
        number[rows] = np.arange(len(rows))
        row = np.repeat(number, p)
        inside &= row >= 0
        row, gram = row[inside], gram[inside]
        kind = np.float32 if max(p.max(), q.max()) < 1 << 22 else np.float64
        need = np.add.outer((p[rows] * share - 1e-2).astype(kind), (q * share * (1 - 1e-6)).astype(kind))
        width = 64 * ceil(WIDE * columns.usual / 64)
        while True:
            width = min(width, MOST_WIDE, columns.grams)
            after = min(2 * width, MOST_WIDE, columns.grams)
            exact = width == columns.grams
            if self.dense and columns.listed()[-1] <= 2 * width:
                found, exact = self._exactly(gram, row, len(rows), columns, kind), True
            else:
                found = self._counted(gram, row, len(rows), columns, width, kind)
            fit = found >= need
            left = np.count_nonzero(fit)
            if exact or width == after or left * ONE_BY_ONE <= fit.size * after:
                break
            width, self.dense = after, True
        # As long as products leave much, those of the next tiles begin with exact counts, if these cost no more than twice as much.
        self.dense = left * ONE_BY_ONE > fit.size * columns.usual
        x, y = np.divmod(np.flatnonzero(fit), d - c)
        return a + rows[x], c + y, found[x, y].astype(np.int64) if exact else None

    def tile(self, a: int, b: int, c: int, d: int, wanted=None, chosen=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, y, score) of the similar pairs of texts a to b with texts c to d. wanted, chosen: which of them count, as a matrix or as a function of x and y."""
        x, y, common = self.near(a, b, c, d)
        keep = np.ones(len(x), bool) if wanted is None else wanted[x - a, y - c]
        if chosen is not None:
            keep &= chosen(x, y)
        x, y = x[keep], y[keep]
        common = self._common(x, y) if common is None else common[keep]
        score = common / (self.size[x].astype(np.int64) + self.size[y] - common)
        keep = score >= self.least
        return x[keep], y[keep], score[keep]


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _read(pack: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(pack.as_buffer()).read_all()


def _packs(own, packs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(packs, pa.binary())], names=["own", "pack"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(own, pack) of rows (own, ...): the rows of each block as a compressed Arrow stream."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("own")
        own, table = table["own"].to_numpy(), table.drop_columns("own")
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])).tolist()
        return _packs(own[starts], [_stream(table.slice(a, b - a)) for a, b in zip(starts, starts[1:] + [len(own)])])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= PACKED:
            yield pack(held)
            held, size = [], 0
    if held:
        yield pack(held)


def _kinds(texts: list[str]) -> np.ndarray:
    """Texts told apart roughly by how often their letters are (as those of languages are), so that tiles hold texts of a kind."""
    size = np.array([len(t) for t in texts], np.int64)
    letters, found = _numbered(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), GAP + 1)
    often = np.bincount(letters)
    width = min(64, len(found))
    column = np.full(len(found), width)
    column[np.argsort(-often, kind="stable")[:width]] = np.arange(width)
    share = np.zeros((len(texts), width), np.float32)
    for a in range(0, len(texts), ROWS):
        b = min(len(texts), a + ROWS)
        here = column[letters[size[:a].sum() : size[:b].sum()]]
        keys = np.repeat(np.arange(b - a), size[a:b]) * (width + 1) + here
        share[a:b] = np.sqrt(np.bincount(keys, minlength=(b - a) * (width + 1)).reshape(b - a, width + 1)[:, :width] / size[a:b, None])
    away = lambda middle: np.square(share).sum(axis=1)[:, None] - 2 * share @ middle.T + np.square(middle).sum(axis=1)
    middle = share.mean(axis=0, keepdims=True)
    while len(middle) < KINDS:
        middle = np.concatenate([middle, share[away(middle).min(axis=1).argmax()][None]])
    for _ in range(8):
        kind = away(middle).argmin(axis=1)
        # Kinds of few texts go to the nearest others.
        there = [k for k in range(len(middle)) if np.count_nonzero(kind == k) * 4 * KINDS >= len(texts)]
        middle = np.stack([share[kind == k].mean(axis=0) for k in there])
    return away(middle).argmin(axis=1).astype(np.int32)


def _planes(numbers: np.ndarray) -> list[bytes]:
    """The first bytes of all numbers, their second ones, and so on: those of small numbers compress to nothing."""
    digits = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1)
    return [digits[:, k].tobytes() for k in range(digits.shape[1])]


def _whole(planes, kind: type) -> np.ndarray:
    digits = np.empty((len(planes[0].as_buffer()), len(planes)), np.uint8)
    for k, plane in enumerate(planes):
        digits[:, k] = np.frombuffer(plane.as_buffer(), np.uint8)
    return digits.view(kind).reshape(-1)


def _steps(numbers: np.ndarray, starts=0) -> np.ndarray:
    """Ascending numbers as what each adds to the one before; those at starts begin anew."""
    steps = np.diff(numbers, prepend=numbers.dtype.type(0))
    steps[starts] = numbers[starts]
    return steps


def _block(table: pa.Table, n: int) -> bytes:
    """A block as it is stored: two streams, of its texts in order of kind and size (id, split, size, kind), and of their grams and what these stand for."""
    texts = table["text"].to_pylist()
    kind = _kinds(texts)
    order = np.lexsort((pc.utf8_length(table["text"]).to_numpy(), kind))
    owner, gram, book = _grams([texts[k] for k in order.tolist()], n)
    size = np.bincount(owner, minlength=len(texts)).astype(np.int32)
    rows = table.select(["id", "split"]).take(order).append_column("size", pa.array(size)).append_column("kind", pa.array(kind[order]))
    grams = [_planes(_steps(gram, np.cumsum(size) - size))] + [_planes(_steps(numbers.astype(np.int64))) for numbers in book]
    return _stream(rows) + _stream(pa.table({f"{i}.{k}": pa.array([plane], pa.large_binary()) for i, planes in enumerate(grams) for k, plane in enumerate(planes)}))


def _opened(pack: pa.BinaryScalar, n: int) -> tuple[pa.Table, np.ndarray, list[np.ndarray]]:
    """(texts, gram, book) of a stored block."""
    reader = pa.BufferReader(pack.as_buffer())
    rows = pa.ipc.open_stream(reader).read_all()
    more = pa.ipc.open_stream(reader).read_all()
    planes = lambda i, many: [more[f"{i}.{k}"][0] for k in range(many)]
    size = rows["size"].to_numpy().astype(np.int64)
    gram = np.cumsum(_whole(planes(0, 4), np.int32), dtype=np.int64)
    starts = np.cumsum(size) - size
    gram -= np.repeat(np.concatenate([[0], gram[starts[1:] - 1]]), size)
    return rows, gram.astype(np.int32), [np.cumsum(_whole(planes(1 + i, 8), np.int64)) for i in range(n)]


def _joined(n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(own, pack): the packs of each block as a stored one."""
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for k, own in enumerate(batch["own"].to_pylist()):
                held.setdefault(own, []).append(batch.slice(k, 1).rename_columns(["side", "pack"]))
        for own in list(held):
            yield _packs([own], [_block(_unpacked(iter(held.pop(own))), n)])

    return rows


def _unpacked(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """The rows of packs (side, pack), with their side."""
    tables = []
    for batch in batches:
        for side, pack in zip(batch["side"].to_pylist(), batch["pack"]):
            table = _read(pack)
            tables.append(table.append_column("side", pa.array(np.full(len(table), side, np.int32))))
    return pa.concat_tables(tables) if tables else None


def _tiles(kind: np.ndarray, begin: int, most: int) -> list[tuple[int, int]]:
    """From and up to which texts the tiles of a block go, which begins at a place; each holds texts of one kind."""
    cuts = [0, *(np.flatnonzero(kind[1:] != kind[:-1]) + 1).tolist(), len(kind)]
    return [(begin + k, begin + min(d, k + most)) for c, d in zip(cuts, cuts[1:]) for k in range(c, d, most)]


def _met(n: int, least: float, across: bool):
    def of_cell(packs: list[pa.BinaryScalar]) -> Iterator[pa.RecordBatch]:
        blocks = [_opened(pack, n) for pack in packs]
        texts, gram, book = blocks[-1]
        first = 0  # a block with itself
        count = len(book[-1])
        kinds = [x["kind"].to_numpy() for x, _, _ in blocks]
        columns, rows = _tiles(kinds[-1], 0, COLUMNS), _tiles(kinds[0], 0, ROWS)
        if len(blocks) == 2:
            mine, other, count = _of_both(blocks[0][2], book)
            gram = np.concatenate([mine[blocks[0][1]], other[gram]])
            texts = pa.concat_tables([blocks[0][0], texts])
            first = len(kinds[0])
            columns = _tiles(kinds[1], first, COLUMNS)
        del blocks, book
        ids, splits = texts["id"].combine_chunks(), texts["split"].combine_chunks()
        rank = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
        code = pc.fill_null(splits.dictionary_encode().indices, -1).to_numpy() if across else None
        cell = Cell.of_sets(texts["size"].to_numpy(), gram, count, least)
        del texts, gram

        def chosen(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            keep = rank[x] != rank[y]
            if not first:
                keep &= x < y
            if across:
                keep &= (code[x] != code[y]) & (code[x] >= 0) & (code[y] >= 0)
            return keep

        for c, d in columns:
            for a, b in rows:
                if not first and a >= d:
                    break
                x, y, score = cell.tile(a, b, c, d, chosen=chosen)
                low = rank[x] < rank[y]
                x, y = np.where(low, x, y), np.where(low, y, x)
                for k in range(0, len(x), 1 << 15):
                    i, j = pa.array(x[k : k + (1 << 15)]), pa.array(y[k : k + (1 << 15)])
                    yield pa.RecordBatch.from_arrays([ids.take(i), ids.take(j), splits.take(i), splits.take(j), pa.array(score[k : k + (1 << 15)])], names=["left_id", "right_id", "left_split", "right_split", "score"])
            cell.lists.clear()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from of_cell([batch[x][k] for x in ["first", "second"][: 1 + (batch["low"][k] != batch["high"][k])]])

    return rows


def blocks_of(texts: int, chars: int, cores: int) -> int:
    """Into how many blocks texts fall: as many as memory asks for, or as give all cores some cells, if the texts are worth it."""
    enough = isqrt(6 * cores) + 1
    return max(1, ceil(chars / MOST_CHARS), ceil(texts / MOST_TEXTS), min(enough, chars // LEAST_CHARS))


def rounds_of(blocks: int, cores: int) -> list[tuple[int, int]]:
    """Cells from and up to which are met together."""
    cells = blocks * (blocks + 1) // 2
    size = ceil(cells / ceil(cells / max(blocks, CELLS_OF_A_CORE * cores)))
    return [(a, min(cells, a + size)) for a in range(0, cells, size)]


def row_of(cell: int) -> int:
    """The higher block of a cell of the grid."""
    return (isqrt(8 * cell + 1) - 1) // 2


def pairs_of_texts(records: DataFrame, text: Column, n: int, least: float, across_splits: bool) -> DataFrame:
    """(left_id, right_id, left_split, right_split, score): all pairs of records (id, split) whose texts have similar n-gram sets."""
    spark = records.sparkSession
    small_batches(spark)
    cores = spark.sparkContext.defaultParallelism
    shown = records.select("id", "split", text.alias("text")).where("id is not null and text != ''")
    texts, chars = shown.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    blocks = blocks_of(texts, chars, cores)
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    packs = shown.withColumn("own", own).mapInArrow(tidy(_packed), "own int, pack binary").repartitionById(blocks, "own")
    stored = materialise(packs.mapInArrow(tidy(_joined(n)), "own int, pack binary"), "texts", "uncompressed", "own")
    kinds = {c: shown.schema[c].dataType.simpleString() for c in ("id", "split")}
    schema = f"left_id {kinds['id']}, right_id {kinds['id']}, left_split {kinds['split']}, right_split {kinds['split']}, score double"

    def met(a: int, b: int) -> DataFrame:
        most = row_of(b - 1)
        lower = stored.where(F.col("own") <= most).select(F.col("own").alias("low"), F.col("pack").alias("first"))
        higher = stored.where(F.col("own").between(row_of(a), most)).select(F.col("own").alias("high"), F.col("pack").alias("second"))
        cell = F.expr("high * (high + 1L) div 2 + low")
        # Each task reads its files of either side; no row is shuffled.
        cells = higher.hint("shuffle_replicate_nl").join(lower, (F.col("low") <= F.col("high")) & (cell >= a) & (cell < b))
        return cells.mapInArrow(tidy(_met(n, least, across_splits)), schema)

    rounds = rounds_of(blocks, cores)
    if len(rounds) == 1:
        return met(*rounds[0])
    before = spark.conf.get(_FILES, None)
    spark.conf.set(_FILES, blocks)  # a file is a block, and a task meets one with one
    try:
        found = [materialise(met(a, b), "met") for a, b in rounds]
    finally:
        spark.conf.unset(_FILES) if before is None else spark.conf.set(_FILES, before)
    discard(stored)
    return spark.read.schema(found[0].schema).parquet(*[x.scratch for x in found])
