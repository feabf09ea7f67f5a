"""Toxicity: a support vector machine over a gap-weighted subsequence kernel, with Nyström landmarks.

The kernel of two pieces (words, or spelled-out runs of single characters) sums over all common subsequences of
four characters, each weighing less the wider it is spread, so that gaps and inserted characters cost
little by little. It is normalised and squared. A sentence is the sum of its pieces (a convolution kernel), so its
decision is a sum of one number a piece, which workers remember.

Landmarks are the pieces that tell toxic training documents best, no two of them alike, and common pieces. Labels are
of documents: of a toxic one, the sentence that the present machine finds worst is its labelled sentence, and all
sentences of clean ones are negative; machine and choice alternate. A document's score is a logistic function
of its three worst sentences.

The machine is fitted on the labelled documents outside fold 0 with the smallest hashes of their ids, ``most`` of
each class, and of each of these on ``SENTENCES`` sentences, those most like the landmarks. Scoring reads every
text whole. Null and empty texts have no sentence and get the score of an empty one; a null doc_id has no label
and is not held out; repeated labels count once, contradicting ones once each; without labels of both classes
the score is that of the one class seen, or 0.5. Columns beyond doc_id and text are left alone.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narae.llm.quality import Constant, fold
from narae.llm.shared import materialise, pieces, release, small_batches, tidy

#: Characters of the subsequences, and what each step of spread weighs.
ORDER, DECAY = 4, np.float32(0.7)
#: Documents of each class, and sentences of a document, that the machine is fitted on at most.
MOST, SENTENCES = 1500, 24
TELLING, COMMON = 26, 6
#: Landmarks are less alike than this, and tell the classes apart by so many standard errors; candidates for them.
ALIKE, LEAST_Z, CANDIDATES = 0.12, 2.5, 400
#: Characters of a spelled-out run at least.
RUN = 3
#: Pieces of a sentence at most, and characters of a piece: longer ones go by overlapping windows.
PIECES, WIDE = 24, 32
WORST = 3
ROUNDS, COST = 5, 1.0
FOLDS, THRESHOLD = 5, 0.5
#: Pairs of pieces that go through the kernel together.
PAIRS = 4096
#: Bytes of text that are judged together.
SLICE = 4 << 20
#: Words that a worker remembers.
REMEMBERED = 300_000

_MARKS = re.compile(r"[\W_]+")
_LINE = "\0"


# --- the kernel ------------------------------------------------------------------------------


def coded(pieces: list[str], alphabet: dict[str, int]) -> np.ndarray:
    """Pieces of one length as rows of character numbers, 0 for those outside the alphabet."""
    get = alphabet.get
    return np.array([[get(c, 0) for c in p] for p in pieces], np.int16).reshape(len(pieces), -1)


def alphabet_of(pieces: list[str]) -> dict[str, int]:
    return {c: k + 1 for k, c in enumerate(sorted(set("".join(pieces))))}


def subsequence_kernel(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Sum over common subsequences of ORDER characters, DECAY to the power of both spreads.

    rows: (n, length) characters, 0 for one that matches none; others: (width, n, m) characters in columns. Gives (n, m). One step a character of the rows,
    over all pairs at once.
    """
    width, n, m = len(others), len(rows), others.shape[2]
    square = DECAY * DECAY
    # before[q][j]: weight of matches of q characters in what was read and the first j of the others.
    before = [np.ones((width + 1, n, m), np.float32)] + [np.zeros((width + 1, n, m), np.float32) for _ in range(ORDER - 1)]
    total = np.zeros((n, m), np.float32)
    open_, hit = np.empty((n, m), np.float32), np.empty((width, n, m), np.float32)
    for i in range(rows.shape[1]):
        equal = others == rows[:, i][None, :, None]
        np.multiply(equal, before[ORDER - 1][:-1], out=hit)
        total += hit.sum(axis=0)
        for q in range(ORDER - 1, 0, -1):
            np.multiply(equal, before[q - 1][:-1], out=hit)
            before[q] *= DECAY
            open_[:] = 0
            for j in range(width):
                open_ *= DECAY
                open_ += hit[j]
                before[q][j + 1] += open_
        # (The weight of a match is put on once a character, at the end.)
    return total * square**ORDER


def self_kernel(pieces: list[str]) -> np.ndarray:
    """The kernel of each of some pieces of one length with itself."""
    rows = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(pieces), -1)
    return subsequence_kernel(rows, np.ascontiguousarray(rows.T)[:, :, None])[:, 0]


def letter_masks(rows: np.ndarray, letters: int) -> np.ndarray:
    """(n, words) bit masks: for each character of the alphabet whether a row has it once, twice and three times."""
    counts = np.zeros((len(rows), letters + 1), np.int16)
    for i in range(rows.shape[1]):
        counts[np.arange(len(rows)), rows[:, i]] += 1
    bits = np.concatenate([counts[:, 1:] >= k for k in (1, 2, 3)], axis=1)
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


class Landmarks:
    """The squared normalised kernel of pieces with some landmarks.

    Only pairs with ORDER characters in common can have a common subsequence; all others are left out before.
    """

    def __init__(self, pieces: list[str]) -> None:
        self.pieces, self.alphabet = pieces, alphabet_of(pieces)
        self.norms = np.array([self_kernel([p])[0] if len(p) >= ORDER else 1 for p in pieces], np.float32)
        self.by_size = []  # (numbers, characters, masks, often) of the landmarks of a length
        sizes = np.array([len(p) for p in pieces])
        for size in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == size)
            rows = coded([pieces[k] for k in of], self.alphabet)
            often = np.array([max(pieces[k].count(c) for c in pieces[k]) > 3 for k in of])  # beyond what masks can tell
            self.by_size.append((of, rows.T.copy(), letter_masks(rows, len(self.alphabet)), often))

    def likeness(self, asked: list[str]) -> np.ndarray:
        """(asked, landmarks); a piece has at most WIDE characters. Pairs of the same lengths go together, in small blocks."""
        out = np.zeros((len(asked), len(self.pieces)), np.float32)
        sizes = np.fromiter(map(len, asked), np.int32, len(asked))
        for size in np.unique(sizes[sizes >= ORDER]).tolist():
            at = np.flatnonzero(sizes == size)
            rows = coded([asked[k] for k in at], self.alphabet)
            masks, own = letter_masks(rows, len(self.alphabet)), np.zeros(len(at), np.float32)
            met = []
            for of, columns, theirs, often in self.by_size:
                common = np.bitwise_count(masks[:, None, :] & theirs[None, :, :]).sum(axis=2)
                met.append(np.nonzero((common >= ORDER) | often))
            some = np.unique(np.concatenate([r for r, _ in met]))
            for begin in range(0, len(some), PAIRS):
                part = some[begin : begin + PAIRS]
                own[part] = self_kernel([asked[k] for k in at[part]])
            for (of, columns, _, _), (r, z) in zip(self.by_size, met):
                for begin in range(0, len(r), PAIRS):
                    a, b = r[begin : begin + PAIRS], z[begin : begin + PAIRS]
                    both = subsequence_kernel(rows[a], columns[:, b][:, :, None])[:, 0]
                    out[at[a], of[b]] = both * both / (own[a] * self.norms[of[b]])
        return out


# --- pieces and sentences --------------------------------------------------------------------


def windows(piece: str) -> list[str]:
    """A piece as it is, or its overlapping windows."""
    if len(piece) <= WIDE:
        return [piece]
    return [piece[k : k + WIDE] for k in range(0, len(piece) - WIDE // 2, WIDE // 2)]


def words_of(text: str) -> list[str]:
    """Lower-case words; line ends are words of their own."""
    return text.lower().replace("\n", f" {_LINE} ").split()


def plain(word: str) -> str:
    """A word without anything but letters and digits: marks between them are insertions that cost nothing."""
    return word if word.isalnum() else _MARKS.sub("", word)


def spelled(words: list[str]) -> list[tuple[int, str]]:
    """(place, piece) of runs of three and more words of one character."""
    out, run, start = [], [], 0
    for k, w in enumerate([*words, ""]):
        own = w if len(w) == 1 else plain(w)
        if len(own) == 1 and own.isalnum():
            start = start if run else k
            run.append(own)
        elif run:
            if len(run) >= RUN:
                out.append((start, "".join(run)))
            run = []
    return out


def pieces_of(text: str) -> set[str]:
    words = words_of(text)
    found = {plain(w) for w in set(words)} | {p for _, p in spelled(words)}
    return {w for p in found for w in windows(p) if len(w) >= ORDER}


def borders(ends: np.ndarray) -> np.ndarray:
    """Starts of sentences, given which words end one; none has more than PIECES words."""
    starts = np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1]) if len(ends) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(ends)))
    parts = -(-sizes // PIECES)
    skip = np.cumsum(parts) - parts
    return np.repeat(starts, parts) + (np.arange(int(parts.sum())) - np.repeat(skip, parts)) * PIECES


# --- fitting ---------------------------------------------------------------------------------


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights and bias (last) of a linear machine with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.eye(len(w))
    keep[-1, -1] = 1e-6
    value = lambda w: 0.5 * w @ keep @ w + (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    for _ in range(rounds):
        margin = 1 - y * (x @ w)
        on = margin > 0
        slope = keep @ w - 2 * x[on].T @ (weight[on] * y[on] * margin[on])
        step = np.linalg.solve(keep + 2 * (x[on] * weight[on, None]).T @ x[on], slope)
        size, now = 1.0, value(w)
        while size > 1e-4 and value(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights and bias (last) of a logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Machine:
    """Landmarks, what each weighs in a piece, the bias of a sentence, and the logistic weights of the worst sentences."""

    landmarks: Landmarks
    weights: np.ndarray
    bias: float
    logistic: np.ndarray
    _held: dict[str, int] = field(default_factory=dict, repr=False)
    _values: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32), repr=False)
    _ends: np.ndarray = field(default_factory=lambda: np.zeros(0, bool), repr=False)
    _single: np.ndarray = field(default_factory=lambda: np.zeros(0, bool), repr=False)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _held={}, _values=np.zeros(0, np.float32), _ends=np.zeros(0, bool), _single=np.zeros(0, bool))

    def of_pieces(self, asked: list[str]) -> np.ndarray:
        """The decision of each piece: of a long one, that of its worst window."""
        parts = [windows(p) for p in asked]
        values = self.landmarks.likeness([w for p in parts for w in p]) @ self.weights
        at = np.cumsum([0, *map(len, parts)])
        return np.maximum.reduceat(values, at[:-1]).astype(np.float32) if asked else np.zeros(0, np.float32)

    def _known(self, words: list[str]) -> np.ndarray:
        """Numbers of words, of which new ones are judged first."""
        held = self._held
        fresh = [w for w in dict.fromkeys(words) if w not in held]
        if fresh:
            own = [plain(w) for w in fresh]
            distinct = {p: k for k, p in enumerate(dict.fromkeys(own))}
            values = self.of_pieces(list(distinct))
            for k, w in enumerate(fresh, len(held)):
                held[w] = k
            self._values = np.concatenate([self._values, values[[distinct[p] for p in own]]])
            self._ends = np.concatenate([self._ends, [w[-1] in ".!?" or w == _LINE for w in fresh]])
            self._single = np.concatenate([self._single, [len(p) == 1 and p.isalnum() for p in own]])
        return np.fromiter(map(held.__getitem__, words), np.int64, len(words))

    def worst(self, texts: list[str]) -> np.ndarray:
        """Decisions of the three worst sentences of each text, the worst first; missing ones count as empty.

        New words of all texts are judged together; texts go by some megabytes at a time.
        """
        out = np.full((len(texts), WORST), self.bias)
        for begin, end in pieces([t.encode() for t in texts], SLICE):
            if len(self._held) > REMEMBERED:
                self.__setstate__(self.__getstate__())
            words = [words_of(t) for t in texts[begin:end]]
            known = self._known([w for own in words for w in own])
            at = np.cumsum([0, *map(len, words)])
            for k, own in enumerate(words):
                if own:
                    some = known[at[k] : at[k + 1]]
                    values = self._values[some].astype(float)
                    if self._single[some].sum() >= RUN and (runs := spelled(own)):
                        np.add.at(values, [j for j, _ in runs], self.of_pieces([p for _, p in runs]))
                    sums = np.add.reduceat(values, borders(self._ends[some])) + self.bias
                    out[begin + k] = three_worst(sums, self.bias)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        x = shown(self.worst(texts))
        return 1 / (1 + np.exp(-np.clip(x @ self.logistic[:-1] + self.logistic[-1], -700, 700)))


def three_worst(decisions: np.ndarray, empty: float) -> np.ndarray:
    if len(decisions) > 64:
        decisions = -np.partition(-decisions, WORST)[:WORST]
    return -np.sort(-np.append(decisions, [empty] * WORST))[:WORST]


def shown(worst: np.ndarray) -> np.ndarray:
    """What the logistic function sees of the worst sentences: each, and how far the first is beyond the border."""
    return np.hstack([worst, np.maximum(worst[:, :1], 0)])


def chosen_landmarks(candidates: list[str], most: int, taken: list[str]) -> list[str]:
    """Of candidates in order, those that are not too like one before."""
    likeness = Landmarks(candidates).likeness(candidates) if candidates else np.zeros((0, 0))
    out: list[int] = []
    for k, piece in enumerate(candidates):
        if len(out) < most and piece not in taken and all(likeness[k, j] < ALIKE for j in out):
            out.append(k)
    return [candidates[k] for k in out]


def _piece_counts(sample: DataFrame) -> DataFrame:
    """(piece, toxic, clean): in how many documents of the sample each piece stands; summed within tasks first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def shown() -> pa.RecordBatch:
            arrays = [pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (1, 0))]
            counts.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["piece", "toxic", "clean"])

        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text")):
                for piece in pieces_of(text.as_py() or ""):
                    counts.setdefault(piece, [0, 0])[label] += 1
                if len(counts) > REMEMBERED:
                    yield shown()
        yield shown()

    found = sample.select("label", "text").mapInArrow(tidy(rows), "piece string, toxic long, clean long")
    return found.groupBy("piece").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _sentence_table(sample: DataFrame, landmarks: Landmarks) -> list[tuple[int, np.ndarray]]:
    """(label, likeness by sentence and landmark) of each document of the sample: at most SENTENCES of a document."""
    shared = sample.sparkSession.sparkContext.broadcast(landmarks)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, held = shared.value, {}
        for batch in batches:
            out, texts = [], [words_of(t.as_py() or "") for t in batch.column("text")]
            fresh = [p for p in {w for words in texts for word in set(words) for w in windows(plain(word))} if p not in held]
            held.update(zip(fresh, marks.likeness(fresh)))
            for words in texts:
                best: list = []
                starts = borders(np.array([w[-1] in ".!?" or w == _LINE for w in words], bool))
                runs = spelled(words)
                for k, (a, b) in enumerate(zip(starts.tolist(), [*starts.tolist()[1:], len(words)])):
                    parts = [held[p] for w in words[a:b] for p in windows(plain(w))]
                    parts += list(marks.likeness([p for at, run in runs if a <= at < b for p in windows(run)])) if runs else []
                    total = np.sum(parts, axis=0)
                    heapq.heappush(best, (float(total.sum()), -k, total))
                    if len(best) > SENTENCES:
                        heapq.heappop(best)
                out.append(np.array([x[2] for x in best], np.float32).tobytes())
            if len(held) > REMEMBERED:
                held.clear()
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.binary())], names=["label", "sentences"])

    found = sample.select("label", "text").mapInArrow(tidy(rows), "label int, sentences binary").collect()  # MOST of a class
    return [(r.label, np.frombuffer(r.sentences, np.float32).reshape(-1, len(landmarks.pieces))) for r in found]


def training_sample(docs: DataFrame, labels: DataFrame, folds: int, most: int) -> tuple[DataFrame, dict[int, int]]:
    """(label, text) of the training documents with the smallest hashes, ``most`` of each class; and the sizes of the classes."""
    label = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("label in (0, 1)").distinct()
    label = label.where(fold(F.col("doc_id"), folds) != 0)
    sizes = {r.label: r.n for r in label.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id")
    some = label.where("label = 1").orderBy(order, "doc_id").limit(most).unionByName(label.where("label = 0").orderBy(order, "doc_id").limit(most))
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("label", "text"), sizes


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, most: int = MOST) -> Machine | Constant:
    """A machine of the labelled documents outside fold 0."""
    sample, sizes = training_sample(docs, labels, folds, most)
    sample = materialise(sample.repartition(docs.sparkSession.sparkContext.defaultParallelism), "toxic-sample")
    seen = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        return Constant(float(next(iter(seen))) if seen else 0.5)
    counts = materialise(_piece_counts(sample), "toxic-pieces")
    share = lambda c, k: (F.col(c) + 0.5) / (seen[k] + 1.0)
    spread = F.sqrt(share("toxic", 1) * (1 - share("toxic", 1)) / seen[1] + share("clean", 0) * (1 - share("clean", 0)) / seen[0])
    telling = counts.where("toxic >= 2").withColumn("z", (share("toxic", 1) - share("clean", 0)) / spread).where(F.col("z") > LEAST_Z)
    candidates = [r.piece for r in telling.orderBy(F.desc("z"), "piece").limit(CANDIDATES).collect()]
    usual = [r.piece for r in counts.orderBy(F.desc("clean"), "piece").limit(CANDIDATES // 4).collect()]
    chosen = chosen_landmarks(candidates, TELLING, [])
    n_telling = len(chosen)
    chosen += chosen_landmarks(usual, COMMON, chosen)
    if not chosen:
        return Constant(sizes[1] / (sizes[0] + sizes[1]))
    landmarks = Landmarks(chosen)
    table = _sentence_table(sample, landmarks)
    # Nyström: sentences as vectors whose products are the kernel's, as far as the landmarks span it.
    values, vectors = np.linalg.eigh(landmarks.likeness(chosen).astype(float))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    bags = [(label, x.astype(float) @ root) for label, x in table if len(x)]
    toxic, clean = [x for label, x in bags if label], np.vstack([np.zeros((1, len(chosen))), *[x for label, x in bags if not label]])
    picked = [int(x[:, :n_telling].sum(axis=1).argmax()) for label, x in table if label and len(x)]
    rate = {k: sizes[k] / seen[k] / min(sizes[j] / seen[j] for j in seen) for k in seen}  # of the classes in the sample
    for _ in range(ROUNDS):
        x = np.vstack([clean, *[bag[k : k + 1] for bag, k in zip(toxic, picked)]])
        y = np.concatenate([-np.ones(len(clean)), np.ones(len(toxic))])
        w = squared_hinge(x, y, np.where(y > 0, COST * rate[1], COST * rate[0]))
        now = [int((bag @ w[:-1]).argmax()) for bag in toxic]
        if now == picked:
            break
        picked = now
    bias = float(w[-1])
    worst = np.array([three_worst(x.astype(float) @ root @ w[:-1] + bias, bias) for _, x in table])
    y = np.array([label for label, _ in table])
    last = logistic(shown(worst), y, np.where(y == 1, rate[1], rate[0]))
    return Machine(landmarks, (root @ w[:-1]).astype(np.float32), bias, last)


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, most: int = MOST, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds, most))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            machine = model.value
            score = machine.scores([t or "" for t in texts]) if isinstance(machine, Machine) else machine.scores(np.zeros((len(texts), 1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.asarray(score, float))], names=["doc_id", "score"])
        release()

    scored = docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, score double")
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
