"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics are taken from whole texts in one scan. Class means and covariances come from moment sums
over all labelled training rows (no sample): each partition gives one small block of sums. The
covariances shrink towards their pooled form and towards a sphere; scores are differences of
Mahalanobis log densities, with the Cholesky factors computed once and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narae.llm.shared import materialise, small_batches, tidy

FEATURES = (
    "log_words", "log_word_length", "word_length_spread", "letters", "upper", "digits", "stops", "marks", "symbols",
    "beyond_ascii", "distinct", "commonest", "repeated_pairs", "lines", "repeated_lines", "symbol_words",
)
#: Weight of the pooled covariance in a class's, and of the sphere in the result.
POOLED, SPHERE = 0.2, 0.05
#: Standardised statistics are cut here, so that no single one decides alone.
WIDEST = 6.0
#: Words at which a text's statistics count half their square: few words say little, whatever they are.
FEW_WORDS = 100.0
THRESHOLD = 0.3
FOLDS = 5

_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_UPPER, _DIGITS, _STOPS = bytes(range(65, 91)), bytes(range(48, 58)), b".,;:'\"()-"
_MARKS = b"!?"
_WHITE = b" \t\n\r\x0b\x0c"
_BEYOND = bytes(range(128, 256))
_SYMBOLS = bytes(b for b in range(33, 127) if b not in _LETTERS + _DIGITS + _STOPS + _MARKS)


def _ratio(part: float, whole: float) -> float:
    """A share on a root scale, which spreads small values."""
    return (part / whole) ** 0.5 if whole else 0.0


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one text, in the order of FEATURES. An empty text has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    count = lambda of: size - len(text.translate(None, of))
    solid = size - count(_WHITE)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x]
    pairs = len(set(zip(words, words[1:])))
    symbol_words = sum(w[-1] in _SYMBOLS or w[-1] in _MARKS for w in words)
    return [
        float(np.log1p(n)),
        float(np.log(lengths.mean())),
        float(np.log1p(lengths.std())),
        _ratio(count(_LETTERS), solid),
        _ratio(count(_UPPER), solid),
        _ratio(count(_DIGITS), solid),
        _ratio(count(_STOPS), solid),
        _ratio(count(_MARKS), solid),
        _ratio(count(_SYMBOLS), solid),
        _ratio(count(_BEYOND), solid),
        float(np.log(len(tally)) / np.log(n + 1.0)),
        _ratio(max(tally.values()), n),
        _ratio(n - 1 - pairs, n),
        float(np.log1p(len(lines)) / np.log1p(n)),
        _ratio(len(lines) - len(set(lines)), len(lines)),
        _ratio(symbol_words, n),
    ]


def document_statistics(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and ``stats`` (array of doubles) of each row. A null text counts as empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.names.index("_text")
            stats = [statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(k)]
            keep = [i for i in range(batch.num_columns) if i != k]
            arrays = [batch.column(i) for i in keep] + [pa.array(stats, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[i] for i in keep] + ["stats"])

    small_batches(docs.sparkSession)
    source = docs.select(*[F.col(f"`{c}`") for c in columns], F.encode("text", "UTF-8").alias("_text"))
    schema = source.drop("_text").schema.add("stats", T.ArrayType(T.DoubleType()))
    return source.mapInArrow(tidy(rows), schema)


def standardised(stats: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Statistics in spreads from the centre, cut, and drawn to the centre where words are few."""
    words = np.expm1(stats[:, :1])
    return np.clip((stats - centre) / scale, -WIDEST, WIDEST) * np.sqrt(words / (words + FEW_WORDS))


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians: means, Cholesky factors of their covariances, log determinants, log prior odds."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    log_dets: tuple[float, float]
    log_odds: float

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        x = standardised(stats, self.centre, self.scale)
        density = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets):
            z = np.linalg.solve(factor, (x - mean).T)
            density.append(-0.5 * np.sum(z * z, axis=0) - log_det)
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1] - self.log_odds, -700, 700)))


@dataclass(frozen=True)
class Constant:
    """Where only one class, or none, was seen in training."""

    value: float

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.full(len(stats), self.value)


def fold(ident: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``; null stays null."""
    return F.crc32(ident.cast("string").cast("binary")) % folds


def _moments(stats: DataFrame, centre: np.ndarray | None = None, scale: np.ndarray | None = None) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products by class; of standardised statistics if a centre is given."""
    d = len(FEATURES)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: np.zeros((d + 1, d + 1)) for c in (0, 1)}
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).flatten()).reshape(-1, d)
            if centre is not None:
                x = standardised(x, centre, scale)
            x = np.hstack([np.ones((len(x), 1)), x])
            for c in (0, 1):
                part = x[label == c]
                sums[c] += part.T @ part
        i, j = np.triu_indices(d + 1)
        out = [pa.array(np.repeat([0, 1], len(i)), pa.int32()), pa.array(np.tile(i, 2), pa.int32()), pa.array(np.tile(j, 2), pa.int32()), pa.array(np.concatenate([sums[0][i, j], sums[1][i, j]]))]
        yield pa.RecordBatch.from_arrays(out, names=["label", "i", "j", "value"])

    table = stats.select("label", "stats").mapInArrow(tidy(rows), "label int, i int, j int, value double")
    out = {c: np.zeros((d + 1, d + 1)) for c in (0, 1)}
    for r in table.groupBy("label", "i", "j").agg(F.sum("value").alias("value")).collect():  # 2 * 153 rows
        out[r.label][r.i, r.j] = out[r.label][r.j, r.i] = r.value
    return {c: (m[0, 0], m[0, 1:], m[1:, 1:]) for c, m in out.items()}


def fit(training: DataFrame, pooled: float = POOLED, sphere: float = SPHERE) -> Discriminant | Constant:
    """Fits (label, stats) rows. Labels other than 0 and 1 are left out before."""
    raw = _moments(training)
    n = raw[0][0] + raw[1][0]
    if not raw[0][0] or not raw[1][0]:
        return Constant(0.5 if not n else 1.0 if raw[1][0] else 0.0)
    # Centred at class 1, the larger and tighter one: what is usual there has little spread.
    n1, s1, q1 = raw[1]
    centre = s1 / n1
    scale = np.sqrt(np.maximum(np.diag(q1) / n1 - centre**2, 1e-4))
    moments = _moments(training, centre, scale)
    means = tuple(moments[c][1] / moments[c][0] for c in (0, 1))
    own = [moments[c][2] / moments[c][0] - np.outer(means[c], means[c]) for c in (0, 1)]
    both = (moments[0][0] * own[0] + moments[1][0] * own[1]) / n
    factors = []
    for cov in own:
        cov = (1 - pooled) * cov + pooled * both
        cov = (1 - sphere) * cov + sphere * np.trace(cov) / len(cov) * np.eye(len(cov))
        factors.append(np.linalg.cholesky(cov + 1e-9 * np.eye(len(cov))))
    log_dets = tuple(float(np.log(np.diag(f)).sum()) for f in factors)
    return Discriminant(centre, scale, means, tuple(factors), log_dets, float(np.log(moments[1][0] / moments[0][0])))


def _scored(stats: DataFrame, model: Discriminant | Constant) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            k = names.index("stats")
            x = np.array(batch.column(k).flatten()).reshape(-1, len(FEATURES))
            arrays = [batch.column(i) for i in range(len(names)) if i != k]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(shared.value.scores(x))], names=[c for c in names if c != "stats"] + ["score"])

    return stats.mapInArrow(tidy(rows), stats.drop("stats").schema.add("score", "double"))


def _training(stats: DataFrame, labels: DataFrame, folds: int) -> DataFrame:
    label = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label in (0, 1)").distinct()
    return stats.where(fold(F.col("doc_id"), folds) != 0).select("doc_id", "stats").join(label, "doc_id").select("label", "stats")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document.

    Learns from the labelled documents outside fold 0. Null and empty texts have all statistics 0 and
    are scored as any other. A null doc_id has no label and is not held out. Repeated labels count
    once, contradicting ones once each; null labels are left out. Without labels of both classes the
    score is that of the one class seen, or 0.5.
    """
    stats = materialise(document_statistics(docs, ["doc_id"]), "quality-stats")
    scored = _scored(stats, fit(materialise(_training(stats, labels, folds), "quality-train")))
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, unchanged; the text is scanned twice."""
    stats = materialise(document_statistics(docs, ["doc_id"]), "quality-stats")
    model = docs.sparkSession.sparkContext.broadcast(fit(materialise(_training(stats, labels, folds), "quality-train")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text"))
            x = np.array([statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.value.scores(x) >= threshold))

    return docs.mapInArrow(tidy(rows), docs.schema)
