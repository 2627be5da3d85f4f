"""Operator 7: ordinal cumulative-link regression on graded ratings.

Rated documents have ordered grades. One vector of weights over hashed text features gives a score s,
and ordered thresholds t_1 < ... < t_(J-1) give P(grade <= j) = sigmoid(t_(j+1) - s). The expected grade
and the probability of the top grades (the tail) follow; a document is kept if its tail probability
reaches CUTOFF. With quality and toxic labels, the grades are 0: toxic, 1: not toxic and of low
quality, 2: neither.

Features are the distinct words and word starts of a whole text, hashed, and the shape of the text (shares of capitals,
digits, symbols, repeated words and lines, as steps of a scale). The model is fitted on the driver on
at most RATED rated rows, chosen by a hash of the id, with at most FEATURES features together and OF_ONE in each, which
bounds what the driver holds; words in fewer than SEEN of them have no weight.
Its size is fixed by BITS. Scoring runs on all documents.

Defined results: null and empty texts have shape features only; a label row with a null id, a null
quality or a null toxic is not used; of several label rows for an id the lowest grade counts; without
rated documents, or with one grade only, expected grade and tail are null and all documents are kept;
rows with a null id are scored like others; other columns of any name are kept or ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows

BITS, RATED, SEEN = 20, 8000, 8
#: Features of all rated rows that a model is fitted on, at most (64 MB), and of one row.
FEATURES, OF_ONE = 1 << 24, 1 << 18
#: Features that the fit takes at once, so that the driver holds no array of doubles for all of them.
BLOCK = 1 << 20
#: The longest token that a worker remembers the hashes of.
LONGEST = 64
CUTOFF = 0.5
#: How often a shape feature counts; long texts have many word features and few of these.
SHAPE = 8
GRADES = 3
_EDGES = "!?.,;:*#$%&|<>()[]{}\"'-_=+~/\\"
_CAPITALS, _DIGITS = np.arange(65, 91), np.arange(48, 58)
_SYMBOLS = np.array([b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'-"])


def _hashes(token: str) -> tuple[int, ...]:
    """The word, and how it starts: by a stem of four and of five letters."""
    word = token.lower().strip(_EDGES)
    return tuple(zlib.crc32(x.encode()) & (1 << BITS) - 1 for x in (word, *(f"^{word[:n]}" for n in (4, 5) if len(word) > n)))


_remembered = lru_cache(100_000)(_hashes)


def _word(token: str) -> tuple[int, ...]:
    return _remembered(token) if len(token) <= LONGEST else _hashes(token)


def _step(name: str, share: float) -> int:
    """A feature for a share in [0, 1], on a scale finer near 0."""
    return zlib.crc32(f"\0{name}={int(12 * share**0.5)}".encode()) & (1 << BITS) - 1


def features(text: str | None) -> list[int]:
    text = text or ""
    tokens = text.split()
    distinct = set(tokens)
    found = set(chain.from_iterable(map(_word, distinct)))
    data = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n = max(1, int(data.sum()))
    lines = text.split("\n")
    shape = [
        _step("capitals", data[_CAPITALS].sum() / n), _step("digits", data[_DIGITS].sum() / n), _step("symbols", data[_SYMBOLS].sum() / n), _step("new words", len(distinct) / max(1, len(tokens))),
        _step("new lines", len(set(lines)) / len(lines)), _step("most of a line", max(map(len, lines)) / max(1, len(text))), _step("length", len(tokens).bit_length() ** 2 / 1024),
    ]
    return [*found, *shape * SHAPE]


def grades(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)`` from quality and toxic labels."""
    grade = F.when(F.col("toxic") != 0, 0).otherwise(F.when(F.col("quality") != 0, 2).otherwise(1))
    rated = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    return rated.select(F.col("doc_id").alias("doc_id"), grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def rated_features(docs: DataFrame, rated: DataFrame, most: int = RATED, most_features: int = FEATURES, of_one: int = OF_ONE) -> DataFrame:
    """``(grade, doc_id, features)`` of at most ``most`` rated documents, the same ones on each run; an id that
    documents repeat counts once. Of these, rows with more than ``of_one`` features are left out, and so are rows, in
    order of a hash of the id, from where all have more than ``most_features``."""
    sample = rated.select("doc_id", "grade").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most ``most`` rows of two numbers
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    out = pa.schema([("grade", pa.int32()), ("doc_id", pa.int64()), ("features", pa.list_(pa.int32()))])
    found = map_rows(chosen, ["grade", "doc_id", "text"], lambda g, i, t: (g, i, features(t)), "grade int, doc_id long, features array<int>", out)
    # one ordered pass over at most ``most`` rows
    upto = F.sum(F.size("features")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return found.where(F.size("features") <= of_one).withColumn("upto", upto).where(F.col("upto") <= most_features).drop("upto")


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, found: list[int]) -> np.ndarray:
        """P(grade >= 1), ..., P(grade >= J - 1)."""
        return 1 / (1 + np.exp(self.thresholds - float(self.weights[found].sum(dtype=np.float64))))


def _blocks(counts: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Slices of documents, and of their features, with at most BLOCK features or one document in each."""
    ends = np.cumsum(counts)
    a, low = 0, 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        yield slice(a, b), slice(low, int(ends[b - 1]))
        a, low = b, int(ends[b - 1])


def objective(theta: np.ndarray, y: np.ndarray, place: np.ndarray, counts: np.ndarray, each: np.ndarray, decay: float, n_grades: int) -> tuple[float, np.ndarray]:
    """The weighted negative log-likelihood of grades ``y``, with a penalty on weights, and its gradient.
    ``theta``: a weight for each feature, the first threshold, and the logarithms of the gaps to the next ones;
    ``place`` holds the features of all documents, ``counts`` of them in each."""
    n = len(theta) - n_grades + 1
    row = np.arange(len(y))
    w, low, gaps = theta[:n], theta[n], np.exp(theta[n + 1 :])
    cuts = low + np.concatenate([[0], np.cumsum(gaps)])
    s = np.empty(len(y))
    for docs, part in _blocks(counts):
        sums, ends = np.concatenate([[0.0], np.cumsum(w[place[part]])]), np.cumsum(counts[docs])
        s[docs] = sums[ends] - sums[ends - counts[docs]]
    upto = 1 / (1 + np.exp(np.clip(s[:, None] - cuts, -40, 40)))
    wide = np.hstack([np.zeros((len(y), 1)), upto, np.ones((len(y), 1))])
    slope = np.hstack([np.zeros((len(y), 1)), upto * (1 - upto), np.zeros((len(y), 1))])
    p = np.maximum(wide[row, y + 1] - wide[row, y], 1e-9)
    up, down = slope[row, y + 1] / p * each, slope[row, y] / p * each
    by_cut = (np.bincount(y, down, n_grades + 1) - np.bincount(y + 1, up, n_grades + 1))[1:-1]
    by_word = np.zeros(n)
    for docs, part in _blocks(counts):
        by_word += np.bincount(place[part], np.repeat((up - down)[docs], counts[docs]), n)
    grad = np.concatenate([by_word + decay * w, [by_cut.sum()], [by_cut[j + 1 :].sum() * gaps[j] for j in range(n_grades - 2)]])
    return float(-(each * np.log(p)).sum() + decay / 2 * (w * w).sum()), grad


def fit(grade: np.ndarray, counts: np.ndarray, found: np.ndarray, n_grades: int = GRADES, rounds: int = 250, decay: float = 1e-3, seen: int = SEEN) -> Model | None:
    """Full-batch Adam on the log-likelihood, rare grades weighing more. ``counts`` says how many of the
    features ``found`` belong to each document."""
    y = grade.astype(np.int64)
    if len(set(y.tolist())) < 2:
        return None
    tally = np.zeros(1 << BITS, np.int64)
    for _, part in _blocks(counts):
        tally += np.bincount(found[part], minlength=1 << BITS)
    own = np.flatnonzero(tally >= seen)
    number = np.full(1 << BITS, -1, np.int32)
    number[own] = np.arange(len(own), dtype=np.int32)
    places, left = [np.zeros(0, np.int32)], np.zeros(len(y), np.int64)
    for docs, part in _blocks(counts):
        own_place = number[found[part]]
        of = np.repeat(np.arange(docs.stop - docs.start, dtype=np.int32), counts[docs])
        left[docs] = np.bincount(of[own_place >= 0], minlength=docs.stop - docs.start)
        places.append(own_place[own_place >= 0])
    place, counts = np.concatenate(places), left
    del places, number, tally
    share = np.sqrt(len(y) / (n_grades * np.maximum(1, np.bincount(y, minlength=n_grades))))
    each = share[y] / share[y].sum()
    theta = np.concatenate([np.zeros(len(own)), [-0.5], np.zeros(n_grades - 2)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        _, grad = objective(theta, y, place, counts, each, decay, n_grades)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[own] = theta[: len(own)]
    return Model(weights, theta[len(own)] + np.concatenate([[0], np.cumsum(np.exp(theta[len(own) + 1 :]))]))


def train(docs: DataFrame, rated: DataFrame, most: int = RATED, n_grades: int = GRADES) -> Model | None:
    """A model of at most ``most`` rated documents, which come to the driver as features."""
    rows = rated_features(docs, rated, most).toArrow().combine_chunks()
    rows = rows.sort_by("doc_id").combine_chunks()
    if not rows.num_rows:
        return None
    lists = rows["features"].combine_chunks()
    counts = np.diff(lists.offsets.to_numpy())
    found = lists.flatten().to_numpy()
    model = fit(rows["grade"].to_numpy(), counts, found, n_grades)
    del rows, lists, counts, found
    pa.default_memory_pool().release_unused()  # else Arrow keeps what the features took
    return model


def score(docs: DataFrame, model: Model | None, cutoff: float = CUTOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, expected_grade, tail_probability, keep)`` for every row."""
    if model is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # of fixed size

    def row(i: int, text: str | None) -> tuple:
        tails = Model(*shared.value).tails(features(text))
        return i, float(tails.sum()), float(tails[-1]), bool(tails[-1] >= cutoff)

    out = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("keep", pa.bool_())])
    return map_rows(docs, [id_col, text_col], row, "doc_id long, expected_grade double, tail_probability double, keep boolean", out)


def kept(docs: DataFrame, model: Model | None, cutoff: float = CUTOFF, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose tail probability reaches the cutoff."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield part.filter(pa.array([bool(own.tails(features(t))[-1] >= cutoff) for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
