"""Quality scores: a support vector machine over n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm.sampling import STEPS, bounded
from casework.session import remove, written

#: Labelled rows that the model is fitted on at most, about; the share of them kept for calibration.
FIT_ROWS, CALIBRATION = 16_000, 0.25
#: Texts of each label that calibration needs; where it would have fewer, all texts serve both steps.
LEAST_APART = 8
#: Places that n-grams are hashed to; n-grams in fewer taught texts than LEAST_TEXTS are left out; smoothing of counts.
GRAMS, LEAST_TEXTS, SMOOTH = 1 << 18, 4, 1.0
#: Lengths of the n-grams of bytes, of words and of word shapes.
BYTES, WORDS, SHAPES = (1, 2, 3), (1, 2), (1, 2, 3)
#: Loss weight of a text, of both classes together even, and passes of the solver at most.
COST, PASSES, ENOUGH = 1.0, 30, 1e-3
#: Bytes of a text that are read at once, up to a blank; n-grams do not go across.
BLOCK = 1 << 20
#: Texts whose n-grams a task holds at once.
TEXTS = 512
PARTS = 8

_RNG = np.random.default_rng(13)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = _RNG.integers(1 << 62, size=256).astype(np.uint64)
_PLACE = _RNG.integers(1 << 62, size=256).astype(np.uint64) | np.uint64(1)
_SAME = np.uint64(0x51ED270B)
#: Classes of bytes for shapes: capitals, other letters (bytes of non-ASCII letters too), digits; marks are themselves.
_CLASS = np.arange(256)
_CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("a") : ord("z") + 1], _CLASS[128:] = ord("A"), ord("a"), ord("a")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mixed(hashes: np.ndarray, kind: int) -> np.ndarray:
    """Places of n-grams of one kind; equal n-grams have equal places."""
    hashes = (hashes ^ (hashes >> np.uint64(31)) ^ np.uint64(kind)) * _ODD
    return (hashes >> np.uint64(64 - (GRAMS.bit_length() - 1))).astype(np.int64)


def _grams(tokens: np.ndarray, lengths: tuple[int, ...], kind: int):
    """Places of the n-grams of a sequence of token hashes."""
    total = tokens
    for n in range(1, max(lengths) + 1):
        if n > 1:
            total = total[:-1] * _ODD + tokens[n - 1 :]
        if n in lengths and len(total):
            yield _mixed(total, kind + n)


def _block_grams(data: np.ndarray):
    yield from _grams(_BYTE[data], BYTES, 0)
    blank = _BLANK[data]
    inside = np.flatnonzero(~blank)
    if not len(inside):
        return
    first = np.flatnonzero(np.concatenate([[True], np.diff(inside) > 1]))  # of each word, in ``inside``
    letters = data[inside]
    starts = np.repeat(first, np.diff([*first, len(inside)]))
    place = np.arange(len(inside)) - starts
    words = np.add.reduceat(_BYTE[letters] * _PLACE[place & 255], first)
    yield from _grams(words, WORDS, 16)
    # A shape has one sign for each stretch of bytes of a class.
    classes = _CLASS[letters]
    turn = np.concatenate([[True], classes[1:] != classes[:-1]])
    turn[first] = True
    sign = np.cumsum(turn)
    sign -= sign[starts]
    shapes = np.add.reduceat(np.where(turn, _BYTE[classes] * _PLACE[sign & 255], np.uint64(0)), first)
    # A word that is the one before again has a shape of its own.
    shapes[1:][words[1:] == words[:-1]] = _SAME
    yield from _grams(shapes, SHAPES, 32)


class Reader:
    """Reads texts as the distinct places of their n-grams of bytes, words and word shapes."""

    def __init__(self):
        self.stamp = np.zeros(GRAMS, np.int64)

    def places(self, text: str | None) -> np.ndarray:
        """Of a whole text; null is empty. A-Z and a-z differ; words are parted by blanks and control characters 9 to 13."""
        data = np.frombuffer((text or "").encode(), np.uint8)
        found, at = [], 0
        while at < len(data):
            stop = min(len(data), at + BLOCK)
            if stop < len(data):
                blanks = np.flatnonzero(_BLANK[data[at:stop]])
                stop = at + int(blanks[-1]) + 1 if len(blanks) else stop
            found.append(self.distinct(np.concatenate([*_block_grams(data[at:stop])])))
            at = stop
        if len(found) < 2:
            return found[0] if found else np.zeros(0, np.int64)
        return self.distinct(np.concatenate(found))

    def distinct(self, places: np.ndarray) -> np.ndarray:
        """Each place once: the last one to leave its number there stays."""
        numbers = np.arange(len(places))
        self.stamp[places] = numbers
        return places[self.stamp[places] == numbers]


def log_ratios(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log of how much commoner an n-gram is in texts of label 1 than in those of label 0; 0 for rare ones."""
    p, q = good + SMOOTH, bad + SMOOTH
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    return np.where(good + bad >= LEAST_TEXTS, ratio, 0.0)


def dual_coordinate_descent(
    rows: list[np.ndarray], signs: np.ndarray, ratios: np.ndarray, cost: np.ndarray, seed: int = 13
) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights (times ratios), bias and dual variables of the linear model with least hinge loss.

    ``rows`` are places: a row's vector has its places' ratios, scaled to length 1. ``signs`` are 1 and -1; ``cost``
    bounds each row's dual variable. One variable is solved exactly at a time, in a new order for each pass, until
    no projected gradient of a pass is above ENOUGH or after PASSES passes. The bias is a weight of a constant 1.
    Weights are only ever needed times their ratio, so that is what is kept, and rows need no values.
    """
    rng = np.random.default_rng(seed)
    squares = np.square(ratios)
    weights, bias = np.zeros(len(ratios)), 0.0
    dual = np.zeros(len(rows))
    lengths = np.array([float(squares[at].sum()) for at in rows])
    shrink = np.where(lengths > 0, 1 / np.sqrt(np.where(lengths > 0, lengths, 1.0)), 0.0)
    diagonal = np.where(lengths > 0, 2.0, 1.0)  # the squared length with the constant
    for _ in range(PASSES):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at = rows[i]
            gradient = signs[i] * (float(weights[at].sum()) * shrink[i] + bias) - 1.0
            if (dual[i] <= 0 and gradient >= 0) or (dual[i] >= cost[i] and gradient <= 0):
                continue
            worst = max(worst, abs(gradient))
            new = min(max(dual[i] - gradient / diagonal[i], 0.0), cost[i])
            step = (new - dual[i]) * signs[i]
            weights[at] += step * shrink[i] * squares[at]
            bias += step
            dual[i] = new
        if worst <= ENOUGH:
            break
    return weights, bias, dual


def sigmoid_fit(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (0 or more) and offset of the logistic curve that tells the labels of margins best, by Newton's method.

    Targets are drawn in by the counts of the labels, so that perfect margins give no infinite slope.
    """
    good, bad = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    beta = np.array([0.0, np.log((good + 1) / (bad + 1))])

    def loss(b):
        z = x @ b
        return float((np.logaddexp(0, z) - target * z).sum() + 1e-9 * b @ b)

    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ beta)))
        gradient = x.T @ (p - target) + 2e-9 * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-9
        step = np.linalg.solve(curve, gradient)
        while loss(beta - step) > loss(beta) and np.abs(step).max() > 1e-12:
            step = step / 2
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


class QualityModel:
    """Weights times ratios by place, the bias and the calibrating curve; or one rate for all."""

    def __init__(self, ratios: np.ndarray | None, weights: np.ndarray | None, bias: float, curve: tuple[float, float], rate: float):
        self.squares = None if ratios is None else np.square(ratios)
        self.weights, self.bias, self.curve, self.rate = weights, bias, curve, rate

    def margin(self, places: np.ndarray) -> float:
        length = float(self.squares[places].sum())
        return self.bias + (float(self.weights[places].sum()) / np.sqrt(length) if length > 0 else 0.0)

    def score(self, places: np.ndarray) -> float:
        if self.weights is None:
            return self.rate
        slope, offset = self.curve
        return float(1 / (1 + np.exp(-(slope * self.margin(places) + offset))))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    rows: int = FIT_ROWS,
) -> QualityModel:
    """A model from labelled documents where ``learn`` (over the key) holds.

    At most about ``rows`` labelled documents are read, chosen by a hash of the key; of equal texts with one label
    one teaches. Ratios and weights are learned from 1 - CALIBRATION of the texts, the curve from the others, which no
    other step sees (unless fewer than LEAST_APART of a label would be left to it); equal texts are on one side. A document labelled twice counts as good if one label says so;
    null labels and null keys teach nothing; null texts are empty ones. With one label only, the score is that
    label's rate (0 if there is none) for all. The solver runs in one task, over the bounded rows.
    """
    taught = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & learn)
    taught = taught.groupBy(key).agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    taught = bounded(taught, key, rows)  # so many rows at most, so it can be sent to all
    sample = docs.select(key, F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(taught), key)
    sample = sample.select("text", "label", F.xxhash64("text").alias("digest"), F.length("text").alias("size"))
    later = F.pmod(F.xxhash64("digest", F.lit("calibrate")), F.lit(STEPS)) < int(STEPS * CALIBRATION)

    def read(batches):
        reader = Reader()
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                found = [reader.places(x).astype(np.int32) for x in batch.column(0).to_pylist()]
                columns = [batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.int32()))]
                yield pa.record_batch(columns, names=["label", "later", "places"])

    sample = sample.dropDuplicates(["digest", "size", "label"]).select("text", "label", later.alias("later"))
    sample, path = written(sample.mapInArrow(read, "label int, later boolean, places array<int>").coalesce(PARTS), "grams")
    known = {(r["later"], r["label"]): r["count"] for r in sample.groupBy("later", "label").count().collect()}
    good, bad = (known.get((False, n), 0) for n in (1, 0))
    both = [sum(known.get((side, n), 0) for side in (False, True)) for n in (1, 0)]
    if not all(both):
        return QualityModel(None, None, 0.0, (0.0, 0.0), float(both[0] > 0))
    first, rest = sample.where("not later"), sample.where("later")
    if not good or not bad or min(known.get((True, n), 0) for n in (1, 0)) < LEAST_APART:
        first = rest = sample
        good, bad = both
    counts = first.select(F.explode("places").alias("place"), "label").groupBy("place")
    counts = counts.agg(F.sum("label").alias("good"), F.count("*").alias("all")).collect()  # a row for each place at most
    at = np.array([r["place"] for r in counts], np.int64)
    in_good, in_bad = np.zeros(GRAMS), np.zeros(GRAMS)
    in_good[at] = [r["good"] for r in counts]
    in_bad[at] = [r["all"] - r["good"] for r in counts]
    ratios = log_ratios(in_good, in_bad)

    def solve(table: pa.Table) -> pa.Table:
        places = [x.values.to_numpy() for x in table.column("places")]  # views, no copies
        signs = np.where(table.column("label").to_numpy() > 0, 1.0, -1.0)
        cost = COST * len(signs) / np.where(signs > 0, 2 * good, 2 * bad)
        weights, bias, _ = dual_coordinate_descent(places, signs, ratios, cost)
        return pa.table({"weights": pa.array([weights.tobytes()]), "bias": [bias]})

    row = first.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(solve, "weights binary, bias double").first()
    model = QualityModel(ratios, np.frombuffer(row["weights"]), row["bias"], (0.0, 0.0), 0.0)

    def margins(batches):
        for batch in batches:
            found = [model.margin(x.values.to_numpy()) for x in batch.column(0)]
            yield pa.record_batch([pa.array(found, pa.float64()), batch.column(1)], names=["margin", "label"])

    seen = rest.select("places", "label").mapInArrow(margins, "margin double, label int").collect()
    model.curve = sigmoid_fit(np.array([r["margin"] for r in seen]), np.array([r["label"] for r in seen], float))
    remove(docs.sparkSession, path)
    return model


def quality(docs: DataFrame, model: QualityModel, least: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, predicted`` of every whole text; no row moves. ``predicted`` is 1 where the score is ``least`` or more.

    Null and empty texts have no n-gram and score by the bias alone. Texts of any length are read whole, BLOCK bytes
    at a time. Rows that repeat are scored each; null keys stay; further columns are ignored; an empty table gives
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        reader = Reader()
        for batch in batches:
            scores = [shared.value.score(reader.places(x)) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
