"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
from xxhash import xxh64_intdigest

from casework.llm.sampling import STEPS, bounded
from casework.session import written

#: Labelled rows that the model is fitted on at most, about; the share of them kept for calibration.
FIT_ROWS, CALIBRATION = 20_000, 0.3
#: Entries of the learned lexicon, and labelled toxic texts that an entry has to be in.
LEXICON, LEAST_TEXTS, LEAST_RATIO = 300, 5, 25.0
#: Least shingle hashes that texts have to share, all of them, to count as one text for the lexicon: near copies do,
#: texts with one passage in common hardly ever.
SIGNS = 4
#: Letters of the word beginnings that the lexicon may hold next to whole words.
STEMS = (4, 5, 6)
#: Words between a lexicon word and a second person that count as near.
NEAR = 5
#: Counts held before they are passed on, and words remembered, at most.
HELD = 200_000
#: Letters of a longer word are left to the other features; it is looked up by its beginning alone.
LONGEST = 40
PARTS = 8

# Second persons of the languages that are told apart.
SECOND_PERSON = frozenset(
    "you your yours yourself u du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous "
    "votre vos tú ti tus usted ustedes vosotros vuestro".split()
)
# Characters that stand in for letters.
STAND_INS = str.maketrans("013457@$!|", "oleastasil")

_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_][\d@$!|*][\w@$!|*]*[^\W\d_]")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_]){3,}[^\W\d_](?!\w)")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_MARKS = re.compile(r"[!?]{2,}")

FEATURES = (
    "hit_density", "weight_density", "top_weight", "hits", "distinct", "near_second_person", "second_distance",
    "second_density", "capitals", "capital_words", "exclamations", "questions", "marks", "mark_runs",
    "masked", "masked_hits", "spaced", "repeated", "log_words",
)


def entries(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself, and its beginnings."""
    found = [word] if len(word) <= LONGEST else []
    return found + [f"{word[:n]}*" for n in STEMS if len(word) > n]


def features(text: str | None, weigh) -> list[float]:
    """The dense features of a whole text; null is empty. ``weigh(word)`` is a word's lexicon weight."""
    text = text or ""
    lower = text.lower()
    words = _WORD.findall(lower)
    n, size = max(1, len(words)), max(1, len(text))
    weights = [*map(weigh, words)]
    hits = [i for i, w in enumerate(weights) if w]
    second = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
    near, closest = 0, float(n)
    if hits and len(second):
        at = np.array(hits)
        place = np.searchsorted(second, at)
        before = np.abs(at - second[np.maximum(place - 1, 0)])
        after = np.abs(at - second[np.minimum(place, len(second) - 1)])
        gap = np.minimum(before, after)
        near, closest = int((gap <= NEAR).sum()), float(gap.min())
    letters = max(1, sum(map(len, words)))
    masked = _MASKED.findall(lower)
    spaced = _SPACED.findall(lower)
    unmasked = sum(bool(weigh(w.translate(STAND_INS))) for w in masked)
    unmasked += sum(bool(weigh(re.sub(r"[ .\-_]", "", w))) for w in spaced)
    marks = sum(map(text.count, ".,;:!?\"'()"))
    return [
        len(hits) / n, sum(weights) / n, max(weights, default=0.0), float(len(hits)),
        float(len({words[i] for i in hits})), near / n, 1.0 / (1.0 + closest) if hits else 0.0, len(second) / n,
        sum(map(str.isupper, text)) / letters, sum(w.isupper() for w in _WORD.findall(text) if len(w) > 1) / n,
        text.count("!") / size, text.count("?") / size, marks / size, len(_MARKS.findall(text)) / n,
        len(masked) / n, float(unmasked), len(spaced) / n, len(_REPEATED.findall(lower)) / n, float(np.log1p(n)),
    ]


def _count_entries(batches):
    """Weights of the labelled texts that hold each entry, by label, passed on whenever many are held."""
    held: dict[bool, Counter] = {True: Counter(), False: Counter()}

    def passed():
        names = [*(held[True].keys() | held[False].keys())]
        columns = [pa.array(names, pa.string())]
        columns += [pa.array([held[k][w] for w in names], pa.float64()) for k in (True, False)]
        return pa.record_batch(columns, names=["entry", "toxic", "clean"])

    for batch in batches:
        for text, label, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = set(_WORD.findall((text or "").lower()))
            counts = held[label == 1]
            for entry in {e for w in words for e in entries(w)}:
                counts[entry] += weight
            if len(held[True]) + len(held[False]) >= HELD:
                yield passed()
                held[True].clear()
                held[False].clear()
    yield passed()


def _signed(batches):
    """Key, label, hash of all words, and signature of labelled texts: the SIGNS least hashes of three-word shingles."""
    for batch in batches:
        whole, signs = [], []
        for text in batch.column(1).to_pylist():
            words = (text or "").encode().lower().split()
            shingles = {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
            least = nsmallest(SIGNS, map(xxh64_intdigest, shingles))
            whole.append(xxh64_intdigest(b" ".join(words)) >> 1)
            signs.append(xxh64_intdigest(str(least)) >> 1)
        columns = [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(whole, pa.int64()), pa.array(signs, pa.int64())]
        yield pa.record_batch(columns, names=["id", "label", "whole", "signature"])


def lexicon(labelled: DataFrame, toxic: float, clean: float) -> dict[str, float]:
    """From ``text, label, weight``: the LEXICON entries that tell toxic texts best, with the log of how much commoner they are there.

    Ordered by the likelihood ratio of their counts, of which LEAST_RATIO is more than chance gives.
    """
    found = labelled.select("text", "label", "weight").mapInArrow(_count_entries, "entry string, toxic double, clean double")
    found = found.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    texts, share = F.col("toxic") + F.col("clean"), toxic / (toxic + clean)

    def part(count, expected):
        return F.when(count > 0, count * F.log(count / expected)).otherwise(0.0)

    ratio = 2 * (part(F.col("toxic"), texts * share) + part(F.col("clean"), texts * (1 - share)))
    best = found.where(F.col("toxic") >= LEAST_TEXTS).withColumns({"weight": odds, "ratio": ratio})
    best = best.where((F.col("weight") > 1) & (F.col("ratio") >= LEAST_RATIO))
    rows = best.orderBy(F.desc("ratio"), "entry").limit(LEXICON).select("entry", "weight").collect()
    return {row["entry"]: row["weight"] for row in rows}


def _with_features(rows: DataFrame, known: dict[str, float]) -> DataFrame:
    """``rows`` with their text replaced by the dense features; no row moves."""
    at = rows.columns.index("text")

    def run(batches):
        memory: dict[str, float] = {}

        def weigh(word):
            weight = memory.get(word)
            if weight is None:
                if len(memory) >= HELD:
                    memory.clear()
                weight = memory[word] = max((known.get(e, 0.0) for e in entries(word)), default=0.0)
            return weight

        for batch in batches:
            dense = pa.array([features(x, weigh) for x in batch.column(at).to_pylist()], pa.list_(pa.float64()))
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.record_batch([*columns, dense], names=[*names, "dense"])

    schema = rows.drop("text").schema.add("dense", ArrayType(DoubleType()))
    return rows.mapInArrow(run, schema).withColumn("features", array_to_vector("dense")).drop("dense")


class ToxicityModel:
    """A lexicon, boosted trees over the features it gives, and their calibration; or one rate for all."""

    def __init__(self, known: dict[str, float], trees: GBTClassificationModel | None, calibration, rate: float):
        self.known, self.trees, self.calibration, self.rate = known, trees, calibration, rate

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their text replaced by ``score``, 0 to 1."""
        if self.trees is None:
            return rows.drop("text").withColumn("score", F.lit(self.rate))
        dense = _with_features(rows, self.known)
        margin = self.trees.transform(dense).withColumn("margin", vector_to_array("rawPrediction")[1])
        margin = margin.drop("features", "rawPrediction", "probability", "prediction")
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
        return self.calibration.transform(margin).withColumn("score", score).drop("margin", "prediction")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows: int = FIT_ROWS,
    trees: int = 20,
    depth: int = 4,
    seed: int = 7,
) -> ToxicityModel:
    """A model from labelled documents where ``learn`` (over the key) holds.

    At most about ``rows`` labelled documents are read, chosen by a hash of the key. Of those that are equal word for
    word one teaches, the one with the smallest key, a toxic one if there is one. All others teach; in the counts of
    the lexicon near copies of one label (SIGNS) weigh as one text together. Lexicon and trees see 1 - CALIBRATION of
    the texts, the calibration the rest, near copies on one side. A document labelled twice is toxic if one label
    says so; null labels and null keys teach nothing; null and empty texts are texts without words; long texts are
    read whole. With one label only, the score is that label's rate (0 if there is none) for all.
    """
    taught = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & learn)
    taught = taught.groupBy(key).agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    taught = bounded(taught, key, rows)  # so many rows at most, so it can be sent to all
    docs = docs.select(key, F.col(text).alias("text"))
    # Copies teach once, or all words of a text that is copied often would look toxic.
    marked = docs.join(F.broadcast(taught), key).mapInArrow(_signed, "id long, label int, whole long, signature long")
    one = F.max_by(F.struct("id", "label", "signature"), F.struct("label", -F.col("id"))).alias("one")
    taught = marked.groupBy("whole").agg(one).select(F.col("one.id").alias(key), "one.label", "one.signature")
    alike = Window.partitionBy("signature", "label")  # of so many rows at most
    part = F.pmod(F.xxhash64("signature", F.lit("calibrate")), F.lit(STEPS)) < int(STEPS * CALIBRATION)
    taught = taught.withColumns({"weight": 1.0 / F.count("*").over(alike), "later": part}).drop("signature")
    # A key that has several texts teaches with one of them, or with its label for each.
    taught, _ = written(taught.dropDuplicates([key]).coalesce(PARTS), "taught")
    sample = docs.join(F.broadcast(taught), key)  # no more rows than before
    count = {(later, label): (n, total) for later, label, n, total in taught.groupBy("later", "label").agg(F.count("*"), F.sum("weight")).collect()}
    sums = {label: [count.get((side, label), (0, 0.0)) for side in (False, True)] for label in (1, 0)}
    if any(not first[0] + later[0] for first, later in sums.values()):
        return ToxicityModel({}, None, None, float(bool(sums[1][0][0] + sums[1][1][0])))
    if any(not first[0] for first, _ in sums.values()) or not sum(later[0] for _, later in sums.values()):
        sample = sample.withColumn("later", F.lit(False))  # too few to keep some apart
        toxic, clean = (sums[n][0][1] + sums[n][1][1] for n in (1, 0))
    else:
        toxic, clean = (sums[n][0][1] for n in (1, 0))
    known = lexicon(sample.where("not later"), toxic, clean)
    dense = _with_features(sample.drop("weight"), known)
    dense, _ = written(dense.select("features", F.col("label").cast("double"), "later").coalesce(PARTS), "features")
    booster = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed
    )
    first, later = dense.where("not later"), dense.where("later")
    later = first if later.isEmpty() else later
    model = booster.fit(first)
    margin = model.transform(later).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
    curve = IsotonicRegression(featuresCol="margin", labelCol="label").fit(margin)
    return ToxicityModel(known, model, curve, 0.0)


def toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, predicted`` of every whole text.

    Null and empty texts have features of no word and get a score like any other. Rows that repeat are
    scored each; null keys stay; further columns are ignored; an empty table gives no rows.
    """
    scored = model.score(docs.select(key, F.col(text).alias("text")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
