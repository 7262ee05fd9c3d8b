"""Quality scores: features, solver and curve against plain forms, held-out accuracy, odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casework.llm import quality as module
from casework.llm.quality import Reader, dual_coordinate_descent, fit, log_ratios, quality, sigmoid_fit
from casework.llm.queries import QUERIES
from casework.llm.sampling import remainder
from conftest import SMALL
from odd_tables import no_docs, odd_texts, workers  # noqa: F401  fixtures


def plain_grams(text):
    """The n-grams of a text, told apart by what they stand for and not by a hash."""
    data = text.encode()
    out = {("byte", data[i : i + n]) for n in (1, 2, 3) for i in range(len(data) - n + 1)}
    words = data.split()
    kind = lambda b: "A" if 65 <= b <= 90 else "a" if 97 <= b <= 122 or b > 127 else "0" if 48 <= b <= 57 else chr(b)
    shapes = []
    for i, w in enumerate(words):
        signs = [kind(b) for b in w]
        shapes.append("same" if i and w == words[i - 1] else "".join(s for j, s in enumerate(signs) if not j or s != signs[j - 1]))
    out |= {("word", tuple(words[i : i + n])) for n in (1, 2) for i in range(len(words) - n + 1)}
    return out | {("shape", tuple(shapes[i : i + n])) for n in (1, 2, 3) for i in range(len(shapes) - n + 1)}


def test_places_are_those_of_the_n_grams(monkeypatch):
    rng = random.Random(1)
    texts = ["", " \t", "a", "Ab cd  Ab Ab\nAb!! 12x é É日 \U0001f600"]
    texts += ["".join(rng.choices("abAB1! \n\té|", k=rng.randint(1, 200))) for _ in range(200)]
    reader, place_of = Reader(), {}
    for text in texts:
        found = reader.places(text)
        assert len(set(found.tolist())) == len(found)
        # hashes meet now and then, so there are nearly as many places as n-grams, never more
        grams = plain_grams(text)
        assert len(grams) * 0.99 - 2 <= len(found) <= len(grams)
        place_of[text] = set(found.tolist())
    # equal n-grams have equal places wherever they stand
    assert place_of["a"] <= place_of["Ab cd  Ab Ab\nAb!! 12x é É日 \U0001f600"] | set(reader.places("a b").tolist())
    assert set(reader.places("xx yy zz").tolist()) - set(reader.places("q xx yy zz").tolist()) == set()
    monkeypatch.setattr(module, "BLOCK", 64)
    long = "one two three " * 100
    parts = [long[i : i + 64] for i in range(0, 14)]
    assert set(reader.places(long).tolist()) <= set().union(*(reader.places(p).tolist() for p in [*parts, long[:128]])) | set(reader.places(long[:700]).tolist())
    assert len(reader.places("x" * 1000)) > 0


def test_ratios():
    good, bad = np.array([8.0, 0, 1, 3]), np.array([0.0, 8, 1, 3])
    expected = np.log((good + 1) / 16) - np.log((bad + 1) / 16)
    assert log_ratios(good, bad).tolist() == np.where(good + bad >= 4, expected, 0).tolist()


def test_solver_finds_the_least_loss(monkeypatch):
    monkeypatch.setattr(module, "PASSES", 5000)
    rng = np.random.default_rng(5)
    ratios = np.append(rng.normal(size=12), 0.0)
    has = rng.random((60, 13)) < 0.4
    has[0] = False  # a row without n-grams has the bias only
    x = has * ratios
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    signs = np.where(x[:, 0] + rng.normal(size=60) * 0.3 > 0.1, 1.0, -1.0)
    cost = np.where(signs > 0, 0.5, 0.8)
    scaled, bias, dual = dual_coordinate_descent([np.flatnonzero(h) for h in has], signs, ratios, cost)
    assert (dual >= 0).all() and (dual <= cost).all()
    weights = (dual * signs) @ x
    assert np.allclose(scaled, weights * ratios) and np.isclose(bias, dual @ signs)
    # without a gap between the primal and the dual value both are at their best
    loss = np.maximum(0, 1 - signs * (x @ weights + bias))
    norm = weights @ weights + bias * bias
    assert abs((norm / 2 + cost @ loss) - (dual.sum() - norm / 2)) < 1e-2


def test_curve():
    rng = np.random.default_rng(6)
    margin = rng.normal(size=4000) * 2
    label = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * margin - 0.5)))).astype(float)
    slope, offset = sigmoid_fit(margin, label)
    assert abs(slope - 1.5) < 0.15 and abs(offset + 0.5) < 0.15
    slope, offset = sigmoid_fit(np.array([-2.0, -1, 1, 2]), np.array([0.0, 0, 1, 1]))
    assert 0 < slope < 10
    assert sigmoid_fit(np.array([1.0, 1.0, -1.0]), np.array([0.0, 0.0, 1.0]))[0] == 0.0


def test_quality_of_held_out_documents(spark):
    larger = SMALL.replace("sf0.001", "sf0.01")  # the smallest table has 8 texts of label 0
    labels = spark.read.parquet(f"{larger}/labels.parquet").where("quality is not null")
    found = QUERIES["op13_quality"](spark, larger)
    rows = found.join(labels, "doc_id").where("held_out").collect()
    right = sum((r["score"] >= 0.3) == r["quality"] for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.95
    assert found.where("score < 0 or score > 1 or score is null or predicted != cast(score >= 0.3 as int)").count() == 0


def test_marked_words_and_odd_texts(spark, odd_texts, no_docs):
    rng = random.Random(3)
    words = ["sun", "river", "stone", "walk", "green", "letter", "table", "night"]
    rows = []
    for i in range(300):
        text = [rng.choice(words) for _ in range(30)]
        if i % 4 == 0:
            text[5:15] = [w + rng.choice(["!!", "##"]) for w in text[5:15]]
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame([*rows, (None, "x"), (7, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(None, 0), (1, None)], "doc_id long, quality int")
    held_out = remainder("doc_id", 5) == 0
    model = fit(docs, marks, ~held_out)
    scored = quality(docs, model).join(marks, "doc_id").where(held_out & F.col("quality").isNotNull() & (F.col("doc_id") != 7))
    rows = scored.collect()
    wrong = [(r["doc_id"], r["score"]) for r in rows if r["predicted"] != r["quality"]]
    assert len(rows) > 30 and not wrong
    odd = quality(odd_texts, model)
    assert odd.columns == ["doc_id", "score", "predicted"] and odd.count() == odd_texts.count()
    assert odd.where("score is null or score < 0 or score > 1").count() == 0 and quality(no_docs, model).count() == 0
    for one in (marks.where("quality = 1"), marks.limit(0)):
        same = fit(docs, one, F.lit(True))
        assert {r["score"] for r in quality(docs, same).collect()} == {1.0 if one.count() else 0.0}


@pytest.mark.parametrize("labels", [[1, 0], [1, 1, 0]])
def test_a_few_labels_are_enough(spark, labels):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3)], "doc_id long, text string")
    marks = spark.createDataFrame([*enumerate(labels)], "doc_id long, quality int")
    scores = [r["score"] for r in quality(docs, fit(docs, marks, F.lit(True))).collect()]
    assert len(scores) == 3 and all(0 <= s <= 1 for s in scores)
