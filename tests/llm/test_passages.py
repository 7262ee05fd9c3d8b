"""Repeated passages against brute force, and the column-wise construction on its own."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from casework.llm import passages
from casework.llm.collection_bwt import columns, suffix_rounds
from odd_tables import no_docs, odd_texts, workers  # noqa: F401  fixtures


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        marks = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                marks[i : i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(x, marks, strict=True) if not m)
        runs = sum(m and (not i or not marks[i - 1]) for i, m in enumerate(marks))
        out.append((len(x), sum(marks), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_rounds_give_suffix_order_and_common_prefixes():
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab", k=rng.randint(1, 12))).encode() for _ in range(60)]
    anchors = np.array([rng.randrange(len(t)) for t in texts])
    groups = np.sort(np.array([rng.randrange(4) for _ in texts]))
    matrix, left = columns(texts, anchors)
    for column, order, shared in suffix_rounds(matrix, groups):
        suffix = [t[max(0, column - left + a) :] if 0 <= column - left + a else b"" for t, a in zip(texts, anchors)]
        there = [0 <= column - left + a < len(t) for t, a in zip(texts, anchors)]
        for k in range(1, len(order)):
            u, v = order[k - 1], order[k]
            if groups[u] != groups[v]:
                assert groups[u] < groups[v] and shared[k] == 0
            elif there[u] and there[v]:
                same = 0
                while same < min(len(suffix[u]), len(suffix[v])) and suffix[u][same] == suffix[v][same]:
                    same += 1
                assert shared[k] == same and suffix[u][: same + 1] <= suffix[v][: same + 1]


@pytest.mark.parametrize("seed, hot", [(1, 4096), (2, 2)])
def test_against_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(passages, "HOT", hot)
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé ñ日", k=rng.randint(1, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    shared = [text(rng.randint(30, 90)) for _ in range(5)]
    docs = []
    for _ in range(100):
        kind = rng.random()
        if kind < 0.3 and docs:
            copy = rng.choice(docs) or ""
            for _ in range(rng.randint(0, 3)):
                at = rng.randint(0, len(copy))
                copy = copy[:at] + rng.choice(["x", "yy", ""]) + copy[at + rng.randint(0, 3) :]
            docs.append(copy)
        elif kind < 0.6:
            docs.append(text(rng.randint(0, 80)) + rng.choice(shared) + text(rng.randint(0, 60)))
        elif kind < 0.7:
            docs.append(rng.choice(words) * rng.randint(1, 200))
        else:
            docs.append(rng.choice([None, "", text(rng.randint(1, 150)), "a" * rng.randint(150, 260)]))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = {r[0]: tuple(r)[1:] for r in passages.digests(passages.repeated_spans(df)).collect()}
    assert [found[i] for i in range(len(docs))] == brute(docs, 200)


def test_long_texts_are_worked_on_in_stretches(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefg ", k=5000)).encode()
    whole = passages.segments(text, 200)
    monkeypatch.setattr(passages, "STRETCH", 700)
    parts = passages.segments(text, 200)
    spread = lambda s: np.repeat(s[2], s[1])  # noqa: E731  the anchor of each string
    assert (spread(whole) == spread(parts)).all() and whole[1].sum() == 4801


def test_odd_rows(spark, odd_texts, no_docs):
    found = passages.repeated_spans(odd_texts)
    assert found.columns == [*[c for c in odd_texts.columns if c != "spans"], "spans"]
    texts = [r["text"] for r in odd_texts.collect()]
    got = sorted(tuple(r)[1:] for r in passages.digests(found).collect())
    assert got == sorted(brute(texts, 200))
    assert passages.without_spans(found).where("text is null").count() == sum(t is None for t in texts)
    assert passages.repeated_spans(no_docs).count() == 0


def test_characters_stay_whole(spark):
    shared = "é日" * 60
    rows = [(1, "x" + shared + "abc"), (2, "yz" + shared)]
    found = passages.without_spans(passages.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {r["doc_id"]: r["text"] for r in found.collect()} == {1: "xabc", 2: "yz"}
