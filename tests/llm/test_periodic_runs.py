"""Periodic runs against brute force, on long and odd texts, and the query's digests."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from casework.llm import periodic_runs as module
from casework.llm.periodic_runs import periodic_runs, repair, runs_of
from casework.llm.queries import QUERIES
from conftest import SMALL
from odd_tables import no_docs, odd_texts, workers  # noqa: F401  fixtures


def brute(words, times=4, least=6):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            root = words[i : i + q]
            shorter = any(q % p == 0 and root == root[:p] * (q // p) for p in range(1, q))
            if j > i and length >= max(least, times * q) and not shorter:
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_text(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 5, 50])) for _ in range(rng.choice([0, 1, 5, 6, 7, 20, 60, 200]))]
    for _ in range(rng.randint(0, 3)):
        if len(words) > 4:
            a, p = rng.randrange(len(words)), rng.randint(1, max(1, len(words) // 5))
            for i in range(a + p, min(len(words), a + p * rng.randint(2, 9) + rng.randint(0, p))):
                words[i] = words[i - p]
    return words


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        texts = [random_text(rng) for _ in range(rng.randint(1, 5))]
        words = np.array([w + 60 * i for i, t in enumerate(texts) for w in t], np.int64)
        owner = np.array([i for i, t in enumerate(texts) for _ in t], np.int64)
        starts = np.cumsum([0, *map(len, texts)])
        expected = [(a + s, n, q) for t, s in zip(texts, starts, strict=False) for a, n, q in brute(t)]
        assert [tuple(r) for r in runs_of(words, owner).tolist()] == sorted(expected, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("times, least", [(5, 1), (4, 40)])
def test_other_limits(times, least):
    words = random.Random(3).choices([0, 1], k=300) + [0, 1, 1] * 30
    found = runs_of(np.array(words), np.zeros(len(words), np.int64), times, least)
    assert [tuple(r) for r in found.tolist()] == brute(words, times, least)
    with pytest.raises(ValueError):
        runs_of(np.zeros(9, np.int64), np.zeros(9, np.int64), 3)


def test_rules_derive_what_they_stand_for():
    rng = random.Random(4)
    words = np.array(rng.choices(range(4), k=3000) + rng.choices(range(4, 40), k=2000))
    owner = np.repeat([0, 1], [3000, 2000])
    rounds, (start, end, of) = repair(words, owner)
    for name, begin, middle, stop in rounds:
        for rule in np.unique(name):
            at = np.flatnonzero(name == rule)
            assert len(at) > 1 and (begin < middle).all() and (middle < stop).all()
            assert len({tuple(words[begin[i] : stop[i]]) for i in at}) == 1
            assert (begin[at[1:]] >= stop[at[:-1]]).all()
    # what is left covers every word once and is much shorter
    assert start[0] == 0 and end[-1] == 5000 and (start[1:] == end[:-1]).all() and (np.diff(of) >= 0).all()
    assert (of == 0).sum() < 1000 and (of == 1).sum() < 1500


def test_long_texts_of_few_words_take_no_square_of_time():
    for words in (np.zeros(400_000), np.arange(400_000) % 3, np.bitwise_count(np.arange(400_000)) % 2):
        found = runs_of(words.astype(np.int64), np.zeros(len(words), np.int64)).tolist()
        assert found in ([[0, 400_000, 1]], [[0, 400_000, 3]], [])  # the last one, Thue and Morse's, has no cube


def expected_row(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return (doc, len(runs), *longest, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(kept))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    short = [r for r in docs if len(r["text"]) < 2500]
    assert len(found) == len(docs) and len(short) > 100
    assert all(found[r["doc_id"]] == expected_row(r["doc_id"], r["text"]) for r in short)
    assert sum(r[1] > 0 for r in found.values()) > 5


def test_odd_texts(spark, odd_texts, no_docs, monkeypatch):
    rows = {}
    for size in (1 << 18, 50):  # also where texts are longer than what is taken at once
        monkeypatch.setattr(module, "WORDS_AT_ONCE", size)
        found = periodic_runs(odd_texts).collect()
        assert len(found) == odd_texts.count()
        for r in found:
            rows.setdefault(r["doc_id"], set()).add((r["n_words"], str([tuple(x) for x in r["runs"]]), len(r["collapsed"])))
    assert rows[1] == rows[2] == rows[3] == {(0, "[]", 0)} and rows[5] == {(1, "[]", 4)}
    assert rows[6] == {(20_000, "[(0, 20000, 5)]", 27)}
    assert rows[7] == {(20_001, "[(0, 20000, 5)]", 29)}
    assert rows[9] == {(1, "[]", 5000)} and rows[None] == {(2, "[]", 3), (0, "[]", 0)}
    assert periodic_runs(no_docs).count() == 0
