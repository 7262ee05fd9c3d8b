"""Top-k and near-duplicate vectors against brute force and on odd tables."""

import math

import numpy as np
import pytest

from casework.llm.embeddings import near_vectors
from casework.llm.queries import ORACLES, QUERIES
from casework.llm.topk import block_top_k, top_k
from compare import connect, differences
from conftest import SMALL, interpret
from odd_tables import workers  # noqa: F401  fixtures

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, kept double"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]),
        (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, []), (None, [1.0, 0.0]), (10, [0.0, 1.0]), (50, [-1.0, -0.5]),
        (11, [1e30, 0.0]), (12, [-0.0, 1.0]),
    ]
    return spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("name", ["op6_top_k", "op7_embedding_near_dedup"])
def test_queries_match_their_sql(spark, name):
    interpret(spark, False)
    try:
        assert differences(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name]) == []
    finally:
        interpret(spark, True)


@pytest.mark.parametrize("spread", [3, 300])
def test_blocks_are_pruned_without_loss(spread):
    rng = np.random.default_rng(spread)
    docs = rng.integers(-spread, spread, (700, 6)).astype(float)  # few values, so many ties
    ids = rng.permutation(700)
    asked = docs[:40]
    row, name, score = block_top_k(asked, ids[:40], docs, ids, 5)
    all_ = asked @ docs.T
    for i in range(40):
        all_[i, i] = -np.inf
        best = np.lexsort((ids, -all_[i]))[:5]
        assert name[row == i].tolist() == ids[best].tolist() and score[row == i].tolist() == all_[i][best].tolist()


def test_top_k_on_odd_rows(spark, odd_vectors):
    found = top_k(odd_vectors.where("vec_id is null or vec_id != 11")).collect()
    by = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found}
    assert [by[0, i] for i in range(1, 6)] == [(1, 131072), (2, 65536), (2, 65536), (4, 0), (10, 0)]
    assert by[50, 1] == (4, 0) and {q for q, _ in by} == {0, 50}
    assert top_k(odd_vectors.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [3e6, 1.0]), (1, [1e7, 1.0]), (2, [1e7, 2.0])], "vec_id long, embedding array<float>")
    scores = [r["score"] for r in top_k(huge).orderBy("rank").collect()]
    assert scores == [256 * 3000000 * 256 * 10000000 + 256 * 512, 256 * 3000000 * 256 * 10000000 + 256 * 256]


def brute(vectors, least):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = unit @ unit.T >= least
    np.fill_diagonal(linked, False)
    return linked


@pytest.mark.parametrize("reach, recall", [(3.0, 0.9), (None, 1.0)])
def test_near_vectors_reach_their_recall(spark, monkeypatch, reach, recall):
    monkeypatch.setattr("casework.llm.embeddings.LIST_SIZE", 40)
    monkeypatch.setattr("casework.llm.embeddings.CHUNK", 64)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 16))
    near = base[rng.integers(0, 40, 400)] + rng.normal(size=(400, 16)) * 0.12
    vectors = np.vstack([base, near, near[:50]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), reach=reach).collect()
    links = {r["vec_id"]: r["n_links"] for r in found}
    exact = brute(vectors.astype(float), 0.95).sum(1)
    assert all(links[i] <= n for i, n in enumerate(exact))
    assert sum(links.values()) / exact.sum() >= recall
    if recall == 1.0:
        assert all(links[i] == n for i, n in enumerate(exact))


def test_near_vectors_on_odd_rows(spark, odd_vectors):
    found = sorted((tuple(r) for r in near_vectors(odd_vectors).collect()), key=repr)
    assert len(found) == odd_vectors.count()
    rows = {}
    for i, *rest in found:
        rows.setdefault(i, set()).add(tuple(rest))
    assert rows[0] == {(4, 0, True)} and rows[1] == {(4, 0, False)} and rows[2] == {(4, 0, False)}
    assert rows[11] == {(4, 0, False)} and rows[10] == {(1, 10, True)} and rows[12] == {(1, 10, False)}
    for alone in (3, 4, 5, 6, 7, 8, 9, 50):
        assert rows[alone] == {(0, alone, True)}
    assert rows[None] == {(0, None, False)}
    assert near_vectors(odd_vectors.limit(0)).count() == 0
    assert near_vectors(odd_vectors.where("vec_id = 3")).collect()[0]["kept"] is True
