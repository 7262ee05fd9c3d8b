"""Hard negatives against SQL and brute force, and on odd tables."""

import math

import numpy as np
import pytest

from casework.llm import hard_negatives as module
from casework.llm.hard_negatives import SuffixIndex, hard_negatives, search_block
from casework.llm.queries import ORACLES, QUERIES
from compare import connect, differences
from conftest import SMALL, interpret
from odd_tables import workers  # noqa: F401  fixtures

SCHEMA = "vec_id long, label int, embedding array<double>, rank string, cell int, low double"


def test_query_matches_its_sql(spark):
    interpret(spark, False)
    try:
        name = "op11_hard_negatives"
        assert differences(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name]) == []
    finally:
        interpret(spark, True)


def brute(rows, every, positives, k, least, most):
    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows]
    out = set()
    for a, label, v in rows:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), b, lab) for b, lab, w in rows if b != a]
        near = sorted((s, b) for s, b, lab in scored if lab == label)[:positives]
        for place, (s, p) in enumerate(near):
            inside = sorted((t, b) for t, b, lab in scored if lab != label and least * -s <= 100 * -t <= most * -s)
            out |= {(a, p, r + 1, b, -s, -t, place + 1) for r, (t, b) in enumerate(inside[:k])}
    return out


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_windows_against_brute_force(spark, monkeypatch, spread):
    for name, size in (("CELL_ROWS", 16), ("PIECE_ROWS", 20), ("PART_ROWS", 3), ("QUERIES_AT_ONCE", 4)):
        monkeypatch.setattr(module, name, size)
    rng = np.random.default_rng(int(spread * 100))
    centres = rng.normal(size=(6, 10))
    vectors = np.round(centres[rng.integers(0, 6, 300)] + rng.normal(size=(300, 10)) * spread, 2)
    vectors[200:] = vectors[7]  # a third are copies: ties everywhere
    # the label of two thirds is one
    rows = [(i, int(rng.integers(0, 4)) if i % 3 == 0 else 1, v) for i, v in enumerate(vectors.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = {tuple(r) for r in hard_negatives(df, every=10, positives=4, k=3).collect()}
    assert found == brute(rows, 10, 4, 3, 80, 100)
    if spread == 3.0:
        wide = {tuple(r) for r in hard_negatives(df, every=30, positives=2, k=7, least=0, most=120).collect()}
        assert wide == brute(rows, 30, 2, 7, 0, 120)


def test_index_omits_only_what_cannot_reach():
    rng = np.random.default_rng(2)
    rows, queries = rng.integers(-20, 20, (80, 21)).astype(float), rng.integers(-20, 20, (9, 21)).astype(float)
    prefix = np.sqrt(np.hstack([np.zeros((80, 1)), np.square(rows).cumsum(1)]))
    index = SuffixIndex(rows, prefix, 40.0)
    assert 0 < index.start.min() < index.start.max() and (np.linalg.norm(rows[index.start == 21], axis=1) < 40).all()
    kept = np.zeros_like(rows)
    for dims, held, values in index.postings:
        kept[np.ix_(held, dims)] = values
    assert (np.linalg.norm(rows - kept, axis=1) < 40).all()
    names = np.arange(80)
    everything = np.ones((9, 80), bool)
    q, w, name, score = search_block(queries, rows, names, lambda s: everything[s], np.full((9, 1), 100), np.full((9, 1), 600), 80)
    exact = queries @ rows.T
    assert {(a, b, s) for a, b, s in zip(q, name, score)} == {(a, b, exact[a, b]) for a, b in zip(*np.nonzero((exact >= 100) & (exact <= 600)))}


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (0, 1, [1.0, 0.0]), (100, 1, [1.0, 0.0]), (1, 1, [0.9, 0.0]), (2, 2, [0.8, 0.0]), (2, 2, [0.8, 0.0]), (3, None, [1.0, 0.0]),
        (4, 2, None), (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]), (7, 2, [None, 1.0]), (8, 2, [1.0]), (9, 2, []), (None, 2, [0.9, 0.0]),
        (10, 2, [0.75, 0.0]), (200, 3, [0.0, 1e15]), (11, 3, [0.0, 2e15]), (12, 2, [0.0, 1.9e15]), (300, 4, [-1.0, 0.0]), (13, 2, [1e308, 0.0]),
    ]
    df = spark.createDataFrame([(i, lab, v, "x", 1, 0.5) for i, lab, v in rows], SCHEMA)
    found = sorted(tuple(r) for r in hard_negatives(df).collect())
    # 0 and 100 are equal; positives of both: the other one (65536) and 1 (230 * 256); the repeated key 2 counts twice
    score = 256 * 204
    for a, other in ((0, 100), (100, 0)):
        mine = [r[1:6] for r in found if r[0] == a]
        assert mine == sorted([(1, 1, 2, 256 * 230, score), (1, 2, 2, 256 * 230, score), (1, 3, 10, 256 * 230, 256 * 192)])
        assert other not in {r[0] for r in mine}
    big = [r for r in found if r[0] == 200]
    assert [(r[1], r[2], r[3]) for r in big] == [(11, 1, 12)] and big[0][4] == big[0][5] == 2**63 - 1
    assert not [r for r in found if r[0] == 300]
    assert hard_negatives(df.limit(0)).count() == 0 and hard_negatives(df.where("vec_id = 0")).count() == 0
