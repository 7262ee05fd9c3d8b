"""Mixing, archives, components and the pipeline."""

import random
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import islice

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casework.llm import warc
from casework.llm.components import components
from casework.llm.mixing import mix, schedule, shares, turns
from casework.llm.queries import ORACLES, QUERIES
from compare import connect, differences
from conftest import SMALL, interpret
from odd_tables import no_docs, odd_texts, workers  # noqa: F401  fixtures


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 0.01}, {s: i + 1.5 for i, s in enumerate("abcdefghij")}])
def test_deviation_stays_below_one_block(weights):
    slots = shares(weights, 512)
    assert sum(slots.values()) == 512
    served = Counter()
    for at, (source, block) in enumerate(schedule(slots)):
        assert served[source] == block
        served[source] += 1
        for s, n in slots.items():
            assert abs(served[s] - (at + 1) * n / 512) < 1
    assert served == slots


@pytest.mark.parametrize("sources", [20, 500, 5000])
def test_deviation_from_the_weights_themselves(sources):
    weights = {"hot": 1 / 3} | {f"s{i}": 2 / 3 / (sources - 1) for i in range(sources - 1)}
    total = sum(map(Fraction, weights.values()))
    names = sorted(weights)
    served = Counter()
    for i, block, slot in islice(turns(weights, dict.fromkeys(weights, 10**9)), 20_000):
        assert block == served[names[i]]
        served[names[i]] += 1
        # the source served and the hot one; every source now and then
        for s in names if slot % 1999 == 0 else (names[i], "hot"):
            assert abs(served[s] - (slot + 1) * Fraction(weights[s]) / total) < 1


def test_more_sources_than_a_period(spark, monkeypatch):
    docs = spark.range(5000).selectExpr("id as doc_id", "cast(id as string) as source")
    whole = sorted(map(tuple, mix(docs).collect()))
    assert len({r[3] for r in whole}) == 5000
    monkeypatch.setattr("casework.llm.mixing.PLANNED", 3000)  # a plan that is written in parts
    monkeypatch.setattr("casework.llm.mixing.SENT", 0)
    assert sorted(map(tuple, mix(docs).collect())) == whole


def test_mixture(spark, no_docs):
    rows = [(i, "big" if i % 3 else ("small" if i % 2 else None)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"big": 0.5, "small": 0.25, None: 0.25}
    found = mix(docs, weights, block=7, period=16).orderBy("mix_slot", "mix_place").collect()
    assert len(found) == 3000 and len({(r["mix_slot"], r["mix_place"]) for r in found}) == 3000
    blocks = defaultdict(list)
    for r in found:
        blocks[r["mix_slot"]].append(r)
    end = min(s for s in range(max(blocks) + 2) if s not in blocks)
    served = Counter()
    for slot in range(end):
        served[blocks[slot][0]["source"]] += 1
        assert len({r["source"] for r in blocks[slot]}) == 1 and all(r["in_mix"] for r in blocks[slot])
        assert all(abs(served[s] - (slot + 1) * w) < 1 for s, w in weights.items())
    assert not any(r["in_mix"] for s, rows in blocks.items() if s >= end for r in rows)
    short = [rows[0]["source"] for rows in blocks.values() if len(rows) != 7]
    assert len(short) == len(set(short))  # the last block of a source
    left_out = mix(docs, {"big": 1.0})
    assert left_out.where("in_mix").select("source").distinct().collect() == [("big",)]
    assert left_out.where("mix_slot is null").count() == 1000
    assert mix(no_docs).count() == 0


def test_mixing_of_odd_rows(spark, odd_texts):
    found = mix(odd_texts)
    assert found.columns == [*[c for c in odd_texts.columns if c != "mix_slot"], "mix_block", "mix_slot", "mix_place", "in_mix"]
    assert found.count() == odd_texts.count() and found.where("mix_slot is null").count() == 0


def test_hot_sources_are_numbered_in_ranges(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "s") for i in range(2000)], "doc_id long, source string")
    whole = sorted(map(tuple, mix(docs).collect()))
    monkeypatch.setattr("casework.llm.mixing.RANGE", 100)
    assert sorted(map(tuple, mix(docs).collect())) == whole


def test_archives_against_sql(spark):
    interpret(spark, False)
    try:
        assert differences(QUERIES["op10_warc"](spark, SMALL), connect(SMALL), ORACLES["op10_warc"]) == []
    finally:
        interpret(spark, True)


@pytest.mark.parametrize("chunk", [1 << 20, 37, 5])
def test_archives_round_trip(spark, tmp_path, chunk):
    nasty = "é WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9 + "\r\n\r\nWARC/1.1\r"
    rows = [
        (1, "http://a/\r\nx: y", nasty), (2, None, nasty), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
        (7, "u", "日" * 1000), (7, "u", "日" * 1000), (None, "u", "日" * 1000), (8, "u", "WARC/1.1\r\n"), (9, "u", "y" * 99),
        (10, "u", "y" * 99), (11, "u", "z" * 100), (12, "u", "z" * 100), (None, None, None),
    ]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, chunk=chunk)
    found = sorted((tuple(r) for r in warc.read_pages(spark, path).collect()), key=repr)
    import hashlib

    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    expected = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html in first and i != first[html]
        kind = "revisit" if revisit else "response"
        expected.append((i, len(data), hashlib.sha256(data).hexdigest(), kind, first[html] if revisit else None))
    assert found == sorted(expected, key=repr)
    sizes = warc.read_chunks(spark, path).select(F.max(F.length("data"))).first()[0]
    assert sizes <= chunk


def test_empty_archives(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    assert warc.read_pages(spark, str(tmp_path / "w")).count() == 0


def test_damage_is_told(spark, tmp_path):
    record = b"".join(warc._format([_batch((1, "u", "d" * 64, 3, None, 0, 0, b"abc"))]).__next__().column(0).to_pylist())
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.txt").write_bytes(record.replace(b"abc", b"abd") + b"\n")
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_pages(spark, str(tmp_path / "w")).collect()


def _batch(row):
    import pyarrow as pa

    return pa.record_batch([pa.array([v]) for v in row], names=list("abcdefgh"))


def test_components(spark):
    rng = random.Random(1)
    for n, links in ((200, 120), (300, 900), (50, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(links)] + [(i, i + 1) for i in range(1000, 1000 + links // 2)]
        edges += [(None, 3), (4, None), (5, 5)]
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a is not None and b is not None and a != b:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
        found = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert sorted(map(tuple, found)) == sorted((x, root(x)) for x in parent)


def test_mixing_stage_keeps_every_document(spark):
    rows = spark.range(140_001).selectExpr("id as doc_id", "if(id = 7, 'one', 'large') as source")
    assert corpus_pipeline.source_mixing(spark, rows, SMALL).count() == 140_001
    rows = spark.range(3100).selectExpr("id as doc_id", "if(id < 100, null, 'large') as source")
    kept = [r["source"] for r in corpus_pipeline.source_mixing(spark, rows, SMALL).collect()]
    assert Counter(kept) == {None: 100, "large": 3000}
    share = 100**0.9 / (100**0.9 + 3000**0.9)
    assert all(abs(kept[: 16 * n].count(None) / 16 - n * share) < 1 for n in range(1, 140))


def test_pipeline(spark, odd_texts):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SMALL).collect(), docs.schema)
        assert kept.columns == columns, name
        seen.append(kept.count())
    assert seen[0] >= 195 and seen[1] < seen[0] and seen[2] == seen[1] and seen[3] > 0.5 * seen[2]
    texts = kept.select("text").collect()
    assert len({r["text"] for r in texts if len(r["text"]) >= 200}) == sum(len(r["text"]) >= 200 for r in texts)
    odd = odd_texts.select(*columns)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SMALL).columns == columns
        assert stage(spark, odd.limit(0), SMALL).count() == 0
    once = corpus_pipeline.simhash_near_dedup(spark, odd, SMALL)
    assert once.where("doc_id = 5").count() == 0 and once.where("doc_id = 4").count() == 1
    assert corpus_pipeline.run(spark, SMALL).count() > 100
