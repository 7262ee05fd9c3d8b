"""Loaders and sinks on small files."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F, types as T

from casework import fixed_values as fixed, schema
from casework.operators import profiling
from casework.plans import scoring_run
from casework.plans.adapters import cases, code_map, literal_cases, responses
from casework.sources import readers, writers
from casework.sources.split_csv import read_csv
from conftest import SMALL


def test_cases_in_three_forms(spark, tmp_path):
    df = literal_cases(spark, SMALL)
    for form in ("parquet", "csv", "json"):
        paths = {}
        for split in ("train", "validate", "test"):
            part = df.where(F.col("split") == split).drop("split").select(*schema.CASES.names)
            paths[split] = str(tmp_path / form / split)
            if form == "csv":
                writers.write_csv(part, paths[split])
            else:
                part.write.format(form).save(paths[split])
        loaded = readers.load_cases(spark, paths, form)
        assert loaded.columns == [*schema.CASES.names, "split"]
        assert loaded.exceptAll(df.select(*loaded.columns)).count() == 0
        assert loaded.count() == df.count()


def test_code_map(spark, tmp_path):
    entries = {
        "E_1": {"name": "cough", "question_en": "Do you cough?", "data_type": "B", "value_meaning": {}, "extra": 1},
        "E_2": {"name": "pain", "value_meaning": {"V_1": {"en": "arm", "fr": "bras"}}},
        "E_3": "plain text",
    }
    path = tmp_path / "codes.json"
    path.write_text(json.dumps(entries, indent=2), encoding="utf-8")
    rows = {r["code"]: r for r in readers.load_code_map(spark, str(path)).collect()}
    assert rows["E_1"]["question_en"] == "Do you cough?" and rows["E_1"]["value_meaning"] == {}
    assert rows["E_2"]["value_meaning"] == {"V_1": {"en": "arm", "fr": "bras"}} and rows["E_2"]["data_type"] is None
    assert rows["E_3"]["entry_text"] == "plain text" and rows["E_3"]["name"] is None
    out = str(tmp_path / "written")
    writers.write_code_map(code_map(spark, SMALL), out)
    again = readers.load_code_map(spark, out)
    assert sorted(map(str, again.collect())) == sorted(map(str, code_map(spark, SMALL).collect()))


def test_questions(spark, tmp_path):
    path = tmp_path / "train.jsonl"
    path.write_text('{"qa_id": 1, "question": "q", "options": {"A": "1", "B": "2"}, "answer_idx": "A"}\n')
    row = readers.load_qa(spark, {"train": str(path)}, "json").first()
    assert row["options"] == {"A": "1", "B": "2"} and row["split"] == "train"


def test_corpus(spark, tmp_path):
    root = tmp_path / "my corpus"
    for name, content in {
        "data/viruses/a.txt": "Grüße".encode(), "data/viruses/b.txt": b" \n ", "data/cells/c.txt": b"\xff\xfe bad",
        "lonely.txt": b"alone", "data/cells/deep/d.txt": b"x y",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    docs, failures = readers.load_corpus(spark, str(root))
    found = {r["path"]: (r["category"], r["filename"], r["text"]) for r in docs.collect()}
    assert found == {
        "data/viruses/a.txt": ("viruses", "a.txt", "Grüße"), "lonely.txt": ("unknown", "lonely.txt", "alone"),
        "data/cells/deep/d.txt": ("cells", "d.txt", "x y"),
    }
    assert [r["path"] for r in failures.collect()] == ["data/cells/c.txt"]
    listing = tmp_path / "catalog.json"
    listing.write_text(json.dumps({"categories": {"viruses": ["v1", "v2"], "cells": ["c1"], "none": []}}))
    catalog = readers.load_catalog(spark, str(listing))
    assert sorted(map(tuple, catalog.collect())) == [("cells", 0, "c1"), ("viruses", 0, "v1"), ("viruses", 1, "v2")]
    rates = profiling.load_rates(docs, failures, catalog).first()
    assert (rates["loaded"], rates["failed"], rates["listed"], rates["success_pct"]) == (3, 1, 3, 75.0)


def test_results_round_trip(spark, tmp_path):
    asked = scoring_run.prompts(literal_cases(spark, SMALL), code_map(spark, SMALL), n=40)
    results = scoring_run.score_run(asked, responses(spark, SMALL)).cache()
    assert results.columns == schema.RESULTS.names
    assert [f.dataType for f in results.schema] == [f.dataType for f in schema.RESULTS]
    path = str(tmp_path / "results")
    writers.write_csv(results, path)
    again = readers.read_results(spark, path)
    text = ["raw_model_response", "diagnosis_options", "parsed_model_json", "severe_disease_list"]
    assert again.select(*text).exceptAll(results.select(*text)).count() == 0
    assert sorted(map(str, again.collect())) == sorted(map(str, results.collect()))


def test_missing_cells(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('case_id,correct,confidence,num_options,action,is_severe,high_confidence,refer_reason\n'
                    '1,NA,,5,"a ""b""\nc",none,null,None\n')
    row = readers.read_results(spark, str(path), schema.SCORED).first()
    assert (row["case_id"], row["correct"], row["confidence"]) == (1, None, None)
    assert (row["action"], row["is_severe"], row["high_confidence"]) == ('a "b"\nc', "none", None)


def test_json_lines_keep_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "é\n\"x\"")], "i long, a string, b string")
    path = str(tmp_path / "out")
    writers.write_jsonl(df, path)
    lines = [json.loads(r[0]) for r in spark.read.text(path).collect()]
    assert lines == [{"i": 1, "a": None, "b": "é\n\"x\""}]


def test_entry_b_from_files(spark, tmp_path):
    """Results from CSV through the decision layer to scored rows, as text and back."""
    path = str(tmp_path / "run")
    asked = scoring_run.prompts(literal_cases(spark, SMALL), code_map(spark, SMALL), n=60, rules=True)
    writers.write_csv(scoring_run.score_run(asked, responses(spark, SMALL)), path)
    results = readers.read_results(spark, path).withColumnRenamed("original_test_index", "case_id")
    decided = scoring_run.decide_run(results)
    out = str(tmp_path / "decided")
    writers.write_csv(decided, out)
    from casework.operators.evaluation import normalise_scored, run_report

    direct = run_report(normalise_scored(decided)).first()
    stored = run_report(normalise_scored(readers.read_results(spark, out, schema.SCORED))).first()
    assert direct == stored and direct["total"] == 60


def test_prompts_hold_the_severe_list(spark):
    asked = scoring_run.prompts(cases(spark, SMALL), code_map(spark, SMALL), n=5, rules=True)
    for row in asked.collect():
        assert [m["role"] for m in row["messages"]] == ["system", "user"]
        assert all(f"- {name}" in row["messages"][1]["content"] for name in fixed.SEVERE_DEFAULT)


def test_written_tables_lie_in_the_shared_folder(spark):
    from casework.session import remove, shared_dir, written

    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named
    table, path = written(spark.range(3), "three")
    assert path.startswith(named) and sorted(r.id for r in table.collect()) == [0, 1, 2]
    remove(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "PATHOLOGY,AGE,SEX,EVIDENCES,INITIAL_EVIDENCE,DIFFERENTIAL_DIAGNOSIS\nFlu,30,M,[],E_1,[]\nCold,31,F,[],E_2,[]\n"
    )
    found = readers.load_cases(spark, {"test": str(tmp_path / "a.csv")}, "csv").orderBy("case_id").collect()
    assert [(r["case_id"], r["AGE"], r["PATHOLOGY"], r["INITIAL_EVIDENCE"]) for r in found] == [
        (0, 30, "Flu", "E_1"),
        (1, 31, "Cold", "E_2"),
    ]
    (tmp_path / "b.csv").write_text("case_num,original_test_index,age\n1,77,30\n")
    with pytest.raises(ValueError, match="lacks"):
        readers.read_results(spark, str(tmp_path / "b.csv"))


def test_parquet_without_ids_is_numbered_by_file_and_row(spark, tmp_path):
    for part in range(2):
        rows = [(part * 10 + i, "Flu") for i in range(10)]
        df = spark.createDataFrame(rows, "AGE int, PATHOLOGY string").coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / f"t/p={part}"))
    declared = "case_id long, AGE int, PATHOLOGY string"
    paths = {"test": str(tmp_path / "t/p=*")}
    found = readers.load_cases(spark, paths, declared=spark.createDataFrame([], declared).schema)
    assert sorted((r["case_id"], r["AGE"]) for r in found.collect()) == [(i, i) for i in range(20)]
    with pytest.raises(ValueError, match="lacks SEX, INITIAL_EVIDENCE, EVIDENCES"):
        readers.load_cases(spark, paths)


def test_corpus_names_stay_as_they_are(spark, tmp_path):
    root = tmp_path / "data"
    names = ["data/c/a+b.txt", "data/c/100% sure.txt", "data/data/x y.txt"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    docs, failures = readers.load_corpus(spark, str(root))
    assert {r["path"]: r["text"] for r in docs.collect()} == {n.removeprefix("data/"): n for n in names}
    assert failures.isEmpty()
    listed = spark.createDataFrame([("c/a+b.txt",), ("c/gone.txt",)], "path string")
    docs, failures = readers.load_corpus(spark, str(root), listed=listed)
    assert [r["path"] for r in docs.collect()] == ["c/a+b.txt"]
    assert [tuple(r) for r in failures.collect()] == [("c/gone.txt", "no such file")]


def test_dictionary_comes_back_whole(spark, tmp_path):
    source = tmp_path / "codes.json"
    source.write_text('{"E_1": {"name": "a", "question_en": "q?", "extra": [1, 2]}, "E_2": "plain"}')
    entries = readers.read_code_entries(spark, str(source))
    writers.write_code_map(entries, str(tmp_path / "out"))
    again = readers.load_code_map(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(
        map(tuple, readers.load_code_map(spark, str(source)).collect()), key=str
    )
    assert "extra" in {r["code"]: r["entry_text"] for r in readers.read_code_entries(spark, str(tmp_path / "out")).collect()}["E_1"]


CELLS = ['plain', 'two\nlines', 'a "quote"', '"', '""', '\n', ', comma', 'x\r\ny', '', None, ' blanks ', 'é日本', '\n\n"\n', 'end"', "it's", '"\n"']


def _csv_text(rows, end):
    def cell(v):
        v = "" if v is None else str(v)
        return '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\r\n') or v != v.strip() else v

    return end.join(",".join(map(cell, r)) for r in rows) + end


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", ["150", "100000"])
def test_csv_is_the_same_however_it_is_cut(spark, tmp_path, end, size):
    rng = random.Random(5)
    for name in ("a.csv", "b.csv"):
        rows = [[i, rng.choice(CELLS), rng.choice(CELLS) if i % 5 else "long\n" * 30] for i in range(30)]
        text = _csv_text([["i", "x", "y"], *rows], end).replace(end, end + end, 1)  # a blank line behind the header
        (tmp_path / name).write_bytes(text.encode())
    whole = spark.read.options(header="true", quote='"', escape='"', multiLine="true").csv(str(tmp_path))
    expected = sorted(map(repr, map(tuple, whole.collect())))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        cut = read_csv(spark, str(tmp_path))
        assert sorted(map(repr, map(tuple, cut.select("i", "x", "y").collect()))) == expected and len(expected) == 60
        tasks = cut.select("_file", "_block").distinct().count()
        assert tasks > (1 if size == "100000" else 12)
        loaded = readers.load_cases(spark, {"all": str(tmp_path)}, "csv", T.StructType.fromDDL("case_id long, i string"), "case_id")
        assert [int(r["i"]) for r in loaded.orderBy("case_id").collect()] == [*range(30), *range(30)]
        assert sorted(r["case_id"] for r in loaded.collect()) == [*range(60)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_without_rows(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b\n")
    assert read_csv(spark, str(tmp_path)).count() == 0
