"""The stream gives the rows that the batch run gives, across a restart."""

from pyspark.sql import functions as F

from casework.plans import adapters
from casework.operators.evaluation import passk_flags, passk_summary
from casework.operators.responses import running_accuracy
from casework.plans.scoring_run import scored_run
from casework.streaming.accuracy import (
    read_outcomes, read_running_accuracy, write_outcomes, write_running_accuracy,
)
from casework.streaming.decisions import read_results_stream, write_decisions
from conftest import SMALL


def test_stream_equals_batch(spark, tmp_path):
    source, out, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    run = adapters.run_results(spark, SMALL)
    schema = "case_id long, case_num long, true_diagnosis string, diagnosis_options string, raw_model_response string"
    for part in (0, 1):
        run.where(F.col("case_id") % 2 == part).coalesce(1).write.mode("append").parquet(source)
        stream = read_results_stream(spark, source, schema)
        query = write_decisions(stream, out, progress, ["NATION_0", "NATION_5"], availableNow=True)
        assert query.awaitTermination(120)
    batch = scored_run(run, severe=["NATION_0", "NATION_5"])
    found = spark.read.parquet(out)
    assert found.count() == batch.count()
    assert found.select(*batch.columns).exceptAll(batch).count() == 0


def test_accuracy_goes_on_while_responses_arrive(spark, tmp_path):
    rows = spark.range(1, 701).selectExpr(
        "id as case_num", "id % 3 = 0 as is_correct", "id % 3 = 0 as correct", "id % 7 / 10D as confidence",
        "cast(id % 5 as double) as num_options", "id % 4 = 0 as is_referral", "id % 6 = 0 as is_severe", "id % 2 as part",
    )
    source, schema = str(tmp_path / "in"), rows.schema
    # blocks arrive in parts, later ones first; each call is a restart
    for arriving in ("case_num % 2 = 0 and case_num > 300", "case_num <= 120", "case_num % 2 = 1 and case_num > 300", "case_num between 121 and 300"):
        rows.where(arriving).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        known = rows.where("false").union(spark.read.schema(schema).parquet(source))
        accuracy = write_running_accuracy(stream, str(tmp_path / "blocks"), str(tmp_path / "p1"), availableNow=True)
        assert accuracy.awaitTermination(120)
        found = read_running_accuracy(spark, str(tmp_path / "blocks"))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, running_accuracy(known).collect()))
    outcomes = write_outcomes(passk_flags(stream), str(tmp_path / "sums"), str(tmp_path / "p2"), ["part"], availableNow=True)
    assert outcomes.awaitTermination(120)
    batch = passk_summary(passk_flags(rows), by="part")
    found = read_outcomes(spark, str(tmp_path / "sums"), ["part"]).select(*batch.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))
