"""Strict Pass@1 and its breakdowns (E1-E14). Every report is one aggregate over the scored rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from casework import fixed_values as fixed
from casework.functions.text import strip, to_number
from casework.operators.totals import totals

# Outcome columns of ``passk_flags`` and their names in the outcome table.
FAILURES = ("fail_wrong_dx", "fail_severe_not_referred", "fail_low_conf_not_referred")


def truthy(c: Column) -> Column:
    """Whether the text of a mark is one of the fixed true marks."""
    return F.coalesce(strip(c.cast("string")).isin(list(fixed.TRUTHY)), F.lit(False))


def _mark(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.coalesce(F.col(name), F.lit(False))
    return truthy(F.col(name))


def _number(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.NumericType):
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)
    return to_number(F.col(name))


def normalise_scored(df: DataFrame) -> DataFrame:
    """Marks to boolean, numbers to double with NaN as NULL, ``action`` to ``is_referral``. Columns that
    have these types already are not read as text."""
    action = F.upper(strip(F.col("action").cast("string")))
    return df.withColumns(
        {
            "correct": _mark(df, "correct"),
            "confidence": _number(df, "confidence"),
            "num_options": _number(df, "num_options"),
            "is_referral": F.coalesce(action == "REFER", F.lit(False)),
            "is_severe": _mark(df, "is_severe"),
            "high_confidence": _mark(df, "high_confidence"),
        }
    )


def with_threshold(df: DataFrame) -> DataFrame:
    """``confidence_threshold``: two in ``num_options``; infinite for 0 options, NULL for NULL."""
    n = F.col("num_options")
    infinite = F.lit(float("inf"))
    return df.withColumn("confidence_threshold", F.when(n == 0, infinite).otherwise(F.lit(2.0) / n))


def threshold_aggregates() -> list[Column]:
    t = F.col("confidence_threshold")
    return [
        F.min(t).alias("threshold_min"),
        F.max(t).alias("threshold_max"),
        F.avg(t).alias("threshold_mean"),
    ]


def threshold_stats(df: DataFrame) -> DataFrame:
    """Smallest, largest and mean threshold."""
    return with_threshold(df).agg(*threshold_aggregates())


def passk_flags(df: DataFrame) -> DataFrame:
    """The outcome flags of normalised rows. Successes overlap; failures do not."""
    df = with_threshold(df)
    confident = F.coalesce(F.col("confidence") > F.col("confidence_threshold"), F.lit(False))
    df = df.withColumn("above_threshold", confident)
    above, severe = F.col("above_threshold"), F.col("is_severe")
    referred, right = F.col("is_referral"), F.col("correct")
    df = df.withColumns(
        {
            "severe_not_referred": severe & ~referred,
            "success_correct_dx": above & right & ~(severe & ~referred),
            "success_severe_referred": severe & referred,
            "success_low_conf_referred": ~above & referred,
        }
    )
    passed = (
        F.col("success_correct_dx")
        | F.col("success_severe_referred")
        | F.col("success_low_conf_referred")
    )
    df = df.withColumn("pass_at_1_success", passed)
    missed = ~referred & ~severe & ~above
    return df.withColumns(
        {
            "fail_severe_not_referred": F.col("severe_not_referred"),
            "fail_low_conf_not_referred": missed,
            "fail_wrong_dx": ~F.col("pass_at_1_success") & ~F.col("severe_not_referred") & ~missed,
        }
    )


def _share(part: Column, whole: Column) -> Column:
    """Percentage, 0 of nothing."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def passk_aggregates() -> list[Column]:
    total, passed = F.count(F.lit(1)), F.count_if("pass_at_1_success")
    return [
        total.alias("total"),
        passed.alias("successes"),
        F.count_if("success_correct_dx").alias("success_correct_dx"),
        F.count_if("success_severe_referred").alias("success_severe_referred"),
        F.count_if("success_low_conf_referred").alias("success_low_conf_referred"),
        (total - passed).alias("failures"),
        *[F.count_if(name).alias(name) for name in FAILURES],
        _share(passed, total).alias("pass_at_1"),
        _share(total - passed, total).alias("failure_pct"),
    ]


def passk_summary(flags: DataFrame, by: str | None = None) -> DataFrame:
    """Outcome counts, shares and Pass@1, in all or per ``by``."""
    return (flags.groupBy(by) if by else flags).agg(*passk_aggregates())


def assert_partition(summary: DataFrame, fail: bool = False) -> DataFrame:
    """E5: ``partition_ok``: successes and the three failures add up. With ``fail`` a mismatch is an error."""
    parts = reduce(lambda a, b: a + b, [F.col(name) for name in FAILURES], F.col("successes"))
    holds = parts == F.col("total")
    if fail:
        wrong = F.raise_error(F.lit("outcome categories do not add up to the total"))
        return summary.withColumn("partition_ok", F.when(holds, F.lit(True)).otherwise(wrong))
    return summary.withColumn("partition_ok", holds)


def decision_breakdown(df: DataFrame) -> DataFrame:
    """Cases, coverage, correct and accuracy per decision; a side without cases has no row."""
    sides = df.groupBy("is_referral").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("correct").alias("correct")
    )
    total = totals(sides, total=F.sum("cases"))["total"]
    return sides.select(
        "is_referral",
        "cases",
        (F.col("cases") / total * 100).alias("coverage_pct"),
        "correct",
        (F.col("correct") / F.col("cases") * 100).alias("accuracy_pct"),
    )


def refer_reasons(df: DataFrame, order_key: str = "case_id") -> DataFrame:
    """Referrals per reason with their share of all cases, the most frequent first, ties by first
    appearance. Without a ``refer_reason`` column there are no rows."""
    if "refer_reason" not in df.columns:
        df = df.withColumn("refer_reason", F.lit(None).cast("string"))
    counted = F.col("is_referral") & F.col("refer_reason").isNotNull()
    reasons = df.groupBy("refer_reason").agg(
        F.count(F.lit(1)).alias("_all"),
        F.count_if(counted).alias("cases"),
        F.min(F.when(counted, F.col(order_key))).alias("_first"),
    )
    total = totals(reasons, total=F.sum("_all"))["total"]
    return (
        reasons.where(F.col("cases") > 0)
        .orderBy(F.desc("cases"), "_first")
        .select("refer_reason", "cases", (F.col("cases") / total * 100).alias("share_pct"))
    )


def safety_aggregates() -> list[Column]:
    referred, right = F.col("is_referral"), F.col("correct").cast("int")
    return [
        F.count_if(~referred).alias("diagnosed"),
        F.count_if(referred).alias("referred"),
        (F.avg(F.when(~referred, right)) * 100).alias("diagnosed_accuracy"),
        (F.avg(F.when(referred, right)) * 100).alias("referred_accuracy"),
    ]


def safety_verdict() -> Column:
    safer = F.col("diagnosed_accuracy") > F.col("referred_accuracy")
    return F.when(safer, F.lit("passed")).otherwise(F.lit("check"))


def safety_check(df: DataFrame) -> DataFrame:
    """Passed if diagnosed cases are more often right than referred ones; an empty side has a NULL
    accuracy and is no pass."""
    return df.agg(*safety_aggregates()).withColumn("safety", safety_verdict())


def calibration_aggregates() -> list[Column]:
    confidence, right = F.col("confidence"), F.col("correct")
    return [
        F.avg(confidence).alias("confidence_all"),
        F.avg(F.when(right, confidence)).alias("confidence_correct"),
        F.avg(F.when(~right, confidence)).alias("confidence_wrong"),
    ]


def calibration_verdict() -> Column:
    surer = F.col("confidence_correct") > F.col("confidence_wrong")
    return F.when(surer, F.lit("good")).otherwise(F.lit("poor"))


def calibration(df: DataFrame) -> DataFrame:
    """Mean confidence of all, right and wrong cases, and whether right ones are surer."""
    return df.agg(*calibration_aggregates()).withColumn("calibration", calibration_verdict())


def accuracy(df: DataFrame, mark: str = "correct") -> DataFrame:
    """Cases, right ones and accuracy by the result mark."""
    total, right = F.count(F.lit(1)), F.count_if(F.col(mark) == fixed.RIGHT_MARK)
    return df.agg(
        total.alias("cases"), right.alias("correct"), _share(right, total).alias("accuracy_pct")
    )


def label_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Share of labels that are exactly equal, from 0 to 1."""
    total = F.count(F.lit(1))
    right = F.count_if(F.coalesce(F.col(truth) == F.col(predicted), F.lit(False)))
    return df.agg(
        total.alias("cases"),
        right.alias("correct"),
        F.when(total > 0, right / total).otherwise(F.lit(0.0)).alias("accuracy"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def class_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class: ``support``, ``predicted`` and ``hits``. Pairs are counted before the margins are drawn,
    so the second shuffle holds one row per (true, predicted) pair."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    hit = F.when(F.col("t").eqNullSafe(F.col("p")), F.col("n")).otherwise(F.lit(0))
    margins = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("t").alias("label"), F.col("n").alias("support"),
                         F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("hits")),
                F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"),
                         F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
            )
        ).alias("m")
    ).select("m.*")
    return (
        margins.where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(*[F.sum(name).alias(name) for name in ("support", "predicted", "hits")])
    )


def prf(df: DataFrame, truth: str = "true_diagnosis", predicted: str = "rank1_disease") -> DataFrame:
    """Precision, recall and F1 per class (exact labels); zero denominators give 0."""
    hits, support, given = F.col("hits"), F.col("support"), F.col("predicted")
    return class_counts(df, truth, predicted).select(
        "label",
        "support",
        "predicted",
        "hits",
        _ratio(hits, given).alias("precision"),
        _ratio(hits, support).alias("recall"),
        _ratio(2 * hits, given + support).alias("f1"),
    )


def prf_averages(per_class: DataFrame) -> DataFrame:
    """Macro and micro averages of ``prf`` rows."""
    hits, given, support = F.sum("hits"), F.sum("predicted"), F.sum("support")
    return per_class.agg(
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        _ratio(hits, given).alias("micro_precision"),
        _ratio(hits, support).alias("micro_recall"),
        _ratio(2 * hits, given + support).alias("micro_f1"),
    )


def outcome_table(summary: DataFrame) -> DataFrame:
    """Success and the three failures as rows with their share of all cases."""
    rows = summary.select(
        "total",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("outcome"), F.col(source).alias("cases"))
                    for name, source in [("success", "successes"), *[(f, f) for f in FAILURES]]
                ]
            )
        ).alias("r"),
    )
    return rows.select(
        "r.outcome", "r.cases", _share(F.col("r.cases"), F.col("total")).alias("share_pct")
    )


def compare_phases(runs: dict[str, DataFrame]) -> DataFrame:
    """``passk_summary`` of several runs (normalised rows), one row per phase, in one aggregate."""
    needed = ["correct", "confidence", "num_options", "is_referral", "is_severe"]
    parts = [df.select(*needed, F.lit(phase).alias("phase")) for phase, df in runs.items()]
    return passk_summary(passk_flags(reduce(DataFrame.unionByName, parts)), by="phase")


MARGINS = ("phase", "is_referral", "refer_reason", "is_severe")


def outcome_margins(flags: DataFrame, by: tuple[str, ...] = MARGINS) -> DataFrame:
    """E4-E9 and E13 over every combination of the ``by`` columns: cases, correct ones, outcomes and Pass@1.

    ``margin`` is the grouping id: its bit is set (the first column's highest) where a column is summed over, and
    that column is NULL. The flags are counted once per full combination; the margins are sums of those few rows.
    """
    counted = ("total", "correct", "successes", *FAILURES)
    cells = flags.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("correct"),
        F.count_if("pass_at_1_success").alias("successes"), *[F.count_if(name).alias(name) for name in FAILURES],
    )
    sums = cells.cube(*by).agg(F.grouping_id().alias("margin"), *[F.sum(name).alias(name) for name in counted])
    total = F.col("total")
    return sums.withColumns(
        {"accuracy": _share(F.col("correct"), total), "pass_at_1": _share(F.col("successes"), total)}
    )


def run_report(df: DataFrame) -> DataFrame:
    """The key metrics of a run (normalised rows) as one row from one pass."""
    return (
        passk_flags(df)
        .agg(
            *passk_aggregates(),
            *threshold_aggregates(),
            *safety_aggregates(),
            *calibration_aggregates(),
        )
        .withColumns(
            {
                "diagnosed_pct": _share(F.col("diagnosed"), F.col("total")),
                "referred_pct": _share(F.col("referred"), F.col("total")),
                "safety": safety_verdict(),
                "calibration": calibration_verdict(),
            }
        )
    )
