"""Dataset profiles (Q1-Q20)."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from casework import fixed_values as fixed
from casework.functions.lists import normalise_evidence
from casework.functions.text import is_blank, strip, substring_occurrences, word_count
from casework.operators.dimension import join_groups
from casework.operators.quantiles import exact_quantiles
from casework.operators.ranking import first_rows, quantile, ranked_values
from casework.operators.totals import totals
from casework.session import checkpoint


def _falsy(c: Column) -> Column:
    return F.coalesce(c == "", F.lit(True))


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    """Q1: rows, rows in all and percentage per split."""
    sizes = df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"))
    total = totals(sizes, total=F.sum("rows"))["total"]
    return sizes.withColumn("total", total).withColumn(
        "share_pct", F.col("rows") / F.col("total") * 100
    )


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.ArrayType):
        return "list"
    if isinstance(data_type, (T.MapType, T.StructType)):
        return "dict"
    return {"string": "str", "double": "float", "float": "float", "boolean": "bool"}.get(
        data_type.simpleString(), "int" if isinstance(data_type, T.IntegralType) else data_type.simpleString()
    )


def field_profile(df: DataFrame, order_key: str) -> DataFrame:
    """Q2: type of each field, and list length and first three map keys in the first row."""
    cells = []
    for field in df.schema:
        length, keys = F.lit(None).cast("int"), F.lit(None).cast("string")
        if isinstance(field.dataType, T.ArrayType):
            length = F.size(field.name)
        if isinstance(field.dataType, T.MapType):
            keys = F.array_join(F.slice(F.map_keys(field.name), 1, 3), ", ")
        if isinstance(field.dataType, T.StructType):
            keys = F.lit(", ".join(field.dataType.names[:3]))
        cells.append(
            F.struct(
                F.lit(field.name).alias("field"),
                F.lit(_kind(field.dataType)).alias("type"),
                length.alias("length"),
                keys.alias("keys"),
            )
        )
    first = df.agg(F.min_by(F.struct("*"), order_key).alias("_row")).where("_row is not null").select("_row.*")
    return first.select(F.explode(F.array(*cells)).alias("f")).select("f.*")


def frequencies(df: DataFrame, column: str, order_key: str) -> DataFrame:
    """Rows and first appearance per value."""
    return df.groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.min(order_key).alias("_first")
    )


def value_counts(df: DataFrame, column: str, order_key: str, k: int | None = None) -> DataFrame:
    """Q3: values by falling count, ties by first appearance, with share of all rows and the number of
    distinct values; the first ``k`` of them if given."""
    counts = frequencies(df, column, order_key)
    whole = totals(counts, total=F.sum("n"), distinct_values=F.count(F.lit(1)))
    shares = counts.withColumn("_whole", whole).select(
        "value",
        "n",
        (F.col("n") / F.col("_whole.total") * 100).alias("share_pct"),
        F.col("_whole.distinct_values").alias("distinct_values"),
        "_first",
    )
    ranked = shares.orderBy(F.desc("n"), "_first")
    return (ranked if k is None else ranked.limit(k)).drop("_first")


def balance_top(df: DataFrame, column: str, limit_pct: float = 10.0) -> DataFrame:
    """Share of the most common value, and whether it stays below ``limit_pct``."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    share = counts.agg((F.max("n") / F.sum("n") * 100).alias("top_share_pct"))
    return share.withColumn("balanced", F.col("top_share_pct") < limit_pct)


def _answer_counts(df: DataFrame, column: str, domain, by: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(column) == answer).alias(f"_{answer}") for answer in domain],
    )


def answer_distribution(
    df: DataFrame, column: str = "answer_idx", domain=fixed.ANSWERS, by: str = "split"
) -> DataFrame:
    """Q10: rows and percentage per answer and split; answers that do not occur count 0."""
    cells = F.array(
        *[F.struct(F.lit(a).alias("answer"), F.col(f"_{a}").alias("n")) for a in domain]
    )
    rows = _answer_counts(df, column, domain, by).select(by, "total", F.explode(cells).alias("a"))
    return rows.select(by, "a.answer", "a.n", (F.col("a.n") / F.col("total") * 100).alias("share_pct"))


def balance_band(
    df: DataFrame, column: str = "answer_idx", domain=fixed.ANSWERS, by: str = "split",
    low: float = 20.0, high: float = 30.0,
) -> DataFrame:
    """Whether the share of every answer is from ``low`` to ``high`` percent, per split."""
    shares = answer_distribution(df, column, domain, by)
    return shares.groupBy(by).agg(
        F.bool_and(F.col("share_pct").between(low, high)).alias("balanced")
    )


def evidence_counts(
    df: DataFrame, column: str, order_key: str, k: int | None = 20, n: int | None = None
) -> DataFrame:
    """Q5: ``value_counts`` over a text or list column of evidences, of all rows or the first ``n``."""
    rows = df.select(order_key, normalise_evidence(df, column).alias("_list"))
    if n is not None:
        rows = first_rows(rows, n, [order_key])
    # The outer form keeps Spark from testing the list, and so parsing it, once more before the explode.
    items = rows.select(order_key, F.posexplode_outer("_list").alias("_pos", "_item"))
    # First appearance is the case, then the place in its list.
    items = items.where(F.col("_pos").isNotNull()).withColumn("_at", F.struct(order_key, "_pos"))
    return value_counts(items, "_item", "_at", k)


def numeric_stats(
    df: DataFrame, column: str, by: list[str] = (), approx: bool = False
) -> DataFrame:
    """Q6: mean, median, smallest and largest value, NULLs left out. The exact median is counted between the
    bounds that a sketch gives it; ``approx`` takes Spark's sketch in one pass."""
    by = list(by)
    if approx:
        return df.groupBy(*by).agg(
            F.avg(column).alias("mean"),
            F.percentile_approx(column, 0.5).cast("double").alias("median"),
            F.min(column).alias("min"),
            F.max(column).alias("max"),
        )
    simple = [F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max")]
    found = exact_quantiles(df.select(*by, column), column, by, {"median": 0.5}, simple)
    found = found.select(*by, "mean", "median", "min", "max")
    if by:
        return found
    # One row for the whole, also where there is nothing in it.
    return found.agg(*[F.first(c).alias(c) for c in found.columns])


def category_share(df: DataFrame, column: str, denominator: str = "all") -> DataFrame:
    """Q7: rows and percentage per non-empty value, of all rows or of the shown ones."""
    shown = ~_falsy(F.col(column).cast("string"))
    counts = df.groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(shown).alias("_shown")
    )
    if denominator not in ("all", "shown"):
        raise ValueError(f"unknown denominator {denominator!r}")
    base = totals(counts, base=F.sum("n" if denominator == "all" else "_shown"))["base"]
    return counts.where(F.col("_shown") > 0).select(
        "value", "n", (F.col("n") / base * 100).alias("share_pct")
    )


def completeness(
    df: DataFrame, label: str = "PATHOLOGY", evidence=("INITIAL_EVIDENCE", "EVIDENCES")
) -> DataFrame:
    """Q8: rows without a label, rows without any evidence, complete rows and a grade.

    ``complete_reference`` takes a row that lacks both off twice; ``complete_exact`` does not.
    """
    no_label = _falsy(F.col(label))
    no_evidence = reduce(lambda a, b: a & b, [_falsy(F.col(name)) for name in evidence])
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(no_label).alias("missing_label"),
        F.count_if(no_evidence).alias("missing_evidence"),
        F.count_if(~no_label & ~no_evidence).alias("complete_exact"),
    )
    total, lost = F.col("total"), F.col("missing_label") + F.col("missing_evidence")
    return counts.withColumns(
        {
            "complete_reference": total - lost,
            "complete_pct": F.when(total > 0, (total - lost) / total * 100),
            "grade": F.when(lost == 0, F.lit("EXCELLENT")).otherwise(F.lit("GOOD")),
        }
    )


def qa_checklist(
    qa: DataFrame, required=("train", "test"), order_key: str = "qa_id", every_row: bool = False
) -> DataFrame:
    """Q9: (check, passed) of a loaded question table, and ``all``. The option check looks at the first
    training row; ``every_row`` adds one that looks at all of them."""
    has_fields = all(name in qa.columns for name in fixed.QA_FIELDS)
    train = F.col("split") == "train"
    found = qa.agg(
        F.collect_set(F.when(F.col("split").isin(list(required)), F.col("split"))).alias("_splits"),
        F.min_by(F.size("options"), F.when(train, F.col(order_key))).alias("_options")
        if "options" in qa.columns
        else F.lit(None).cast("int").alias("_options"),
        F.bool_and(F.when(train, F.coalesce(F.size("options") == 4, F.lit(False)))).alias("_every")
        if "options" in qa.columns
        else F.lit(False).alias("_every"),
    )
    there = F.size("_splits") == len(required)
    checks = {
        "required_splits": there,
        "splits_not_empty": there,
        "required_fields": F.lit(has_fields),
        "four_options": F.coalesce(F.col("_options") == 4, F.lit(False)),
    }
    if every_row:
        checks["four_options_every_row"] = F.coalesce("_every", F.lit(False))
    checks["all"] = reduce(lambda a, b: a & b, checks.values())
    cells = F.array(
        *[F.struct(F.lit(name).alias("check"), ok.alias("passed")) for name, ok in checks.items()]
    )
    return found.select(F.explode(cells).alias("c")).select("c.*")


def _measured(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """One row per group, measure (words, chars) and length, counted; the text is read once."""
    lengths = df.select(
        *by, word_count(F.col(column)).alias("_words"), F.length(column).alias("_chars")
    )
    both = F.array(
        F.struct(F.lit("words").alias("measure"), F.col("_words").cast("long").alias("length")),
        F.struct(F.lit("chars").alias("measure"), F.col("_chars").cast("long").alias("length")),
    )
    tall = lengths.select(*by, F.explode(both).alias("m")).select(*by, "m.measure", "m.length")
    return ranked_values(tall, "length", [*by, "measure"])


def length_stats(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """Q11: mean, median, smallest, largest, population standard deviation and total of the text length,
    in words and in characters. Sums are exact integers."""
    by = list(by)
    v, n = F.col("length").cast("decimal(38,0)"), F.col("n").cast("decimal(38,0)")
    stats = _measured(df, column, by).groupBy(*by, "measure").agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("length") * F.col("n")).alias("total_length"),
        F.sum((v * v * n).cast("decimal(38,0)")).cast("decimal(38,0)").alias("_squares"),
        quantile("length", 0.5).alias("median"),
        F.min("length").alias("min"),
        F.max("length").alias("max"),
    )
    mean = F.col("total_length") / F.col("rows")
    rows, total = F.col("rows").cast("decimal(20,0)"), F.col("total_length").cast("decimal(38,0)")
    spread = (F.col("_squares") * rows).cast("decimal(38,0)") - (total * total).cast("decimal(38,0)")
    variance = spread.cast("double") / F.col("rows") / F.col("rows")
    return stats.select(
        *by,
        "measure",
        "rows",
        "total_length",
        mean.alias("mean"),
        "median",
        "min",
        "max",
        F.sqrt(variance).alias("std"),
    )


def length_bands(
    df: DataFrame, column: str, bands=fixed.QA_BANDS, by: list[str] = ()
) -> DataFrame:
    """Q12: rows and percentage per band of word counts (lower ends belong to a band); empty bands show 0."""
    by = list(by)
    cuts, labels = bands
    band = F.lit(labels[-1])
    for cut, label in reversed(list(zip(cuts, labels))):
        band = F.when(F.col("_words") < cut, F.lit(label)).otherwise(band)
    words = df.select(*by, F.coalesce(word_count(F.col(column)), F.lit(0)).alias("_words"))
    labelled = words.select(*by, band.alias("_band"))
    counts = labelled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(F.col("_band") == label).alias(f"_{label}") for label in labels],
    )
    cells = F.array(
        *[F.struct(F.lit(label).alias("band"), F.col(f"_{label}").alias("n")) for label in labels]
    )
    share = F.when(F.col("_total") > 0, F.col("b.n") / F.col("_total") * 100)
    return counts.select(*by, "_total", F.explode(cells).alias("b")).select(
        *by, "b.band", "b.n", share.alias("share_pct")
    )


def _fingerprint(column: str) -> Column:
    """A short stand-in for a long text; NULL stays apart from every text."""
    return F.coalesce(F.sha2(F.col(column), 256), F.lit("null"))


def duplicate_count(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """Q14: rows, unique values and duplicates; NULL counts as one value. Hashes are shuffled, not texts."""
    by = list(by)
    marks = df.select(*by, _fingerprint(column).alias("_mark"))
    seen = marks.groupBy(*by, "_mark").agg(F.count(F.lit(1)).alias("_n"))
    return seen.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("unique_values"),
        F.coalesce(F.sum("_n") - F.count(F.lit(1)), F.lit(0)).alias("duplicates"),
    )


def qa_quality(qa: DataFrame, by: str = "split") -> DataFrame:
    """Q13: missing questions and answers, duplicates, wrong option counts, invalid answers, the issues
    found and a verdict, per split. Rows are summed per question hash first, so the text is read once
    and a repeated question is one row in the second step."""
    question = F.col("question")
    per_question = qa.groupBy(by, _fingerprint("question").alias("_mark")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.coalesce(is_blank(question), F.lit(True))).alias("_question"),
        F.count_if(_falsy(F.col("answer_idx"))).alias("_answer"),
        F.count_if(F.coalesce(F.size("options") != 4, F.lit(True))).alias("_options"),
        F.count_if(
            F.coalesce(~F.col("answer_idx").isin(list(fixed.ANSWERS)), F.lit(True))
        ).alias("_invalid"),
    )
    counts = per_question.groupBy(by).agg(
        F.sum("_n").alias("rows"),
        F.sum("_question").alias("missing_questions"),
        F.sum("_answer").alias("missing_answers"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_questions"),
        F.sum("_options").alias("incomplete_options"),
        F.sum("_invalid").alias("invalid_answers"),
    )
    issues = F.array_compact(
        F.array(
            F.when(F.col("missing_questions") + F.col("missing_answers") > 0, F.lit("missing data")),
            F.when(
                F.col("duplicate_questions") > 0,
                F.concat(F.col("duplicate_questions").cast("string"), F.lit(" duplicate questions")),
            ),
            F.when(F.col("incomplete_options") > 0, F.lit("incomplete options")),
            F.when(F.col("invalid_answers") > 0, F.lit("invalid answers")),
        )
    )
    return counts.withColumn("issues", F.array_join(issues, "; ")).withColumn(
        "passed", F.col("issues") == ""
    )


def term_counts(
    df: DataFrame, column: str, terms=fixed.CORPUS_TERMS, n: int | None = None,
    order_key: str | None = None, k: int | None = None,
) -> DataFrame:
    """Q15: occurrences of each term (case-folded, also inside words) and the average per document, by
    falling count, ties in list order; of all documents or the first ``n``. One pass for all terms."""
    if n is not None:
        df = first_rows(df.select(order_key, column), n, [order_key])
    folded = df.select(F.lower(column).alias("_text"))
    found = folded.agg(
        F.count(F.lit(1)).alias("_docs"),
        *[
            F.coalesce(F.sum(substring_occurrences(F.col("_text"), term)), F.lit(0)).alias(f"_t{i}")
            for i, term in enumerate(terms)
        ],
    )
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(term).alias("term"), F.col(f"_t{i}").alias("n"))
            for i, term in enumerate(terms)
        ]
    )
    rows = found.select("_docs", F.explode(cells).alias("t")).orderBy(F.desc("t.n"), "t.i")
    if k is not None:
        rows = rows.limit(k)
    average = F.when(F.col("_docs") > 0, F.col("t.n") / F.col("_docs"))
    return rows.select("t.term", "t.n", average.alias("per_document"))


def corpus_quality(
    df: DataFrame, column: str, terms=fixed.CORPUS_TERMS[:5], n: int | None = None,
    order_key: str | None = None,
) -> DataFrame:
    """Q16: blank texts, texts below 100 words, texts with any of the terms, and a grade. The term check
    covers all documents, or the first ``n``."""
    folded = F.lower(F.col(column))
    has_term = reduce(lambda a, b: a | b, [folded.contains(term) for term in terms])
    basics = [
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.coalesce(is_blank(F.col(column)), F.lit(True))).alias("empty"),
        F.count_if(F.coalesce(word_count(F.col(column)) < 100, F.lit(True))).alias("very_short"),
    ]
    terms_found = F.count_if(has_term)
    if n is None:
        counts = df.agg(*basics, terms_found.alias("with_terms"), F.count(F.lit(1)).alias("checked"))
    else:
        sample = first_rows(df.select(order_key, column), n, [order_key]).agg(
            F.struct(terms_found.alias("found"), F.count(F.lit(1)).alias("of"))
        )
        counts = df.agg(*basics).withColumn("_s", sample.scalar()).select(
            "documents", "empty", "very_short",
            F.col("_s.found").alias("with_terms"), F.col("_s.of").alias("checked"),
        )
    good = (F.col("empty") < F.col("documents") * F.lit(0.01)) & (
        F.col("with_terms") > F.col("checked") * F.lit(0.8)
    )
    return counts.withColumns(
        {
            "with_terms_pct": F.when(F.col("checked") > 0, F.col("with_terms") / F.col("checked") * 100),
            "grade": F.when(good, F.lit("EXCELLENT")).otherwise(F.lit("GOOD")),
        }
    )


def histogram(df: DataFrame, column: str, bins: int, by: list[str] = ()) -> DataFrame:
    """Q17: equal-width bins over the range of each group, the last one closed; empty bins show 0.

    One pass finds the ranges, the next counts per bin before anything moves, so that what is shuffled has one
    row for each bin and task.
    """
    by = list(by)
    values = df.select(*by, F.col(column).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    edges = values.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    edges = edges.select(
        *by,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    if by:
        ranged = join_groups(values, edges, by)
    else:
        ends = edges.select(F.struct("_lo", "_hi").alias("_e")).scalar()
        ranged = values.withColumn("_e", ends).select("_v", "_e.*")
    width = F.col("_hi") - F.col("_lo")
    place = F.least(F.floor((F.col("_v") - F.col("_lo")) * bins / width) + 1, F.lit(bins))
    counts = (
        ranged.groupBy(*by, place.cast("int").alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_lo").alias("_lo"), F.min("_hi").alias("_hi"))
        .groupBy(*by)
        .agg(
            F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_counts"),
            F.first("_lo").alias("_lo"),
            F.first("_hi").alias("_hi"),
        )
    )
    step = (F.col("_hi") - F.col("_lo")) / bins
    return counts.select(
        *by, "_counts", "_lo", step.alias("_step"), F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")
    ).select(
        *by,
        "bin",
        (F.col("_lo") + (F.col("bin") - 1) * F.col("_step")).alias("bin_start"),
        (F.col("_lo") + F.col("bin") * F.col("_step")).alias("bin_end"),
        F.coalesce(F.try_element_at("_counts", F.col("bin")), F.lit(0)).alias("n"),
    )


def box_summary(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Q18: quartiles, whiskers at the furthest value within 1.5 times the box, and the number of values
    beyond them, per group."""
    by = list(by)
    values = df.select(*by, column).where(F.col(column).isNotNull())
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    quartiles = exact_quantiles(values, column, by, shares).drop("total")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    v = F.col(column)
    low_side = v >= F.col("q1") - reach
    high_side = v <= F.col("q3") + reach
    boxed = join_groups(values, checkpoint(quartiles), by)
    return boxed.groupBy(*by, "q1", "median", "q3").agg(
        F.least(F.min(F.when(low_side, v)), F.col("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(high_side, v)), F.col("q3")).alias("whisker_high"),
        F.count_if(~low_side | ~high_side).alias("outliers"),
        F.count(F.lit(1)).alias("rows"),
    )


def load_rates(docs: DataFrame, failures: DataFrame, catalog: DataFrame) -> DataFrame:
    """Q19: files loaded, failed and listed, success rate and coverage. Blank files are in neither side."""
    loaded = docs.agg(
        F.count(F.lit(1)).alias("loaded"), F.count_distinct("category").alias("categories")
    )
    listed = catalog.agg(
        F.struct(F.count(F.lit(1)).alias("paths"), F.count_distinct("category").alias("categories"))
    ).scalar()
    df = loaded.withColumn("failed", failures.agg(F.count(F.lit(1))).scalar()).withColumn("_l", listed)
    tried = F.col("loaded") + F.col("failed")
    return df.select(
        "loaded",
        "failed",
        F.col("_l.paths").alias("listed"),
        F.when(tried > 0, F.col("loaded") / tried * 100).alias("success_pct"),
        F.when(F.col("_l.paths") > 0, F.col("loaded") / F.col("_l.paths") * 100).alias("coverage_pct"),
        "categories",
        F.col("_l.categories").alias("categories_listed"),
    )


def dataset_info(
    df: DataFrame, source: str, text: str = "question", order_key: str = "qa_id", split: str = "split"
) -> DataFrame:
    """Q20: one row with the source, rows per split, rows in all, fields and length of the first text."""
    sizes = df.groupBy(split).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(word_count(F.col(text)), F.col(order_key)).alias("_words"),
    )
    fields = [name for name in df.columns if name != split]
    return sizes.agg(
        F.map_from_entries(F.collect_list(F.struct(split, "_n"))).alias("splits"),
        F.sum("_n").alias("total_examples"),
        F.max(F.when(F.col(split) == "train", F.col("_words"))).alias("sample_question_length"),
    ).select(
        F.lit(source).alias("source"),
        "splits",
        "total_examples",
        F.array(*[F.lit(name) for name in fields]).alias("fields"),
        "sample_question_length",
    )
