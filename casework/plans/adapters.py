"""The given test tables in the shapes that the operators read.

Every adapter is a projection over whole tables: no join, no grouping, no filter. Key arithmetic gives
each row its own lists, so that all branches of the operators occur.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casework.functions.lists import differential_items, differential_names, option_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, read as it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nation(j: int | str) -> str:
    return f"concat('NATION_', (o_orderkey * 3 + o_custkey + {j} * 7) % 25)"


def _part(i: int | str) -> str:
    return f"(o_orderkey * 7 + o_custkey * {i}) % 2200"


def _list_text(items: str) -> str:
    return f"concat('[', array_join({items}, ', '), ']')"


def case_columns() -> dict[str, Column]:
    """A case from a row of ``orders``. Lists count from 0, which is then dropped: sequence(1, 0) would
    count down."""
    numbers = "filter(sequence(0L, o_orderkey % 23), i -> i > 0)"
    ranks = "filter(sequence(0L, (o_orderkey + o_custkey) % 6), j -> j > 0)"
    plain = f"({_part('i')} + i) % 3 = 0"
    value = f"concat('_@_V_', ({_part('i')} + i) % 7 + 1)"
    code = f"concat('E_', {_part('i')}, if({plain}, '', {value}))"

    def evidences(mark: str) -> Column:
        listed = _list_text(f"transform({numbers}, i -> concat({mark}, {code}, {mark}))")
        return F.expr(f"if(o_orderkey % 43 = 42, 'n/a', {listed})")

    def differential(mark: str) -> Column:
        pair = f"concat('[', {mark}, {_nation('j')}, {mark}, ', 0.', 40 - j * 6, ']')"
        return F.expr(
            f"if(o_orderkey % 41 = 40, 'not a list', {_list_text(f'transform({ranks}, j -> {pair})')})"
        )

    one, two = "chr(39)", "chr(34)"
    return {
        "case_id": F.col("o_orderkey"),
        "split": F.expr("case o_orderkey % 10 when 0 then 'test' when 1 then 'validate' else 'train' end"),
        "AGE": F.expr("cast(o_orderkey % 90 as int)"),
        "SEX": F.expr("if(o_custkey % 2 = 0, 'M', 'F')"),
        "INITIAL_EVIDENCE": F.expr(f"if(o_orderkey % 23 > 0, concat('E_', {_part(1)}), null)"),
        "EVIDENCES": evidences(one),
        "EVIDENCES_JSON": evidences(two),
        "DIFFERENTIAL_DIAGNOSIS": differential(one),
        "DIFFERENTIAL_JSON": differential(two),
        "PATHOLOGY": F.expr(
            f"if(o_orderkey % 3 = 0, concat('NATION_', o_custkey % 25), {_nation(1)})"
        ),
    }


def response_column() -> Column:
    """A model response from a row of ``orders``, in eleven forms by key."""
    first = "o_orderkey * 37 % 101"
    sure = [first, f"({first}) div 2", f"({first}) div 4"]

    def hundredths(n: str) -> str:
        return f"concat(({n}) div 100, '.', lpad(({n}) % 100, 2, '0'))"

    ranks = ", ', ', ".join(
        f"""'{{"rank": {n}, "disease": "', {_nation(n)}, '", "confidence": ', {hundredths(sure[n - 1])}, '}}'"""
        for n in (1, 2, 3)
    )
    top = f"""concat('{{"top_3_predictions": [', {ranks}, ']')"""
    reason = f"""case when (o_orderkey * 3 + o_custkey + 7) % 25 % 5 = 0 then 'severity'
        when {first} < 40 then 'low_confidence' else 'none' end"""
    final = f"if(({reason}) = 'none', {_nation(1)}, 'Refer to specialist')"
    twice = """if(o_orderkey % 3 = 0, '"disease": "said first", ', '')"""
    quote = "if(o_orderkey % 2 = 0, '', chr(34))"
    whole = f"""concat({top}, ', "final_prediction": {{', {twice}, '"disease": "', {final}, '", "reason": "', {reason},
        '", "confidence": ', {quote}, {hundredths(first)}, {quote}, '}}}}')"""
    # The forms that hold the whole answer, as what comes before and after it.
    return F.expr(f"""case o_orderkey % 11
        when 3 then concat(if(o_orderkey % 2 = 0, '\\n', ''), 'I think it is ', {_nation(1)}, '.\\nPlease see a doctor.')
        when 4 then concat({top}, '}}')
        when 6 then null
        when 7 then concat('{{\\'final_prediction\\': {{\\'disease\\': \\'', {_nation(1)}, '\\'}}}}')
        when 8 then '[1, 2]'
        when 9 then concat({top}, ', "final_prediction": {{}}}}')
        when 10 then concat({top}, ', "final_prediction": {{"disease": null, "confidence": 0.7}}}}')
        else concat(
            case o_orderkey % 11 when 1 then 'Here it is:\\n```json\\n' when 2 then '```\\n' else '' end,
            {whole},
            case o_orderkey % 11 when 1 then '\\n```\\nTake care.' when 2 then '\\n```'
                when 5 then ' That is all.' else '' end)
        end""")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = case_columns()
    return table(spark, sf_dir, "orders").select(
        *[column.alias(name) for name, column in columns.items()]
    )


def json_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose lists are JSON."""
    return cases(spark, sf_dir).drop("EVIDENCES", "DIFFERENTIAL_DIAGNOSIS").withColumnsRenamed(
        {"EVIDENCES_JSON": "EVIDENCES", "DIFFERENTIAL_JSON": "DIFFERENTIAL_DIAGNOSIS"}
    )


def literal_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose lists are quoted singly."""
    return cases(spark, sf_dir).drop("EVIDENCES_JSON", "DIFFERENTIAL_JSON")


def printed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose lists are as Python prints them: lists, tuples, names, ``None`` and last commas by key."""
    ranks = "filter(sequence(0L, (o_orderkey + o_custkey) % 8), j -> j > 0)"
    name, one = f"concat(chr(39), {_nation('j')}, chr(39))", "', 0.'"
    item = f"""case (o_custkey + j) % 5 when 0 then concat('[', {name}, {one}, j, ']') when 1 then concat('(', {name}, {one}, j, ')')
        when 2 then {name} when 3 then 'None' else concat('[', {name}, ',]') end"""
    comma = "if(o_orderkey % 2 = 0 and (o_orderkey + o_custkey) % 8 > 0, ',', '')"
    listed = f"concat('[', array_join(transform({ranks}, j -> {item}), ', '), {comma}, ']')"
    codes = "filter(sequence(0L, o_orderkey % 7), i -> i > 0)"
    code = f"if((o_orderkey + i) % 4 = 0, 'True', concat(chr(39), 'E_', {_part('i')}, chr(39)))"
    evidences = f"concat('(', array_join(transform({codes}, i -> {code}), ', '), if(o_orderkey % 7 > 0, ',', ''), ')')"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        case_columns()["PATHOLOGY"].alias("PATHOLOGY"),
        F.expr(f"if(o_orderkey % 43 = 42, '(1', {evidences})").alias("EVIDENCES"),
        F.expr(f"if(o_orderkey % 41 = 40, '[(1]', {listed})").alias("DIFFERENTIAL_DIAGNOSIS"),
    )


def gap_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with missing labels, sexes and evidences."""
    key = F.col("case_id")
    df = literal_cases(spark, sf_dir)
    return df.withColumns(
        {
            "PATHOLOGY": F.when(key % 19 != 0, F.col("PATHOLOGY")),
            "SEX": F.when(key % 17 == 0, F.lit("")).when(key % 17 != 1, F.col("SEX")),
            "EVIDENCES": F.when(key % 23 != 0, F.col("EVIDENCES")),
            "AGE": F.when(key % 29 != 0, F.col("AGE")),
        }
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, true_diagnosis, raw_model_response)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        case_columns()["PATHOLOGY"].alias("true_diagnosis"),
        response_column().alias("raw_model_response"),
    )


def code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code dictionary from ``part``; every thirteenth entry is no object, every eleventh has no question."""
    key = F.col("p_partkey")
    question = F.when(key % 11 == 0, F.lit("")).when(
        key % 7 != 3, F.concat(F.lit("Do you have "), F.col("p_name"), F.lit("?"))
    )
    kind = (
        F.when(F.col("p_type").isin("STANDARD", "ECONOMY"), F.lit("B"))
        .when(F.col("p_type").isin("MEDIUM", "PROMO"), F.lit("C"))
        .otherwise(F.lit("M"))
    )
    meanings = F.create_map(
        *[
            part
            for n in range(1, 6)
            for part in (
                F.lit(f"V_{n}"),
                F.create_map(
                    F.lit("en"),
                    F.lit("NA") if n == 4 else F.concat(F.col("p_brand"), F.lit(f"-{n}")),
                ),
            )
        ]
    )
    plain = key % 13 == 0
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("E_"), key.cast("string")).alias("code"),
        F.when(~plain & (key % 5 != 4), F.col("p_name")).alias("name"),
        F.when(~plain, question).alias("question_en"),
        F.when(~plain, kind).alias("data_type"),
        F.when(~plain, meanings).alias("value_meaning"),
        F.when(plain, F.col("p_name")).alias("entry_text"),
    )


def code_entry_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary as (code, JSON text of the entry)."""
    codes = code_map(spark, sf_dir)
    entry = F.to_json(F.struct("name", "question_en", "data_type", "value_meaning"))
    return codes.select("code", F.coalesce("entry_text", entry).alias("entry_text"))


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as files (path, content); the content of every 29th is no UTF-8."""
    broken = F.expr("if(doc_id % 29 = 28, unhex('FF'), unhex(''))")
    return corpus(spark, sf_dir).select(
        "path", F.concat(F.col("text").cast("binary"), broken).alias("content")
    )


def severe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of one region as severe set."""
    nation = table(spark, sf_dir, "nation")
    return nation.where(F.col("n_regionkey") == 0).select(F.col("n_name").alias("disease"))


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice questions from ``documents``."""
    key = F.col("doc_id")

    def option(n: int) -> Column:
        return F.concat(F.col("source"), F.lit(f"-{n}"))

    three = [part for n, letter in enumerate("ABC") for part in (F.lit(letter), option(n))]
    four = [*three, F.lit("D"), option(3)]
    return table(spark, sf_dir, "documents").select(
        key.alias("qa_id"),
        F.when(key % 9 == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"),
        F.when(key % 31 != 30, F.col("text")).alias("question"),
        F.when(key % 17 == 0, F.create_map(*three)).otherwise(F.create_map(*four)).alias("options"),
        F.when(key % 37 != 36, F.substring(F.lit("ABCDE"), (key % 5 + 1).cast("int"), F.lit(1))).alias(
            "answer_idx"
        ),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("data/"), F.col("source"), F.lit("/"), key.cast("string"), F.lit(".txt")).alias(
            "path"
        ),
        F.col("source").alias("category"),
        F.concat(key.cast("string"), F.lit(".txt")).alias("filename"),
        "lang",
        "text",
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decided run with marks and numbers of mixed forms, from ``labels``."""
    key = F.col("doc_id")
    marks = ["✓", "✗", "true", "True", "1", " yes ", "TRUE", "1.0"]
    mark = F.lit(None).cast("string")
    for n, text in enumerate(marks):
        mark = F.when(key % 9 == n, F.lit(text)).otherwise(mark)
    sure = F.concat(F.lit("0."), F.lpad(((key * 13) % 100).cast("string"), 2, "0"))
    odd = ["NaN", "", "abc", "1d", "inf"]
    confidence = sure
    for n, text in enumerate(odd):
        confidence = F.when(key % 23 == n, F.lit(text)).otherwise(confidence)
    return table(spark, sf_dir, "labels").select(
        key.alias("case_id"),
        mark.alias("correct"),
        confidence.alias("confidence"),
        F.when(key % 7 != 6, (key % 6).cast("string")).alias("num_options"),
        F.when(F.col("quality") == 1, F.lit(" refer ")).otherwise(F.lit("DIAGNOSE")).alias("action"),
        F.col("toxic").cast("string").alias("is_severe"),
        F.when(key % 2 == 0, F.lit("True")).otherwise(F.lit("False")).alias("high_confidence"),
        F.when(key % 4 == 0, F.lit("severity"))
        .when(key % 4 != 3, F.lit("low_confidence"))
        .alias("refer_reason"),
    )


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run as the decision layer reads it: (case_id, case_num, true_diagnosis, diagnosis_options,
    raw_model_response)."""
    columns = case_columns()
    rows = table(spark, sf_dir, "orders").select(
        columns["case_id"].alias("case_id"),
        (columns["case_id"] + 1).alias("case_num"),
        columns["PATHOLOGY"].alias("true_diagnosis"),
        columns["DIFFERENTIAL_DIAGNOSIS"].alias("_cell"),
        response_column().alias("raw_model_response"),
    )
    names = differential_names(differential_items(F.col("_cell"), "literal"), F.col("true_diagnosis"))
    return rows.withColumn("diagnosis_options", option_text(names)).drop("_cell")
