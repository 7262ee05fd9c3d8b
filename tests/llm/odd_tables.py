"""Tables with the cases that every operator has to stand: nulls, empty and long texts, repeats, extra columns."""

import pytest

from casework.session import let_workers_import


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    let_workers_import(spark)


@pytest.fixture(scope="session")
def odd_texts(spark):
    long = "Lorem ipsum dolor sit amet. " * 4000
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "word"), (5, "word"), (6, long), (7, long + "x"), (None, "a b"),
        (None, None), (8, "é日本 ñ \U0001f600 <|endoftext|> it's 12²"), (9, "a" * 5000),
    ]
    data = [(i, t, "en", None if n % 2 else "s", 0, 0.5, "x", n) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(
        data,
        "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, mix_slot int",
    )


@pytest.fixture(scope="session")
def no_docs(odd_texts):
    return odd_texts.limit(0)


def by_id(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
