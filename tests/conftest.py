import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from casework.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def interpret(session, on):
    session.conf.set("spark.sql.codegen.wholeStage", str(not on).lower())
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN" if on else "FALLBACK")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")),
    )
    session.sparkContext.setLogLevel("ERROR")
    # Compiling code for a handful of rows takes longer than reading them; test_oracles turns it on again.
    interpret(session, True)
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    """A DataFrame of one text column ``x`` with an order key ``i``."""

    def make(values):
        rows = [(i, value) for i, value in enumerate(values)]
        return spark.createDataFrame(rows, "i long, x string")

    return make


@pytest.fixture
def mapped(texts):
    """Values of a column expression over a list of texts, in order."""

    def run(values, column):
        return [row[0] for row in texts(values).select(column.alias("v"), "i").orderBy("i").collect()]

    return run
