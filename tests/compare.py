"""Run a query and its SQL on the same tables and compare names, types and values."""

import math
from datetime import date

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, date)):
        return value
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def differences(df, con, sql):
    """An empty list when the two results agree."""
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    kinds = {column[0]: str(column[1]) for column in result.description}
    theirs = [tuple(_cell(v) for v in row) for row in result.fetchall()]
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    order = sorted(names)
    places = [names.index(name) for name in order]
    theirs = sorted((tuple(row[p] for p in places) for row in theirs), key=repr)
    ours = sorted((tuple(_cell(v) for v in row) for row in df.select(*order).collect()), key=repr)
    found = []
    for field in df.schema:
        kind = TYPES.get(field.dataType.simpleString(), field.dataType.simpleString())
        if kind != kinds[field.name]:
            found.append(f"type of {field.name}: {kind} and {kinds[field.name]}")
    if len(ours) != len(theirs):
        found.append(f"{len(ours)} and {len(theirs)} rows")
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first: {wrong[0]}")
    return found
