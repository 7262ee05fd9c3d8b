"""List and differential cells (D1-D5, D4c, D9, D13) as Column expressions.

Lists of strings or of lists, the usual forms, are read as JSON with single quotes allowed; cells with tuples,
``None``, ``True`` or a trailing comma, whose items have to be told apart by kind, go through ``python_text``.
"""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from casework.functions.json_text import LENIENT, STRICT, bind, one_list
from casework.functions.python_text import list_parts, printed, python_items, scalar_text, tuple_parts

ITEMS = "array<struct<is_list:boolean,is_text:boolean,parts:array<string>>>"
# What may stand before or after a comma in a list of quoted strings only; commas inside strings are no harm.
_OTHER_SCALARS = r"(?:^\s*+\[|,)\s*+[^\s'\"\[\],]"


def parse_list(c: Column, mode: str) -> Column:
    """D1-D3. ``json``: failure gives an empty list. ``literal``: single or double quotes, failure gives
    NULL. ``safe``: like literal, failure gives a list of the text itself. Items of a printed list that are
    no strings come as Python prints them."""
    if mode == "json":
        return F.coalesce(one_list(c, STRICT), F.array().cast("array<string>"))
    if mode == "literal":
        quick = F.when(~c.rlike(_OTHER_SCALARS), one_list(c, LENIENT))
        return F.coalesce(quick, F.transform(python_items(c), printed))
    if mode == "safe":
        return F.coalesce(parse_list(c, "literal"), F.array(F.coalesce(c, F.lit("None"))))
    raise ValueError(f"unknown mode {mode!r}")


def list_column(df: DataFrame, name: str, mode: str) -> Column:
    """``parse_list`` of a text column; a list column passes through."""
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.col(name)
    return parse_list(F.col(name), mode)


def parse_error(parsed: Column, source: Column) -> Column:
    """Text for a cell that could not be read in ``literal`` mode."""
    return F.when(parsed.isNull() & source.isNotNull(), F.lit("not a list"))


def differential_items(c: Column, mode: str) -> Column:
    """A differential cell as ``array<struct<is_list,is_text,parts>>``, read as in ``parse_list``.

    Cells that hold only lists, the usual form, are read in one go; only others are read item by item. Tuples are
    neither lists nor texts; other scalars are no texts.
    """
    options = STRICT if mode == "json" else LENIENT
    only_lists = bind(
        one_list(c, options, "array<string>"),
        lambda nested: F.when(
            ~F.exists(nested, lambda parts: parts.isNull()),
            F.transform(nested, lambda parts: _item(parts, is_list=True)),
        ),
    )
    if mode == "json":
        return F.coalesce(only_lists, F.transform(parse_list(c, mode), _json_item))
    read = F.coalesce(only_lists, F.transform(python_items(c), _python_item))
    if mode == "safe":
        return F.coalesce(read, F.array(_item(F.array(F.coalesce(c, F.lit("None"))), is_text=True)))
    return read


def _item(parts: Column, is_list: bool = False, is_text: bool | Column = False) -> Column:
    is_text = F.lit(is_text) if isinstance(is_text, bool) else is_text
    return F.struct(F.lit(is_list).alias("is_list"), is_text.alias("is_text"), parts.alias("parts"))


def _json_item(item: Column) -> Column:
    inner = F.when(item.startswith("["), F.from_json(item, "array<string>", STRICT))
    return bind(
        inner,
        lambda parts: F.when(parts.isNotNull(), _item(parts, is_list=True)).otherwise(_item(F.array(item), is_text=True)),
    )


def _python_item(item: Column) -> Column:
    """An item of ``python_items``; an empty tuple has its print as its only part."""
    in_list, in_tuple = list_parts(item), tuple_parts(item)
    first = F.when(F.size(in_tuple) > 0, F.transform(in_tuple, scalar_text)).otherwise(F.array(F.lit("()")))
    return (
        F.when(item.startswith("["), _item(F.transform(in_list, scalar_text), is_list=True))
        .when(item.startswith('{"t":['), _item(first))
        .otherwise(_item(F.array(scalar_text(item)), is_text=item.startswith('{"s":')))
    )


def _first(item: Column) -> Column:
    return F.get(item["parts"], F.lit(0))


def differential_pairs(items: Column) -> Column:
    """D4a on parsed items: ``array<struct<disease,probability>>``; a bare name has no probability."""
    return F.transform(
        items,
        lambda item: F.struct(
            _first(item).alias("disease"),
            F.get(item["parts"], F.lit(1)).try_cast("double").alias("probability"),
        ),
    )


def parse_differential(c: Column, mode: str = "json") -> Column:
    """A differential cell as pairs; failure gives an empty list in ``json`` mode."""
    return differential_pairs(differential_items(c, mode))


def listed_names(items: Column) -> Column:
    """The first entry of the items that are lists; other items are dropped."""
    return F.transform(F.filter(items, lambda item: item["is_list"]), _first)


def differential_names(items: Column, truth: Column) -> Column:
    """D4b on items read in ``literal`` mode: lists of two or more give their first entry, bare names
    themselves, other items (tuples too) are dropped, the truth is appended if absent. NULL items give ``[truth]``."""
    kept = F.filter(items, lambda item: item["is_text"] | (item["is_list"] & (F.size(item["parts"]) >= 2)))
    return bind(
        F.transform(F.coalesce(kept, F.array().cast(ITEMS)), _first),
        lambda names: F.when(
            F.coalesce(F.array_contains(names, truth), F.lit(False)), names
        ).otherwise(F.concat(names, F.array(truth))),
    )


def clean_differential(c: Column) -> Column:
    """The first entry of each non-empty list or tuple, else the item's own text; never fails."""
    return F.transform(
        differential_items(c, "safe"), lambda item: F.coalesce(_first(item), F.lit("[]"))
    )


def top_differential(pairs: Column, k: int, decimals: int = 2) -> Column:
    """The first ``k`` entries with the probability also as a percentage text (rounded half up)."""
    return F.transform(
        F.slice(pairs, 1, k),
        lambda p: F.struct(
            p["disease"].alias("disease"),
            p["probability"].alias("probability"),
            F.when(
                p["probability"].isNotNull(),
                F.format_string(f"%.{decimals}f%%", p["probability"] * 100),
            ).alias("probability_text"),
        ),
    )


def option_text(names: Column) -> Column:
    """Numbered options, one per line."""
    lines = F.transform(
        names, lambda name, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(name, F.lit("None")))
    )
    return F.array_join(lines, "\n")


def normalise_evidence(df: DataFrame, name: str) -> Column:
    """A text or list column as a list; NULL gives an empty list."""
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.coalesce(F.col(name), F.array().cast("array<string>"))
    return F.when(F.col(name).isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col(name)))
