"""Strict reading of JSON text with Spark's own JSON reader.

``from_json`` accepts text after the value, so text that closes a wrapper early would pass for a value. The
wrapper used here ends in a mark, the hash of the text, which must be there after the value.
"""

from pyspark.sql import Column, functions as F

STRICT = {"allowSingleQuotes": "false"}
LENIENT = {"allowSingleQuotes": "true"}


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _single(c: Column, kind: str, options: dict, body) -> Column:
    """``body(value)`` where ``c`` is exactly one JSON value, else NULL."""
    mark = F.xxhash64(c).cast("string")
    wrapped = F.concat(F.lit('[{"v":'), c, F.lit('},{"'), mark, F.lit('":null}]'))
    read = F.struct(
        F.from_json(wrapped, f"array<map<string,{kind}>>", options).alias("parts"), mark.alias("mark")
    )

    def checked(r: Column) -> Column:
        value, end = F.get(r["parts"], F.lit(0)), F.get(r["parts"], F.lit(1))
        whole = (F.size(r["parts"]) == 2) & (F.size(value) == 1) & F.array_contains(F.map_keys(end), r["mark"])
        return F.when(whole, body(F.try_element_at(value, F.lit("v"))))

    return bind(read, checked)


def strict_json(c: Column) -> Column:
    """The value as compact JSON text, or NULL where ``c`` is not exactly one JSON value.

    Text values come without their quotes and a JSON null as the text ``null``.
    """
    return _single(c, "string", STRICT, lambda value: F.coalesce(value, F.lit("null")))


def one_list(c: Column, options: dict, items: str = "string") -> Column:
    """``c`` as an array where it is exactly one list, else NULL.

    As ``string`` items, lists and objects inside arrive as JSON text.
    """
    return _single(c, f"array<{items}>", options, lambda value: value)


def object_or_null(c: Column, kind: str) -> Column:
    """JSON text of an object read as ``kind``; anything else is NULL."""
    return F.when(c.startswith("{"), F.from_json(c, kind, STRICT))
