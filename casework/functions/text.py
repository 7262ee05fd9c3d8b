"""Text helpers with the Unicode whitespace of the source data, as Column expressions."""

from pyspark.sql import Column, functions as F

# The characters that count as whitespace, as a set and as a regex class body.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# What reads as a number; Spark's cast alone would also take endings such as the d of 1d.
NUMBER = rf"^[{WS}]*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf(?:inity)?))[{WS}]*$"


def strip(c: Column) -> Column:
    """Whitespace removed at both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """True for text of nothing but whitespace; NULL stays NULL."""
    return ~c.rlike(f"[^{WS}]")


def word_count(c: Column) -> Column:
    """Number of runs of non-whitespace. With one kind of blank the regex stays cheap."""
    blanks = F.translate(c, WHITESPACE, " " * len(WHITESPACE))
    return F.regexp_count(blanks, F.lit("[^ ]+"))


def line_count(c: Column) -> Column:
    """Number of lines that are not blank."""
    return F.regexp_count(c, F.lit(f"[^{WS}][^\n]*"))


def first_line(c: Column) -> Column:
    """The first line, stripped."""
    return strip(F.substring_index(c, "\n", 1))


def to_number(c: Column) -> Column:
    """Text or number to double; what is no number, and NaN, becomes NULL."""
    text = c.cast("string")
    value = F.when(text.rlike(NUMBER), strip(text).try_cast("double"))
    return F.when(~F.isnan(value), value)


def substring_occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of ``term`` in ``text``."""
    if not term:
        raise ValueError("a term must not be empty")
    rest = F.replace(text, F.lit(term), F.lit(""))
    return ((F.length(text) - F.length(rest)) / F.lit(len(term))).cast("long")


def fill(template: str, **values: Column) -> Column:
    """``template`` with each ``{field}`` replaced by the text of a column; NULL prints as None."""
    pieces, rest = [], template
    while rest:
        spots = {name: rest.find("{" + name + "}") for name in values}
        spots = {name: at for name, at in spots.items() if at >= 0}
        if not spots:
            break
        name = min(spots, key=spots.get)
        pieces.append(F.lit(rest[: spots[name]]))
        pieces.append(F.coalesce(values[name].cast("string"), F.lit("None")))
        rest = rest[spots[name] + len(name) + 2 :]
    return F.concat(*pieces, F.lit(rest))
