r"""Lists printed by Python, rewritten to JSON with Spark's own expressions.

The cell is cut into signs: whole quoted strings, brackets, commas, bare words, white space. A quoted string is
one sign, so nothing inside it is taken for a bracket or a comma. Each sign becomes its JSON: a string is an object
``{"s": text}``, any other scalar ``{"o": spelling}``, a tuple ``{"t": [...]}`` and a list a JSON array, so JSON's
own rules tell whether brackets match and commas are where they should be. Commas before a closing bracket
go. Not read, as ever NULL: sets, dictionaries, prefixed, joined and triple-quoted strings, octal and named escapes.
"""

from pyspark.sql import Column, functions as F

from casework.functions.json_text import STRICT, bind, one_list

# Possessive loops: the regex engine keeps no state per character.
_QUOTED = r"{q}[^{q}\\\n\r]*+(?:\\[\s\S][^{q}\\\n\r]*+)*+{q}"
_SIGN = "|".join([_QUOTED.format(q="'"), _QUOTED.format(q='"'), r"[\[\](),]", r"[A-Za-z0-9_.+\-]++", r"[ \t\n\r\f]++", r"[\s\S]"])
_ESCAPE = r"\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\\r\n|\\[\s\S]|[^\\]++"
_NUMBER = r"^[+-]?(?:(?:0|[1-9][0-9]*)|(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+)$"
SCALAR = "s string, o string"

# Escapes of one character that Python and JSON spell alike, and those that JSON spells by number.
_ALIKE = ("\\n", "\\t", "\\r", "\\b", "\\f", "\\\\", '\\"')
_BY_NUMBER = {"\\a": "\\u0007", "\\v": "\\u000b"}


def _plain(text: Column) -> Column:
    """A part of a string without escapes, as in a JSON string."""
    for raw, escaped in (('"', '\\"'), ("\t", "\\t"), ("\f", "\\f"), ("\b", "\\b")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.regexp_replace(text, r"[\x00-\x1f]", "")  # none of these is printed by Python


def _escaped(part: Column) -> Column:
    """One escape as in a JSON string; NULL for octal and named ones. An unknown one keeps its backslash."""
    second = F.substring(part, 2, 1)
    out = F.when(part == "\\'", F.lit("'")).when(part.isin(*_ALIKE), part)
    for python, js in _BY_NUMBER.items():
        out = out.when(part == python, F.lit(js))
    out = out.when(second.isin("\n", "\r"), F.lit(""))  # a string that goes on in the next line
    out = out.when(part.startswith("\\x") & (F.length(part) == 4), F.concat(F.lit("\\u00"), F.substring(part, 3, 2)))
    out = out.when(part.startswith("\\u") & (F.length(part) == 6), part)
    return out.when(second.rlike("[0-7xuUN]"), F.lit(None)).otherwise(F.concat(F.lit("\\\\"), _plain(second)))


def _string(sign: Column) -> Column:
    inner = F.substring(sign, F.lit(2), F.length(sign) - 2)

    def each(part: Column) -> Column:
        return F.when(part.startswith("\\"), _escaped(part)).otherwise(_plain(part))

    parts = F.transform(F.regexp_extract_all(inner, F.lit(_ESCAPE), F.lit(0)), each)
    with_escapes = F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))
    body = F.when(F.contains(inner, F.lit("\\")), with_escapes).otherwise(_plain(inner))
    return F.concat(F.lit('{"s":"'), body, F.lit('"}'))


def _quoted(sign: Column) -> Column:
    return (F.length(sign) > 1) & (sign.startswith("'") | sign.startswith('"'))


def _json(sign: Column) -> Column:
    """A sign as JSON; NULL for one that has no place in a list."""
    scalar = sign.isin("None", "True", "False") | sign.rlike(_NUMBER)
    return (
        F.when(sign.isin("[", "]", ",", ""), sign)
        .when(sign == "(", F.lit('{"t":['))
        .when(sign == ")", F.lit("]}"))
        .when(_quoted(sign), _string(sign))
        .when(scalar, F.concat(F.lit('{"o":"'), sign, F.lit('"}')))
    )


def python_json(c: Column) -> Column:
    """The JSON of a list or tuple printed by Python, or NULL where a sign cannot be read."""
    signs = F.filter(F.regexp_extract_all(c, F.lit(_SIGN), F.lit(0)), lambda s: ~s.rlike(r"^[ \t\n\r\f]+$"))

    def kept(all_: Column) -> Column:
        def at(i: Column) -> Column:
            return F.coalesce(F.get(all_, i), F.lit(""))

        def bare(i: Column) -> Column:
            return ~at(i).isin("", "[", "]", "(", ")", ",")

        def one(s: Column, i: Column) -> Column:
            # The last comma of a list, and parentheses that only hold one scalar, say nothing.
            last = (s == ",") & at(i + 1).isin("]", ")") & ~at(i - 1).isin("", "[", "(", ",")
            round_ = ((s == "(") & bare(i + 1) & (at(i + 2) == ")")) | ((s == ")") & bare(i - 1) & (at(i - 2) == "("))
            return F.when(last | round_, F.lit("")).otherwise(s)

        return F.transform(all_, one)

    parts = F.transform(bind(signs, kept), _json)
    return bind(parts, lambda p: F.when(~F.exists(p, lambda x: x.isNull()), F.array_join(p, "")))


def python_items(c: Column) -> Column:
    """The items of a printed list or tuple, each as the JSON that ``python_json`` gives it; NULL if unreadable."""

    def read(text: Column) -> Column:
        inside = F.when(text.startswith('{"t":['), F.substring(text, F.lit(6), F.length(text) - 6)).otherwise(text)
        return one_list(inside, STRICT)

    return bind(python_json(c), read)


def scalar_text(item: Column) -> Column:
    """The text of a string, the spelling of another scalar; lists and tuples inside stay JSON."""
    return bind(
        F.when(item.startswith("{"), F.from_json(item, SCALAR, STRICT)),
        lambda read: F.coalesce(read["s"], read["o"], item),
    )


def tuple_parts(item: Column) -> Column:
    """The parts of a tuple, NULL for anything else."""
    return F.when(item.startswith('{"t":['), F.from_json(item, "t array<string>", STRICT)["t"])


def list_parts(item: Column) -> Column:
    """The parts of a list, NULL for anything else."""
    return F.when(item.startswith("["), F.from_json(item, "array<string>", STRICT))


def printed(item: Column) -> Column:
    """An item as Python's ``str`` prints it; parts of a list or tuple that hold others stay JSON."""

    def shown(part: Column) -> Column:
        read = F.from_json(part, SCALAR, STRICT)
        quote = F.when(F.contains(read["s"], F.lit("'")) & ~F.contains(read["s"], F.lit('"')), F.lit('"')).otherwise(F.lit("'"))
        return F.when(part.startswith("{"), F.coalesce(F.concat(quote, read["s"], quote), read["o"], part)).otherwise(part)

    def joined(parts: Column) -> Column:
        return F.array_join(F.transform(parts, shown), ", ")

    in_tuple = bind(
        tuple_parts(item),
        lambda p: F.concat(F.lit("("), joined(p), F.when(F.size(p) == 1, F.lit(",)")).otherwise(F.lit(")"))),
    )
    in_list = bind(list_parts(item), lambda p: F.concat(F.lit("["), joined(p), F.lit("]")))
    return F.coalesce(in_tuple, in_list, scalar_text(item))
