"""Equality of rows, with NULL equal to NULL."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from evenkeel.fixed import JSON_TYPE
from evenkeel.functions.assign import split_type

# A piece of JSON text in which no string holds an escaped quote: a string, a number, or what stands between.
# None of it repeats a group, so long strings take no stack.
_STRING = r'"[^"]*+"'
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
_PIECE = rf'{_STRING}|{_NUMBER}|[^"0-9-]++|[\s\S]'
_OPEN = '{"e":0,"v":'


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(text: Column) -> Column:
    """A JSON number as its significant digits and a power of ten, exact at any length."""
    sign = F.when(text.startswith("-"), "-").otherwise("")

    def scaled(parts: Column, rest: Column, digits: Column, cut: Column) -> Column:
        power = F.coalesce(F.get(parts, F.lit(1)), F.lit("0")).try_cast("decimal(20,0)")
        power = power - F.length(rest) + F.length(digits) - F.length(cut)
        # a power of more than twenty digits stays as it is written
        whole = F.concat(sign, F.ltrim(cut, F.lit("0")), F.lit("e"), power.cast("string"))
        return F.when(F.ltrim(cut, F.lit("0")) == "", "0").otherwise(F.coalesce(whole, text))

    def of_parts(parts: Column) -> Column:
        rest = F.substring_index(F.concat(parts[0], F.lit(".")), ".", 2)
        rest = F.replace(F.substr(rest, F.length(F.substring_index(parts[0], ".", 1)) + 2), F.lit("."), F.lit(""))
        return _once(rest, lambda r: _once(F.replace(parts[0], F.lit("."), F.lit("")), lambda d: scaled(parts, r, d, F.rtrim(d, F.lit("0")))))

    return _once(F.split(F.lower(F.ltrim(text, F.lit("-"))), "e"), of_parts)


def _canonical_json(c: Column) -> Column:
    """JSON by value: two texts that mean the same come out as the same text, other text as it is.

    Every number becomes a string ``n`` of its exact value and every string, names
    included, begins with ``s``, so that the parser, which would read some numbers
    as doubles, sees strings only; what it then writes has its names in
    order and no blanks. A member no text can contain shows that the whole text was read.
    """
    plain = F.replace(F.replace(c, F.lit("\\\\"), F.lit("\\u005c")), F.lit("\\\""), F.lit("\\u0022"))
    pieces = F.regexp_extract_all(plain, F.lit(_PIECE), F.lit(0))
    rewritten = F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(p.rlike("^" + _STRING), F.concat(F.lit('"s'), F.substr(p, F.lit(2))))
            .when(p.rlike("^-?[0-9]"), F.concat(F.lit('"n'), _number(p), F.lit('"')))
            .otherwise(p),
        ),
        "",
    )
    read = F.to_json(F.try_parse_json(F.concat(F.lit('{"v":'), rewritten, F.lit(',"e":0}'))))
    return F.coalesce(_once(read, lambda r: F.when(r.startswith(_OPEN), r)), c)


def comparable(c: Column, declared: str) -> Column:
    """The form of a value in which equal means the same.

    JSON text compares by value, at any depth: order of names, blanks, escapes and the way a number is
    written do not count, and numbers are exact however long. Text that is not JSON compares as it stands.
    """
    base, _, _, is_array = split_type(declared)
    if base == JSON_TYPE:
        canonical = _canonical_json
    elif base == "char":
        canonical = F.rtrim
    else:
        return c
    return F.transform(c, canonical) if is_array else canonical(c)


def same(a: Column, b: Column, declared: str = "string") -> Column:
    """Whether two values mean the same; equal text, the usual case, is not looked into."""
    as_written = a.eqNullSafe(b)
    left, right = comparable(a, declared), comparable(b, declared)
    return as_written if left is a else as_written | left.eqNullSafe(right)


def all_same(pairs: list[tuple[Column, Column, str]]) -> Column:
    return reduce(and_, (same(a, b, t) for a, b, t in pairs), F.lit(True))
