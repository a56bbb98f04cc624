"""Assignment of declared values to the column types of a table.

A value goes in as an INSERT would put it in: text that is too long is refused
and not cut (blanks past the end may go), decimals round half up to the column's
scale, numbers that are not numbers are refused.
"""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.fixed import JSON_TYPE, REFUSALS, TEXT_COMPARED_TYPES, TYPE_LONG_NAMES, TYPE_NAMES

_SIZED = re.compile(r"^([\w ]+?) ?\((\d+)(?:,\s*(\d+))?\)( with(?:out)? time zone)?$")
_NAMED = {other: name for name, others in TYPE_NAMES.items() for other in others}
_UUID = "^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"
_INTEGERS = ("tinyint", "smallint", "int", "integer", "bigint", "byte", "short", "long")


def split_type(declared: str) -> tuple[str, int | None, int | None, bool]:
    """``character varying(9)[]`` -> ("varchar", 9, None, True): one name for each type, whatever it is called."""
    text = " ".join(declared.lower().split())
    is_array = text.endswith("[]")
    text = text.removesuffix("[]").strip()
    m = _SIZED.match(text)
    if not m:
        return _NAMED.get(text, text), None, None, is_array
    base = m[1] + (m[4] or "")
    name = _NAMED.get(base, base)
    if name == "timestamp":  # a precision of fractions, which storage does not limit
        return name, None, None, is_array
    return name, int(m[2]), int(m[3]) if m[3] else None, is_array


def canonical_type(c: Column) -> Column:
    """The type names of a column under the one name each type has, sizes kept."""
    text = F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"\[\]$", ""), r" ?\([^)]*\)", ""))
    names = F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair])
    size = F.regexp_replace(F.regexp_extract(text, r"(\([0-9, ]*\))", 1), " ", "")
    nested = text.rlike("<")
    return F.when(nested, text).otherwise(
        F.concat(F.coalesce(names[bare], bare), size, F.when(text.endswith("[]"), "[]").otherwise(""))
    )


def storage_type(declared: str) -> str:
    """The Spark type that holds a column of the declared type."""
    base, n, scale, is_array = split_type(declared)
    if base in (JSON_TYPE, "varchar", "char", "bit", "text", "uuid", *TEXT_COMPARED_TYPES):
        stored = "string"
    elif base == "decimal":
        stored = f"decimal({n or 38},{scale if scale is not None else (0 if n else 10)})"
    else:
        stored = base if n is None and "<" not in base else declared.strip().removesuffix("[]")
        try:
            T.DataType.fromDDL(stored)
        except ParseException as e:
            raise ValueError(f"type {declared} is not known") from e
    return f"array<{stored}>" if is_array else stored


def long_name(declared: str) -> str:
    base, n, scale, is_array = split_type(declared)
    size = "" if n is None else f"({n})" if scale is None else f"({n},{scale})"
    return TYPE_LONG_NAMES.get(base, base) + size + ("[]" if is_array else "")


def refusal(declared: str) -> str:
    base = split_type(declared)[0]
    kind = "too_long" if base in ("varchar", "char") else "bad_value"
    return REFUSALS[kind].format(type=long_name(declared))


def assignment(c: Column, source: T.DataType, declared: str) -> tuple[Column, Column]:
    """The value as the column stores it, and whether it has to be refused."""
    base, n, _, is_array = split_type(declared)
    if is_array:
        element = source.elementType if isinstance(source, T.ArrayType) else source
        scalar = declared.strip().removesuffix("[]")
        return (
            F.transform(c, lambda x: assignment(x, element, scalar)[0]),
            F.coalesce(F.exists(c, lambda x: assignment(x, element, scalar)[1]), F.lit(False)),
        )
    text = c.cast("string")
    if base == "varchar" and n:
        return F.substring(text, 1, n), _refuse(text, F.length(F.rtrim(text)) > n)
    if base == "char":
        n = n or 1
        return F.rpad(F.rtrim(text), n, " "), _refuse(text, F.length(F.rtrim(text)) > n)
    if base == "bit":
        return text, _refuse(text, ~text.rlike("^[01]{%d}$" % (n or 1)))
    if base == JSON_TYPE:
        return text, _refuse(text, F.try_parse_json(text).isNull())
    if base == "uuid":
        plain = F.regexp_replace(F.lower(text), "-", "")
        written = F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
        return written, _refuse(text, ~text.rlike(_UUID))
    stored = storage_type(declared)
    if stored == "string":
        return text, F.lit(False)
    # Fractions go to whole numbers by rounding, never by truncation.
    if base in _INTEGERS and isinstance(source, (T.DoubleType, T.FloatType)):
        c = F.rint(c)
    elif base in _INTEGERS and isinstance(source, T.DecimalType):
        c = F.round(c, 0)
    elif base == "boolean" and isinstance(source, T.StringType):
        word = F.lower(F.trim(c))
        c = F.when(word == "on", "true").when(word == "off", "false").otherwise(c)
    value = c.try_cast(stored)
    if base == "decimal" and n is None:
        # a type without a scale rounds nothing: digits beyond what is stored are refused
        cut = (value.cast("double") != c.try_cast("double")) | text.rlike(r"\.[0-9]{10}[0-9]*[1-9]")
        return value, _refuse(c, value.isNull() | cut)
    return value, _refuse(c, value.isNull())


def _refuse(source: Column, bad: Column) -> Column:
    return source.isNotNull() & F.coalesce(bad, F.lit(False))
