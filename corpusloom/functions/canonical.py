"""Canonical JSON of nested columns and its digest: fields sorted by name, so equal values have equal digests wherever they were made.

The text is that of a compact standard serialiser with sorted keys, `, ` and `: ` between parts and everything beyond
ASCII escaped. The expression is built from the schema; no user function runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters with an escape of their own: fixed values.
SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
#: Places after the first digit that are tried in turn: the first that give the number back are its shortest.
PLACES = (0, 14, 15, 16)


def json_text(text: Column) -> Column:
    """A string in quotes, with escapes in small hexadecimal; a character beyond 16 bits as two."""
    out = text
    for sign, escape in SHORT.items():
        out = F.replace(out, F.lit(sign), F.lit(escape))
    code = lambda c: F.lower(F.hex(F.encode(c, "UTF-16BE")))
    escaped = lambda c: F.regexp_replace(code(c), "(.{4})", r"\\u$1")
    rest = F.array_join(F.transform(F.split(out, ""), lambda c: F.when(c.rlike(r"[^\x20-\x7E]"), escaped(c)).otherwise(c)), "")
    return F.concat(F.lit('"'), F.when(out.rlike(r"[^\x20-\x7E]"), rest).otherwise(out), F.lit('"'))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it stands in the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def json_double(number: Column) -> Column:
    """A double with its shortest digits: plain from 1e-4 up to 1e16, else with an exponent of two digits or more."""
    told = F.coalesce(*(F.when(t.cast("double") == F.abs(number), t) for t in (F.format_string(f"%.{p}e", F.abs(number)) for p in PLACES)))
    digits = lambda t: F.regexp_replace(F.replace(F.split(t, "e")[0], F.lit("."), F.lit("")), "0+$", "")
    shown = _with(told, lambda t: _with(F.struct(digits(t).alias("d"), (F.split(t, "e")[1].cast("int") + 1).alias("point")), lambda x: _decimal(x["d"], x["point"])))
    sign = F.when(number.cast("string").startswith("-"), "-").otherwise("")
    odd = F.when(F.isnan(number), "NaN").when(number == float("inf"), "Infinity").when(number == float("-inf"), "-Infinity")
    return F.coalesce(odd, F.concat(sign, shown))


def _decimal(digits: Column, point: Column) -> Column:
    """0.digits * 10^point, digits without zeros at the end."""
    n, exponent = F.length(digits), point - 1
    inside = F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n))
    plain = F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)).when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n), F.lit(".0"))).otherwise(inside)
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
    return F.when(digits == "", "0.0").when((exponent >= -4) & (exponent < 16), plain).otherwise(F.concat(F.substring(digits, 1, 1), tail, F.lit("e"), power))


def canonical(value: Column, kind: T.DataType) -> Column:
    """The canonical JSON of a value of this type: structs and maps by sorted names, a null as `null`, dates and decimals as strings."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(json_text(F.lit(f.name)), F.lit(": "), canonical(value[f.name], f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(json_text(e["key"].cast("string")), F.lit(": "), canonical(e["value"], kind.valueType))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), entry), ", "), F.lit("}"))
    elif isinstance(kind, T.BooleanType):
        text = F.when(value, "true").otherwise("false")
    elif isinstance(kind, T.IntegralType):
        text = value.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = json_double(value.cast("double"))
    else:
        text = json_text(value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(text)


def digest(value: Column, kind: T.DataType) -> Column:
    """The SHA-256 of the canonical JSON."""
    return F.sha2(canonical(value, kind), 256)
