"""Canonical JSON of columns, as expressions: one text for one value, whatever wrote it.

Object keys are sorted (by code points), there is no white space, and texts and numbers have the form that ECMAScript's
``JSON.stringify`` gives them: quotes, backslashes and control characters are escaped, nothing else; numbers
have the fewest digits that tell them apart, in plain notation from 1e-6 up to below 1e21. Numbers that JSON
hasn't (NaN, infinities) are null. Dates are ISO dates, times ISO times in UTC with milliseconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StringType, StructType, TimestampType

# Escapes of their own; other control characters are escaped by number.
SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def text(value: Column) -> Column:
    """A quoted JSON text; null stays null. Only texts with control characters are taken apart."""
    escapes = F.create_map(*(F.lit(x) for code in range(32) for x in (chr(code), SHORT.get(chr(code), f"\\u{code:04x}"))))

    def quoted(escaped: Column) -> Column:
        every = F.array_join(F.transform(F.split(escaped, ""), lambda c: F.coalesce(F.try_element_at(escapes, c), c)), "")
        return F.concat(F.lit('"'), F.when(escaped.rlike("[\\x00-\\x1f]"), every).otherwise(escaped), F.lit('"'))

    return let(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), quoted)


def number(value: Column) -> Column:
    """A double's shortest digits, laid out as ECMAScript does; null for what isn't a number. Below 1e-321 Java has two digits at least."""
    some = lambda times: F.repeat(F.lit("0"), times)

    def shortest(shown: Column) -> Column:
        """Java before 19 may show more digits than needed; no two texts of 15 digits or fewer are one double."""
        again = lambda places: F.format_string(f"%.{places}e", F.abs(value))
        same = lambda places: F.when(again(places).cast("double") == F.abs(value), again(places))
        return F.when(F.length(F.regexp_replace(shown, "E.*|[.]", "")) > 15, F.coalesce(same(14), same(15), same(16), shown)).otherwise(shown)

    def parts(shown: Column) -> Column:
        """Digits before and after the point, and the power of ten."""
        power = F.coalesce(F.regexp_extract(shown, "[eE][+]?(-?[0-9]+)", 1).try_cast("int"), F.lit(0))
        return F.struct(F.regexp_extract(shown, "^[0-9]+", 0).alias("whole"), F.regexp_extract(shown, "[.]([0-9]+)", 1).alias("part"), power.alias("power"))

    def places(p: Column) -> Column:
        """The digits without zeros around them, and n: the value is 0.digits times ten to the n."""
        every = F.concat(p["whole"], p["part"])
        bare = F.regexp_replace(every, "^0+", "")
        n = F.length(p["whole"]) + p["power"] - (F.length(every) - F.length(bare))
        return F.struct(F.regexp_replace(bare, "0+$", "").alias("digits"), n.alias("n"))

    def laid(d: Column) -> Column:
        digits, n, k = d["digits"], d["n"], F.length(d["digits"])
        tail = F.when(k > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), k))).otherwise("")
        return (
            F.when((k <= n) & (n <= 21), F.concat(digits, some(n - k)))
            .when((n > 0) & (n <= 21), F.concat(F.substring(digits, F.lit(1), n), F.lit("."), F.substring(digits, n + 1, k)))
            .when((n > -6) & (n <= 0), F.concat(F.lit("0."), some(-n), digits))
            .otherwise(F.concat(F.substring(digits, 1, 1), tail, F.when(n > 0, "e+").otherwise("e-"), F.abs(n - 1).cast("string")))
        )

    size = let(let(let(let(F.abs(value).cast("string"), shortest), parts), places), laid)
    signed = F.when(value == 0, "0").when(value < 0, F.concat(F.lit("-"), size)).otherwise(size)
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), signed)


def json_of(value: Column, kind: DataType, by_name: bool = True) -> Column:
    """Canonical JSON of a column of type ``kind``; null is ``null``. Without ``by_name`` a struct's keys come as declared."""
    if isinstance(kind, StringType):
        out = text(value)
    elif isinstance(kind, DoubleType | FloatType):
        out = number(value.cast("string").cast("double"))  # a float's own digits
    elif isinstance(kind, DecimalType):
        out = number(value.cast("double")) if kind.scale else value.cast("string")
    elif isinstance(kind, BooleanType | ByteType | ShortType | IntegerType | LongType):
        out = value.cast("string")
    elif isinstance(kind, DateType):
        out = text(F.date_format(value, "yyyy-MM-dd"))
    elif isinstance(kind, TimestampType):
        out = text(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_of(x, kind.elementType, by_name)), ","), F.lit("]"))
    elif isinstance(kind, MapType):
        pair = lambda k: F.concat(text(k.cast("string")), F.lit(":"), json_of(value[k], kind.valueType, by_name))
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(value)), pair), ","), F.lit("}"))
    elif isinstance(kind, StructType):
        parts = [F.concat(text(F.lit(f.name)), F.lit(":"), json_of(value[f.name], f.dataType, by_name)) for f in (sorted(kind.fields, key=lambda f: f.name) if by_name else kind.fields)]
        out = F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    else:
        raise ValueError(f"no JSON form of {kind.simpleString()}")
    return F.coalesce(out, F.lit("null"))
