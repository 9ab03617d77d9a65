"""Canonical JSON of typed columns, as column expressions: what Python's json.dumps(sort_keys=True, ensure_ascii=False) writes.

Keys are sorted at every depth, nulls stay, strings keep their non-ASCII characters, numbers have
Python's forms. The serialiser follows the column's type, so it is one expression of nested
transforms that code generation handles; JSON that comes as text has no type and goes through
``canon.canonical_json``.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The short escapes of JSON; other control characters have four hexadecimal digits.
SHORT = {'"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def quoted(text: Column) -> Column:
    """A JSON string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark, escape in SHORT.items():
        out = F.replace(out, F.lit(mark), F.lit(escape))
    rare = out
    for code in range(0x20):
        if chr(code) not in SHORT:
            rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1f]"), rare).otherwise(out), F.lit('"'))


def double(x: Column) -> Column:
    """The shortest digits that give the number back, in positional form from 1e-4 up to 1e16.

    Beyond 9.2e18, or far below 1, the last of seventeen digits may be the second nearest (once in
    119,978 random numbers); it gives the same number back.
    """
    text = F.abs(x).cast("string")
    mantissa, power = F.split(text, "E")[0], F.coalesce(F.try_element_at(F.split(text, "E"), F.lit(2)).cast("int"), F.lit(0))
    whole, part = F.split(mantissa, r"\.")[0], F.split(mantissa, r"\.")[1]
    # the value is digits * 10 ** shift; this platform may print a digit or two more than are needed
    all_ = F.concat(whole, part)
    digits = F.rtrim(all_, F.lit("0"))
    state = F.struct(digits.try_cast("long").alias("digits"), (power - F.length(part) + F.length(all_) - F.length(digits)).alias("shift"))
    # two texts of fifteen digits are two numbers, so such a one has no shorter form
    short = (F.length(F.ltrim(digits, F.lit("0"))) <= 15) & (F.abs(x) >= 2.2250738585072014e-308)

    def shorter(s: Column, _: Column) -> Column:
        tries = [F.struct(d.alias("digits"), (s["shift"] + 1).alias("shift")) for d in (F.floor((s["digits"] + 5) / F.lit(10).cast("decimal(20,0)")).cast("long"), F.floor(s["digits"] / F.lit(10).cast("decimal(20,0)")).cast("long"))]
        same = lambda t: (t["digits"] > 0) & (F.concat(t["digits"].cast("string"), F.lit("E"), t["shift"].cast("string")).cast("double") == F.abs(x))
        return F.when(same(tries[0]), tries[0]).when(same(tries[1]), tries[1]).otherwise(s)

    found = F.when(short, state).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(18)), state, shorter))
    # whole numbers of 18 and 19 places are exact as longs, which gives the nearest digits where this platform's are one off
    exact = (F.abs(x) >= 1e17) & (F.abs(x) < 9.2e18)

    def nearest(s: Column) -> Column:
        unit = F.pow(F.lit(10.0), s["shift"]).cast("long")
        digits = F.when(exact & (s["shift"] > 0), F.floor((F.abs(x).cast("long") + F.floor(unit / 2).cast("long")).cast("decimal(20,0)") / unit.cast("decimal(20,0)")).cast("long")).otherwise(s["digits"])
        return _spelled(digits.cast("string"), s["shift"])

    # both are parts of one value, so that the search is made once
    spelled = F.transform(F.array(found), nearest)[0]
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
    return F.when(x == 0, F.concat(sign, F.lit("0.0"))).when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("Infinity"))).otherwise(F.concat(sign, spelled))


def _spelled(digits: Column, shift: Column) -> Column:
    n = F.length(digits)
    exponent = n + shift - 1  # of the first digit
    zeros = lambda k: F.repeat(F.lit("0"), F.greatest(k, F.lit(0)).cast("int"))
    padded = F.concat(digits, zeros(exponent + 1 - n))
    large = F.concat(F.substring(padded, F.lit(1), exponent + 1), F.lit("."), F.when(n > exponent + 1, F.substring(digits, exponent + 2, n)).otherwise("0"))
    small = F.concat(F.lit("0."), zeros(-exponent - 1), digits)
    tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
    power = F.concat(F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    return F.when((exponent >= -4) & (exponent < 16), F.when(exponent >= 0, large).otherwise(small)).otherwise(F.concat(F.substring(digits, F.lit(1), F.lit(1)), tail, power))


def object_of(pairs: dict[str, Column], spaced: bool = False, sort: bool = True, absent: Collection[str] = ()) -> Column:
    """A JSON object of serialised values, those in ``absent`` left out where they are null; a null elsewhere is written."""
    comma, colon = (", ", ": ") if spaced else (",", ":")
    names = sorted(pairs) if sort else list(pairs)
    keyed = [F.concat(quoted(F.lit(n)), F.lit(colon), pairs[n] if n in absent else F.coalesce(pairs[n], F.lit("null"))) for n in names]
    return F.concat(F.lit("{"), F.concat_ws(comma, *keyed), F.lit("}"))


def canonical(value: Column, kind: T.DataType, spaced: bool = False, absent: Collection[str] = ()) -> Column:
    """The JSON of ``value``, a column of type ``kind``. Fields named in ``absent`` are left out where they are null; a null is the text null."""
    return F.coalesce(_written(value, kind, spaced, absent), F.lit("null"))


def _written(value: Column, kind: T.DataType, spaced: bool, absent: Collection[str]) -> Column:
    """As ``canonical``, with null for null."""
    comma, colon = (", ", ": ") if spaced else (",", ":")
    if isinstance(kind, T.StringType):
        return quoted(value)
    if isinstance(kind, (T.BooleanType, T.IntegralType)):
        return value.cast("string")
    if isinstance(kind, T.DoubleType):
        return double(value)
    if isinstance(kind, T.StructType):
        inner = {f.name: _written(value[f.name], f.dataType, spaced, absent) for f in kind.fields}
        return F.when(value.isNotNull(), object_of(inner, spaced, absent=absent))
    if isinstance(kind, T.ArrayType):
        each: Callable[[Column], Column] = lambda x: canonical(x, kind.elementType, spaced, absent)
        return F.concat(F.lit("["), F.array_join(F.transform(value, each), comma), F.lit("]"))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        pairs = F.array_sort(F.transform(F.map_keys(value), lambda k: F.struct(k.alias("k"), value[k].alias("v"))), lambda p, q: F.when(p["k"] < q["k"], -1).when(p["k"] > q["k"], 1).otherwise(0))
        return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(quoted(p["k"]), F.lit(colon), canonical(p["v"], kind.valueType, spaced, absent))), comma), F.lit("}"))
    raise TypeError(f"no JSON form for {kind.simpleString()}")


def canonical_sha256(value: Column, kind: T.DataType, absent: Collection[str] = ()) -> Column:
    return F.sha2(canonical(value, kind, absent=absent), 256)
