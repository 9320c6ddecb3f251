"""Logit vectors as packed half-precision numbers: two bytes an entry, low byte first, in one
binary value.

A model that runs in half precision loses nothing, and a vector takes half the bytes of
one of floats.  All of it is expressions over the row; a single entry is read from its two
bytes alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logitblend.functions.vectors import bind

_LATIN = "ISO-8859-1"  # one character for each byte


def _value(code: Column) -> Column:
    """The number that 16 bits stand for: a sign, 5 bits of exponent, 10 of fraction."""
    exponent = F.shiftright(code, 10).bitwiseAND(F.lit(31))
    fraction = code.bitwiseAND(F.lit(1023)).cast("double")
    size = (
        F.when(exponent == 0, fraction * 2.0**-24)
        .when((exponent == 31) & (fraction == 0), F.lit(float("inf")))
        .when(exponent == 31, F.lit(float("nan")))
        .otherwise((fraction + 1024) * F.pow(F.lit(2.0), exponent - 25))
    )
    return F.when(code >= 32768, -size).otherwise(size)


def decoded(packed: Column) -> Column:
    """All entries, as ``array<float>``."""
    size = F.expr("0") + F.floor(F.octet_length(packed) / 2).cast("int")

    def entries(codes: Column) -> Column:
        at = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            at, lambda i: bind(F.get(codes, 2 * i) + 256 * F.get(codes, 2 * i + 1), _value).cast("float")
        )

    codes = F.transform(F.split(F.decode(packed, _LATIN), ""), lambda c: F.ascii(c))
    return F.when(packed.isNotNull(), bind(codes, entries))


def entry(packed: Column, i: Column) -> Column:
    """One entry, from 0; null beyond the vector."""

    def byte(at: Column) -> Column:
        return F.ascii(F.decode(F.substring(packed, at, F.lit(1)), _LATIN))

    code = byte(2 * i + 1) + 256 * byte(2 * i + 2)
    inside = (i >= 0) & (2 * i + 2 <= F.octet_length(packed))
    return F.when(inside, bind(code, _value).cast("float"))


def packed(logits: Column) -> Column:
    """Numbers as half-precision ones, rounded to the nearest, to even where two are as near; what
    is too large becomes infinite.  A missing entry is NaN."""

    def code(x: Column) -> Column:
        size = F.abs(x)
        guess = F.floor(F.log2(size))
        power = (
            F.when(F.pow(F.lit(2.0), guess) > size, guess - 1)
            .when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1)
            .otherwise(guess)
        )
        # A fraction that is rounded up to the next power carries over into the exponent.
        normal = (power + 15) * 1024 + F.bround(size * F.pow(F.lit(2.0), 10 - power), 0).cast("long") - 1024
        bits = (
            F.when(x.isNull() | F.isnan(x), F.lit(0x7E00))
            .when(size >= 65520.0, F.lit(0x7C00))
            .when(size < 2.0**-14, F.bround(size * 2.0**24, 0).cast("long"))
            .otherwise(normal)
        )
        return bits + F.when(x < 0, F.lit(32768)).otherwise(F.lit(0))

    def text(bits: Column) -> Column:
        low, high = bits.bitwiseAND(F.lit(255)), F.shiftright(bits, 8)
        return F.concat(F.lpad(F.hex(low), 2, "0"), F.lpad(F.hex(high), 2, "0"))

    each = F.transform(logits, lambda x: bind(code(x.cast("double")).cast("long"), text))
    return F.unhex(F.array_join(each, ""))


def _is_packed(logits: DataFrame) -> bool:
    return isinstance(logits.schema["logits"].dataType, T.BinaryType)


def over_vector(logits: DataFrame, body: Callable[[Column], Column]) -> Column:
    """``body`` of the column ``logits`` of a table as an array; a packed one is decoded once."""
    return bind(decoded(F.col("logits")), body) if _is_packed(logits) else body(F.col("logits"))


def reader(logits: DataFrame) -> Callable[[Column], Column]:
    """How to read a single entry of ``logits``."""
    if _is_packed(logits):
        return lambda i: entry(F.col("logits"), i)
    return lambda i: F.get("logits", i)
