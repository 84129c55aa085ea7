"""FNV-1a in 32-bit halves (64-bit products would overflow), symbol ids, and a hash to [0, 1]."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The offset basis in halves and the prime 2**40 + 0x1b3.
OFFSET_HIGH, OFFSET_LOW, PRIME_LOW = 0xCBF29CE4, 0x84222325, 0x1B3
LOW_32 = 0xFFFFFFFF


def fnv64(text: Column) -> Column:
    """The 64 bits as a signed long, over the UTF-8 bytes."""
    digits = F.hex(F.encode(text, "UTF-8"))
    count = F.floor(F.length(digits) / 2).cast("int")

    def step(state: Column, k: Column) -> Column:
        byte = F.conv(F.substring(digits, 2 * k - 1, F.lit(2)), 16, 10).cast("bigint")
        x = state["low"].bitwiseXOR(byte)
        product = x * PRIME_LOW
        high = state["high"] * PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(high.bitwiseAND(F.lit(LOW_32)).alias("high"), product.bitwiseAND(F.lit(LOW_32)).alias("low"))

    start = F.struct(F.lit(OFFSET_HIGH).cast("bigint").alias("high"), F.lit(OFFSET_LOW).cast("bigint").alias("low"))
    places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda s: F.shiftleft(s["high"], 32).bitwiseOR(s["low"]))


def symbol_id(file: Column, name: Column, line: Column) -> Column:
    return fnv64(F.concat_ws(":", file, name, line.cast("string")))


def unsigned(id: Column) -> Column:
    """Sorts as the unsigned value does."""
    return id.bitwiseXOR(F.lit(-(2**63)))


def _whole(value: int) -> Column:
    """A number beyond 64 bits."""
    return F.lit(str(value)).cast("decimal(38,0)")


def unsigned_text(id: Column) -> Column:
    return F.when(id >= 0, id.cast("string")).otherwise((id.cast("decimal(38,0)") + _whole(2**64)).cast("decimal(20,0)").cast("string"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: written out, each use would repeat the whole expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _times(x: Column, factor: int) -> Column:
    """x * factor modulo 2**64, by 16-bit parts of x so that no product overflows."""
    total = F.lit(0).cast("decimal(38,0)")
    for k in range(4):
        part = F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(0xFFFF))
        total = (total + part.cast("decimal(6,0)") * _whole((factor << (16 * k)) % 2**64).cast("decimal(20,0)")).cast("decimal(38,0)")
    return _bound(total % _whole(2**64), lambda rest: F.when(rest >= _whole(2**63), rest - _whole(2**64)).otherwise(rest).cast("bigint"))


def _folded(x: Column) -> Column:
    return _bound(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 33)))


def unit_float(id: Column) -> Column:
    """The 64-bit finaliser, its low 24 bits over the largest such number."""
    x = _bound(_folded(id), lambda v: _times(v, 0xFF51AFD7ED558CCD))
    x = _bound(_folded(x), lambda v: _times(v, 0xC4CEB9FE1A85EC53))
    return _folded(x).bitwiseAND(F.lit(0xFFFFFF)) / F.lit(float(0xFFFFFF))
