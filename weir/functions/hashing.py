"""64-bit hashes that agree with other implementations bit for bit, as Spark expressions.

A 64-bit number is held as two 32-bit halves in BIGINTs, so no product or sum overflows whatever
spark.sql.ansi.enabled says.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: FNV-1a, 64 bits
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
# fixed values: finaliser of splitmix64
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None))

_M = (1 << 32) - 1


def _lit(x: int) -> Column:
    return F.lit(x).cast("long")


def _and(a: Column, mask: int) -> Column:
    return a.bitwiseAND(_lit(mask))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fnv1a64_py(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & (1 << 64) - 1
    return h


def mix_py(h: int) -> int:
    for shift, factor in MIX:
        h ^= h >> shift
        if factor:
            h = h * factor & (1 << 64) - 1
    return h


def _whole(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(low)


def fnv1a64(text: Column) -> Column:
    """FNV-1a of a text's UTF-8 bytes, as the BIGINT of the same bits."""
    # made once for each text, outside of the fold: bytes as numbers
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    bytes_ = F.transform(pairs, lambda pair: F.conv(pair, 16, 10).cast("long"))
    # ASCII characters are their bytes
    plain = (F.octet_length(text) == F.char_length(text)) & (F.char_length(text) > 0)
    bytes_ = F.when(plain, F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))).otherwise(bytes_)

    # the prime is 2**40 + 0x1b3
    def step(acc: Column, byte: Column) -> Column:
        low = acc["low"].bitwiseXOR(byte)
        product = low * _lit(0x1B3)
        high = acc["high"] * _lit(0x1B3) + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(_and(high, _M).alias("high"), _and(product, _M).alias("low"))

    start = F.struct(_lit(FNV_OFFSET >> 32).alias("high"), _lit(FNV_OFFSET & _M).alias("low"))
    return F.aggregate(bytes_, start, step, lambda acc: _whole(acc["high"], acc["low"]))


def _times(high: Column, low: Column, factor: int) -> tuple[Column, Column]:
    """The product modulo 2**64, by 16-bit limbs of the factor."""
    f0, f1, f2, f3 = ((factor >> s) & 0xFFFF for s in (0, 16, 32, 48))
    a, b = low * _lit(f0), low * _lit(f1)
    bottom = _and(a, _M) + F.shiftleft(_and(b, 0xFFFF), 16)
    carry = F.shiftright(a, 32) + F.shiftright(b, 16) + F.shiftright(bottom, 32)
    upper = low * _lit(f2) + F.shiftleft(_and(low * _lit(f3), 0xFFFF), 16)
    upper = upper + high * _lit(f0) + F.shiftleft(_and(high * _lit(f1), 0xFFFF), 16)
    return _and(upper + carry, _M), _and(bottom, _M)


def mix(h: Column) -> Column:
    """The splitmix64 finaliser of a BIGINT's bits. Staged through one-element arrays, so no step is evaluated twice."""
    def step(shift: int, factor: int | None):
        def one(x: Column) -> Column:
            x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
            return _whole(*_times(F.shiftrightunsigned(x, 32), _and(x, _M), factor)) if factor else x

        return one

    for shift, factor in MIX:
        h = F.transform(F.array(h), step(shift, factor))[0]
    return h


def threshold(percent: float) -> int:
    """The largest mixed hash that a share of percent keeps."""
    return min(int(2.0**64 * percent / 100.0), (1 << 64) - 1)


def at_most(h: Column, limit: int) -> Column:
    """h <= limit as unsigned numbers."""
    sign = -(1 << 63)
    return h.bitwiseXOR(_lit(sign)) <= _lit(signed(limit) ^ sign)
