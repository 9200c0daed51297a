"""Column functions over binary values: big-endian fields and single-byte text. Offsets count from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtone.functions.rows import let


def be_uint(data: Column, offset: Column | int, width: int) -> Column:
    """Unsigned big-endian field of up to seven bytes as bigint; null if the data ends before it."""
    field = F.substring(data, _plus_one(offset), F.lit(width))
    return F.when(F.length(field) == width, F.conv(F.hex(field), 16, 10).cast("bigint"))


def be_u64(data: Column, offset: Column | int) -> Column:
    """Unsigned 64-bit field as decimal(20,0): it may exceed the bigint range."""
    field = F.substring(data, _plus_one(offset), F.lit(8))
    return F.when(F.length(field) == 8, F.conv(F.hex(field), 16, 10).cast("decimal(20,0)"))


def be_i64(data: Column, offset: Column | int) -> Column:
    """Signed 64-bit field as bigint."""
    u = be_u64(data, offset)
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    half = F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(u >= half, u - two64).otherwise(u).cast("bigint")


def be_double(data: Column, offset: Column | int) -> Column:
    """IEEE-754 binary64 field by bit arithmetic; null for infinities and NaN."""
    hi = be_uint(data, offset, 4)
    lo = be_uint(data, _add(offset, 4), 4)
    sign = F.when(F.shiftright(hi, 31) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = F.shiftright(hi, 20).bitwiseAND(F.lit(2047))
    fraction = hi.bitwiseAND(F.lit(0xFFFFF)) * F.lit(4294967296) + lo
    implicit = F.lit(4503599627370496)
    return F.when(exponent == 2047, F.lit(None).cast("double")).when(
        exponent == 0, sign * fraction.cast("double") * F.pow(F.lit(2.0), F.lit(-1074.0))
    ).otherwise(sign * (fraction + implicit).cast("double") * F.pow(F.lit(2.0), (exponent - 1075).cast("double")))


def be_float80(data: Column, offset: Column | int) -> Column:
    """80-bit extended field: sign, 15-bit exponent, 64-bit mantissa."""
    head = be_uint(data, offset, 2)
    mantissa = be_u64(data, _add(offset, 2)).cast("double")
    sign = F.when(head >= 32768, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = head.bitwiseAND(F.lit(0x7FFF)) - 16383 - 63
    return F.when((head == 0) & (mantissa == 0), F.lit(0.0)).otherwise(
        sign * mantissa * F.pow(F.lit(2.0), exponent.cast("double"))
    )


def byte_text(data: Column) -> Column:
    """Bytes as text, every byte above 127 replaced by U+FFFD; never fails."""
    text = F.decode(data, "ISO-8859-1")  # has as many UTF-8 bytes as the data where there is no byte above 127
    return F.when(F.octet_length(text) == F.length(data), text).otherwise(F.regexp_replace(text, "[\\x80-\\xFF]", "�"))


def ascii_only(text: Column) -> Column:
    """Text with every non-ASCII character replaced by a question mark."""
    return F.regexp_replace(text, "[^\\x00-\\x7F]", "?")


def uint_hex(value: Column, width: int) -> Column:
    """Fixed-width upper-case hex text of a non-negative integer (the inverse of :func:`be_uint`)."""
    return F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")


def nul_pairs(data: Column) -> Column:
    """``array<struct<pos, key, value>>`` of a count-prefixed list of NUL-terminated keys and values.

    Stops at the declared count or at the first string whose NUL is missing.
    """
    none = F.array().cast("array<struct<pos:int,key:string,value:string>>")

    def pairs(parts: Column) -> Column:
        whole = F.floor((F.size(parts) - 1) / 2).cast("bigint")
        n = F.least(be_uint(data, 0, 4), whole).cast("int")
        numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1))
        made = F.transform(
            numbers,
            lambda i: F.struct(
                i.alias("pos"), F.get(parts, i * 2).alias("key"), F.get(parts, i * 2 + 1).alias("value")
            ),
        )
        return F.coalesce(made, none)

    return let(F.split(byte_text(F.substring(data, F.lit(5), F.length(data))), "\\x00"), pairs)


def _plus_one(offset: Column | int) -> Column:
    return F.lit(offset + 1) if isinstance(offset, int) else (offset + 1).cast("int")


def _add(offset: Column | int, n: int) -> Column | int:
    return offset + n
