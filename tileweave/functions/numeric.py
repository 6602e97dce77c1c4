"""Numbers in bytes and text, sample bits, elevations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def read_unsigned(data: Column, offset: Column | int, size: int, little: bool = False) -> Column:
    """Unsigned integer of 1 to 7 bytes (8: a decimal) at a byte offset; null beyond the end."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    part = F.substr(data, at + 1, F.lit(size))
    digits = F.hex(part) if not little else F.concat(*[F.hex(F.substr(part, F.lit(i), F.lit(1))) for i in range(size, 0, -1)])
    value = F.conv(digits, 16, 10).cast("decimal(20,0)" if size == 8 else "bigint")
    return F.when(F.octet_length(part) == size, value)


def read_signed(data: Column, offset: Column | int, size: int, little: bool = False) -> Column:
    """Two's complement integer of 1 to 8 bytes at a byte offset; null beyond the end."""
    if size < 8:  # the sign bit goes to the top and comes back
        spare = 64 - 8 * size
        return F.shiftright(F.shiftleft(read_unsigned(data, offset, size, little), spare), spare)
    at = F.lit(offset) if isinstance(offset, int) else offset
    high, low = (at + 4, at) if little else (at, at + 4)
    return F.shiftleft(read_unsigned(data, high, 4, little), 32).bitwiseOR(read_unsigned(data, low, 4, little))


def write_unsigned(value: Column, size: int, little: bool = False) -> Column:
    """Bytes of an unsigned integer; null if it doesn't fit."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    ordered = digits if not little else F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(size, 0, -1)])
    limit = (1 << 8 * size) - 1 if size < 8 else (1 << 63) - 1
    return F.when((value >= 0) & (value <= limit), F.unhex(ordered))


def write_signed(value: Column, size: int, little: bool = False) -> Column:
    """Two's complement bytes of an integer; null if it doesn't fit."""
    half = 1 << (8 * size - 1)
    digits = F.right(F.lpad(F.hex(value.cast("bigint")), 16, "0"), F.lit(2 * size))
    ordered = digits if not little else F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(size, 0, -1)])
    return F.when((value >= -half) & (value <= half - 1), F.unhex(ordered))


def _once(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def read_float(data: Column, offset: Column | int, size: int, little: bool = False) -> Column:
    """IEEE number of 4 or 8 bytes at a byte offset; null beyond the end."""
    wide, split, bias = (64, 52, 1023) if size == 8 else (32, 23, 127)

    def of(b: Column) -> Column:
        sign = F.when(F.shiftrightunsigned(b, wide - 1).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
        exponent = F.shiftright(b, split).bitwiseAND(F.lit(2 * bias + 1))
        fraction = b.bitwiseAND(F.lit((1 << split) - 1)).cast("double") * F.lit(2.0**-split)
        special = F.when(fraction == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
        small = sign * fraction * F.pow(F.lit(2.0), F.lit(1.0 - bias))
        return F.when(exponent == 2 * bias + 1, special).when(exponent == 0, small).otherwise(sign * (1 + fraction) * F.pow(F.lit(2.0), exponent.cast("double") - bias))

    bits = read_signed(data, offset, 8, little) if size == 8 else read_unsigned(data, offset, 4, little)
    return _once(bits, lambda b: F.when(b.isNotNull(), of(b)))


def float_bits(value: Column, size: int) -> Column:
    """The bits of a number in IEEE form of 4 or 8 bytes, as a long; a number too large for 4 bytes is infinite."""
    wide, split, bias = (64, 52, 1023) if size == 8 else (32, 23, 127)
    two = lambda n: F.pow(F.lit(2.0), n)
    number = value.cast("double") if size == 8 else value.cast("float").cast("double")

    def of(v: Column) -> Column:
        negative = F.when((v < 0) | ((v == 0) & (v.cast("string") == "-0.0")), 1).otherwise(0).cast("bigint")
        size_of = F.abs(v)

        def normal(e: Column) -> Column:
            scaled = size_of / two(e)
            return F.shiftleft((e + bias).cast("bigint"), split) + ((scaled - 1) * F.lit(2.0**split)).cast("bigint")

        guess = F.floor(F.log2(size_of)).cast("double")
        # The logarithm may be off by one next to a power of two.
        exponent = _once(F.least(guess, F.lit(float(bias))), lambda g: F.when(size_of / two(g) >= 2, g + 1).when(size_of / two(g) < 1, g - 1).otherwise(g))
        least = F.lit(2.0 ** (1 - bias))
        small = (size_of * F.lit(2.0 ** (bias - 1)) * F.lit(2.0**split)).cast("bigint")
        top = F.shiftleft(F.lit(2 * bias + 1).cast("bigint"), split)
        body = F.when(F.isnan(v), top + (1 << (split - 1))).when(size_of == float("inf"), top).when(size_of < least, small).otherwise(_once(exponent, normal))
        return body + F.shiftleft(negative, wide - 1) if size == 4 else body.bitwiseOR(F.shiftleft(negative, wide - 1))

    return _once(number, lambda v: F.when(v.isNotNull(), of(v)))


def write_float(value: Column, size: int, little: bool = False) -> Column:
    """IEEE bytes of a number in 4 or 8 bytes."""
    return (write_signed if size == 8 else write_unsigned)(float_bits(value, size), size, little)


def as_int(text: Column) -> Column:
    """Integer of a text field; a blank field is 0, anything else that isn't a number null."""
    return F.when(F.trim(text) == "", F.lit(0).cast("bigint")).otherwise(F.trim(text).try_cast("bigint"))


def as_unsigned(text: Column) -> Column:
    """As ``as_int``; negative numbers are null."""
    value = as_int(text)
    return F.when(value >= 0, value)


def as_float(text: Column) -> Column:
    """Float of a text field; a blank field is 0."""
    return F.when(F.trim(text) == "", F.lit(0.0)).otherwise(F.trim(text).try_cast("double"))


def unjustified(value: Column, actual_bits: int, bits: int, right: bool = True) -> Column:
    """A sample without the unused bits of its container: right-justified low bits, or left-justified high bits."""
    return value.bitwiseAND(F.lit((1 << actual_bits) - 1)) if right else F.shiftright(value, bits - actual_bits)


def justified(value: Column, actual_bits: int, bits: int, right: bool = True) -> Column:
    """Inverse of ``unjustified``."""
    return value.bitwiseAND(F.lit((1 << actual_bits) - 1)) if right else F.shiftleft(value, bits - actual_bits)


def elevation(raw: Column) -> Column:
    """Sign-magnitude 16-bit elevation; all bits set means no data, -32767."""
    return F.when(raw == 65535, F.lit(-32767)).when(raw.bitwiseAND(F.lit(32768)) != 0, -raw.bitwiseAND(F.lit(32767))).otherwise(raw)


def elevation_bits(value: Column) -> Column:
    """Inverse of ``elevation``; -32767 becomes all bits set."""
    return F.when(value == -32767, F.lit(65535)).when(value < 0, (-value).bitwiseOR(F.lit(32768))).otherwise(value)


def looked_up(table: Column, index: Column) -> Column:
    """Entry of a lookup table; null beyond its end."""
    return F.try_element_at(table, index + 1)


def checksum(data: Column) -> Column:
    """Sum of the bytes of ``data`` as unsigned numbers."""
    digits = F.hex(data)
    numbers = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.substr(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"))
    return F.when(F.octet_length(data) > 0, F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, b: a + b)).otherwise(F.lit(0).cast("bigint"))


def checksum_holds(record: Column) -> Column:
    """Whether the last four bytes are the sum of the others; false below twelve bytes."""
    n = F.octet_length(record)
    return F.when(n < 12, F.lit(False)).otherwise(checksum(F.substr(record, F.lit(1), n - 4)) == read_unsigned(record, n - 4, 4))


def complex_sample(data: Column, index: Column, little: bool = False) -> Column:
    """Bit patterns of the real and imaginary part of a 64-bit complex sample."""
    return F.struct(read_unsigned(data, index * 8, 4, little).alias("re_bits"), read_unsigned(data, index * 8 + 4, 4, little).alias("im_bits"))


def complex_bytes(real: Column, imaginary: Column, little: bool = False) -> Column:
    """A 64-bit complex sample: the bytes of its real and its imaginary part."""
    return F.concat(write_float(real, 4, little), write_float(imaginary, 4, little))
