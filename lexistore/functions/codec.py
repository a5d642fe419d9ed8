"""Order-preserving binary keys from typed columns, as plain Column expressions.

Unsigned byte order of the encoded keys is the order of the values, part by part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIGN = -(2**63)


def long_key(c: Column) -> Column:
    """Eight bytes, big-endian, with the sign bit flipped."""
    return F.unhex(F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(_SIGN))), 16, "0"))


def long_from_key(c: Column) -> Column:
    """Inverse of ``long_key``."""
    high = F.conv(F.substring(F.hex(c), 1, 8), 16, 10).cast("long") - F.lit(1 << 31)
    low = F.conv(F.substring(F.hex(c), 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32) + low


def date_key(c: Column) -> Column:
    return long_key(F.datediff(c, F.lit("1970-01-01").cast("date")))


def timestamp_key(c: Column) -> Column:
    """Microseconds since the epoch; zone-less timestamps are read as UTC."""
    return long_key(F.unix_micros(c.cast("timestamp")))


def decimal_key(c: Column, scale: int) -> Column:
    """Unscaled value; the column's precision must be at most 18."""
    return long_key((c * F.lit(10**scale)).cast("decimal(18,0)").cast("long"))


def text_key(c: Column) -> Column:
    """UTF-8 bytes: their order is the order of code points."""
    return F.encode(c, "UTF-8")


def bool_key(c: Column) -> Column:
    return F.when(c, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))


def terminated(part: Column) -> Column:
    """A variable-width part that more parts follow: 00 becomes 00FF, then 0000 ends it."""
    pairs = F.regexp_replace(F.hex(part), "(..)", "$1 ")
    escaped = F.regexp_replace(F.regexp_replace(pairs, "00 ", "00FF "), " ", "")
    return F.unhex(F.concat(escaped, F.lit("0000")))


def composite(*parts: Column) -> Column:
    """Parts in order; all but the last must be of fixed width or ``terminated``."""
    return F.concat(*parts)
