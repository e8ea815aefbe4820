"""IPv4 as a signed 32-bit int <-> dotted text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wrap_int32(c):
    """Signed 32-bit wrap of a non-negative long, without ANSI overflow errors."""
    m = F.pmod(c, F.lit(4294967296))
    return F.when(m >= 2147483648, m - 4294967296).otherwise(m).cast("int")


def int_to_ip(ip) -> Column:
    """Unsigned shifts of the int, four octets joined by dots (-1 -> 255.255.255.255)."""
    x = _c(ip).cast("int")
    octets = [F.shiftrightunsigned(x, s).bitwiseAND(F.lit(255)) for s in (24, 16, 8)] + [x.bitwiseAND(F.lit(255))]
    return F.concat_ws(".", *[o.cast("string") for o in octets])


def ip_to_int(ip, strict: bool = False) -> Column:
    """Dotted text to signed int; three dots, digits only, octets <= 255.

    Empty octets count as 0 ('1...' parses).  Invalid text gives null, or an
    error when ``strict``.
    """
    s = _c(ip)
    parts = F.split(s, r"\.", -1)
    octs = [F.when(F.get(parts, i) == "", F.lit(0).cast("long"))
            .otherwise(F.get(parts, i).try_cast("long"))
            for i in range(4)]
    shape_ok = s.rlike(r"^[0-9]*\.[0-9]*\.[0-9]*\.[0-9]*$")
    range_ok = F.greatest(*[F.coalesce(o, F.lit(256)) for o in octs]) <= 255
    ok = F.coalesce(shape_ok & range_ok, F.lit(False))
    value = octs[0] * 16777216 + octs[1] * 65536 + octs[2] * 256 + octs[3]
    good = wrap_int32(value)
    if strict:
        return F.when(ok, good).otherwise(F.raise_error(F.concat(F.lit("bad IP: "), F.coalesce(s, F.lit("null")))).cast("int"))
    return F.when(ok, good)
