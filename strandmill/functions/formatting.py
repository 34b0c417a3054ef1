"""Human-readable sizes and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _one_decimal(n: Column, unit: int) -> Column:
    """``n / unit`` printed with one decimal, rounded as the double quotient would be.

    A tie is decided by whether the double nearest to n / unit lies above or below it.
    That quotient is exact for powers of two.  Otherwise the sign of q * unit - n tells,
    computed without rounding by splitting q in two.
    """
    tenths = F.floor(n * 10 / unit).cast("long")
    twice_rest = (n * 10 - tenths * unit) * 2
    odd = tenths % 2 == 1
    if unit & (unit - 1):
        q = n.cast("double") / float(unit)
        high = q * 134217729.0 - (q * 134217729.0 - q)
        product = q * float(unit)
        error = (product - n) + ((high * float(unit) - product) + (q - high) * float(unit))
        odd = (error > 0) | ((error == 0) & odd)
    t = tenths + F.when((twice_rest > unit) | ((twice_rest == unit) & odd), 1).otherwise(0)
    return F.regexp_replace(t.cast("string"), r"^(-?\d*)(\d)$", "$1.$2")


def _scaled(n: Column, steps: list[tuple[int, str]], plain: str) -> Column:
    out = None
    for unit, suffix in steps:
        text = F.concat(_one_decimal(n, unit), F.lit(suffix))
        out = F.when(n >= unit, text) if out is None else out.when(n >= unit, text)
    return out.otherwise(F.concat(n.cast("string"), F.lit(plain)))


def bytes_short(n: Column) -> Column:
    return _scaled(n, [(1 << 20, " MB"), (1 << 10, " KB")], " B")


def base_pairs(n: Column) -> Column:
    return _scaled(n, [(1_000_000, " Mbp"), (1_000, " Kbp")], " bp")


def bytes_iec(n: Column, gap: str = " ") -> Column:
    steps = [(1 << (10 * (i + 1)), f"{gap}{s}B") for i, s in enumerate("KMGTPE")]
    return _scaled(n, steps[::-1], f"{gap}B")


def ratio(bases: Column, size: Column) -> Column:
    return F.when(size == 0, F.lit(0.0)).otherwise(bases / size)


def parse_bytes(text: Column) -> Column:
    """Bytes meant by a size such as ``50GB`` (decimal) or ``4KiB`` (binary)."""
    number = F.regexp_extract(text, r"^\s*([0-9.]+)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, r"([a-zA-Z]*)\s*$", 1))
    power = F.when(
        F.length(unit) > 0, F.instr(F.lit("kmgtpe"), F.substring(unit, 1, 1))
    ).otherwise(0)
    base = F.when(F.contains(unit, F.lit("i")), 1024.0).otherwise(1000.0)
    return F.floor(number * F.pow(base, power)).cast("long")


def age(seconds: Column) -> Column:
    """Compact duration: 42s, 7m0s, 3h0m5s."""
    s = F.concat((seconds % 60).cast("string"), F.lit("s"))
    m = F.concat((F.floor(seconds / 60) % 60).cast("string"), F.lit("m"), s)
    h = F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"), m)
    return F.when(seconds < 60, s).when(seconds < 3600, m).otherwise(h)


def progress_bar(have: Column, total: Column, width: int) -> Column:
    """Fixed-width bar of filled and empty cells."""
    filled = F.when(total <= 0, 0).otherwise(
        F.least(F.lit(width), F.floor(have * width / F.nullif(total, F.lit(0))))
    ).cast("int")
    return F.concat(F.repeat(F.lit("▓"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))
