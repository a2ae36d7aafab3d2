"""Column expressions shared by the operators.

One helper for each definition that must read the same everywhere: the window
index with its guard, bit masks over windows, hash-based uniform numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: guard inside the floor, so that a time on a boundary falls in the later window
EPS = 1e-9


def window_index(t: str, t0: str, t1: str, windows: int, offset: str = "0.0", bins: int | None = None) -> Column:
    """0-based equal-width window of ``t`` on [t0, t1]; the last window is closed."""
    width = f"(({t1} - {t0}) / {windows}D)"
    return F.expr(f"cast(greatest(0D, least({(bins or windows) - 1}D, floor(({t} - {t0} + {offset}) / {width} + {EPS}D))) as int)")


def window_mask(w: str) -> Column:
    return F.expr(f"bit_or(shiftleft(1L, {w}))")


def u01(*parts: str | Column) -> Column:
    """Uniform in [0, 1) from the md5 of the parts joined by '|'; parts are text or integers."""
    key = F.md5(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def mean(c: str) -> Column:
    """Mean of a double in any order of rows: twelve places are averaged as decimals, what they leave (or all of what is too great) as doubles."""
    fixed = f"if({c} is null, null, coalesce(try_cast({c} as decimal(28, 12)), 0))"
    return F.expr(f"cast(avg({fixed}) as double) + avg({c} - cast({fixed} as double))")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
