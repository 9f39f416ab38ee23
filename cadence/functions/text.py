"""Number-to-text helpers used by report tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def percent_decimals(proportions: Column) -> Column:
    """Decimals that tell percent labels apart, from the array of all proportions
    shown together: labels go to a tenth of the power of ten of the smallest gap
    between different percentages, one decimal less if that leaves every last digit
    zero, and never coarser than whole percents. One value, or values equal to
    rounding, need no decimals."""
    whole = F.filter(F.transform(proportions, lambda p: p * F.lit(100.0)), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    a = F.array_sort(F.array_distinct(whole))
    steps = F.greatest(F.size(a) - 1, F.lit(0))
    gap = F.array_min(F.zip_with(F.slice(a, F.lit(2), steps), F.slice(a, F.lit(1), steps), lambda hi, lo: hi - lo))
    k = (F.lit(1) - F.floor(F.log10(gap))).cast("int")
    zeros = F.forall(a, lambda x: F.bround(x * F.pow(F.lit(10.0), k)) % 10 == 0)
    return F.when(gap.isNull() | (gap < F.lit(1.5e-8)), F.lit(0)).otherwise(F.greatest(k - zeros.cast("int"), F.lit(0)))


def percent_label(proportion: str | Column, digits: int | Column = 0) -> Column:
    """Proportion as percent text, e.g. 0.648 -> '65%' (digits=0). ``digits`` may be a
    column, as from ``percent_decimals``."""
    pct = _c(proportion) * F.lit(100.0)
    if isinstance(digits, Column):
        text = F.regexp_replace(F.call_function("format_number", pct, digits), ",", "")
    elif digits == 0:
        text = F.round(pct, 0).cast("bigint").cast("string")
    else:
        text = F.format_number(F.round(pct, digits), digits)
    return F.concat(text, F.lit("%"))


def r_format_digits(x: str | Column, digits: int = 2) -> Column:
    """Text of a number shown with at least ``digits`` significant digits and
    never fewer integer digits than it has: 734.6 -> '735', 14701.0 -> '14701',
    1.234 -> '1.2', 0.01234 -> '0.012'. Ties round to even; trailing zeros
    are dropped.
    """
    v = _c(x)
    mag = F.floor(F.log10(F.abs(v)))
    whole = F.bround(v, 0).cast("bigint").cast("string")
    # format_number rounds half-even and takes the number of decimals per row
    decimals = (F.lit(digits - 1) - mag).cast("int")
    frac = F.regexp_replace(F.regexp_replace(F.call_function("format_number", v, decimals), ",", ""), "\\.?0+$", "")
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(v == 0, F.lit("0"))
        .when(mag >= digits - 1, whole)
        .otherwise(frac)
    )


def report_line(label: str, value: str | Column) -> Column:
    """'label: value' as one string column; a missing value prints as NA."""
    return F.concat_ws(" ", F.lit(label), F.coalesce(_c(value).cast("string"), F.lit("NA")))
