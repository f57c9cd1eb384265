"""Arithmetic rules shared by all metrics: exact sums, rounding, refusing ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

# Dust thresholds and decimal places.
EPS_QTY = 1e-9
EPS_MONEY = 1e-6
QTY_DP = 9
MONEY_DP = 6
DISPLAY_DP = 2

MONEY_TYPE = "decimal(38,12)"
QTY_TYPE = "decimal(28,9)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """The value when it is a finite number, else NULL."""
    x = _c(x).cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def exact_sum(x, over: WindowSpec | None = None) -> Column:
    """Order-independent sum of doubles, of a group or over a window; NULLs are skipped, NaN stays NaN."""
    x = _c(x)
    total, poisoned = F.sum(x.try_cast(MONEY_TYPE)), F.bool_or(F.isnan(x))
    if over is not None:
        total, poisoned = total.over(over), poisoned.over(over)
    return F.when(poisoned, F.lit(float("nan"))).otherwise(total.cast("double"))


def sum_known(x) -> Column:
    """Sum of the known values, 0 when there are none."""
    return F.coalesce(exact_sum(x), F.lit(0.0))


def sum_all_or_null(x) -> Column:
    """Sum that is NULL as soon as one input is unknown."""
    x = _c(x)
    return F.when(~F.bool_or(x.isNull()), exact_sum(x))


def round_away(x, dp: int = MONEY_DP) -> Column:
    """Round half away from zero on the decimal text of the number; never -0."""
    x = _c(x)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), x).otherwise(F.round(x, dp) + F.lit(0.0))


def round_up6(x) -> Column:
    """Six decimals with halves rounded towards +infinity (ledger storage rule)."""
    return F.floor(_c(x) * 1e6 + 0.5).cast("double") / 1e6 + F.lit(0.0)


def ratio(part, whole) -> Column:
    """part / whole, NULL on a zero or non-finite side."""
    return finite(F.try_divide(finite(part), finite(whole)))


def pct(part, whole) -> Column:
    return ratio(part, whole) * 100.0


def clamp(x, lo, hi) -> Column:
    return F.greatest(F.least(_c(x), F.lit(hi)), F.lit(lo))


def is_zero(x, eps: float = EPS_QTY) -> Column:
    return F.abs(_c(x)) <= F.lit(eps)
