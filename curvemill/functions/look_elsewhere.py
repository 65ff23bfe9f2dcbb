"""Discount of a detection statistic for the number of trials it was chosen from."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from curvemill.functions import normal

_NORMAL = NormalDist()


def corrected(sde: float | None, trials: int | None) -> float | None:
    """Plain form: Sidak-corrected statistic, never above the raw one and never below 0."""
    if sde is None or trials is None or math.isnan(sde):
        return None
    if trials <= 1 or math.isinf(sde):
        return sde
    p1 = 0.5 * math.erfc(sde / math.sqrt(2.0))
    if p1 <= 0.0:
        return sde
    # 1 - (1 - p1)^N, stable in the tail; p1 = 1 makes every trial exceed
    pn = 1.0 if p1 >= 1.0 else -math.expm1(trials * math.log1p(-p1))
    if pn >= 1.0:
        return min(0.0, sde)
    if pn <= 0.0:
        return sde
    return min(max(-_NORMAL.inv_cdf(pn), 0.0), sde)


def look_elsewhere_sde(sde: str, trials: str) -> Column:
    """``corrected`` for two columns, as an expression."""
    return F.expr(normal.spark().corrected(f"CAST({sde} AS DOUBLE)", f"CAST({trials} AS DOUBLE)"))
