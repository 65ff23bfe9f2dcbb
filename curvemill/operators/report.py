"""Text lines for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curvemill import constants as K


def summary_line(period="period", depth="depth", duration="duration", sde="sde") -> Column:
    """One line per detection; depth is a fraction and prints in ppm, duration in hours."""
    p, dp, du, s = F.col(period), F.col(depth), F.col(duration), F.col(sde)
    return F.when(
        s >= K.SDE_THRESHOLD,
        F.format_string("Period %.5f d; depth %.0f ppm; duration %.2f h; SDE %.1f", p, dp * 1e6, du * 24.0, s),
    ).otherwise(F.format_string("no dip above the limit (SDE %.1f, needed %.1f)", s, F.lit(K.SDE_THRESHOLD)))


def fit_warning(chi2="chi2_red", converged="converged") -> Column:
    """Warning for a converged fit above the reliability threshold."""
    c = F.col(chi2)
    return F.when(F.col(converged) & ~F.coalesce(c < K.CHI2_RELIABLE_MAX, F.lit(False)), F.format_string(
        "poor fit: reduced chi-square %.1f, limit %.1f", c, F.lit(K.CHI2_RELIABLE_MAX)))
