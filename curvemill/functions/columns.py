"""Column expressions. All stay inside whole-stage codegen; none needs Python workers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from curvemill import constants as K


def lit_or_col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def rd(c, digits: int = 6) -> Column:
    """Round for output, halves away from zero. Stays in generated code; ``round`` on a double goes
    through BigDecimal."""
    c, m = lit_or_col(c), float(10 ** digits)
    return F.signum(c) * F.floor(F.abs(c) * m + 0.5) / m


def rint_at(c, digits: int = 8) -> Column:
    """Round halves to even at a decimal place, scaled in binary floating point."""
    m = float(10 ** digits)
    return F.rint(lit_or_col(c) * m) / m


def is_finite(c) -> Column:
    c = lit_or_col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_or_null(c) -> Column:
    return F.when(is_finite(c), lit_or_col(c))


def clamp_int(c: Column, hi: Column) -> Column:
    """A whole number between 0 and ``hi``."""
    return F.greatest(F.lit(0), F.least(c, hi))


def clamp(c, lo: float, hi: float) -> Column:
    """NULL stays NULL; ``least``/``greatest`` alone would skip it."""
    c = lit_or_col(c)
    return F.when(c < lo, F.lit(float(lo))).when(c > hi, F.lit(float(hi))).otherwise(c)


def clipped_log10(c, floor: float) -> Column:
    c = lit_or_col(c)
    return F.when(c.isNotNull(), F.log10(F.greatest(c, F.lit(float(floor)))))


# -- phase and epoch ---------------------------------------------------------------------------

def phase_time(t="t", t0="t0", period="period") -> Column:
    """Time from the nearest event, in [-P/2, P/2)."""
    t, t0, p = map(lit_or_col, (t, t0, period))
    return F.pmod(t - t0 + p * 0.5, p) - p * 0.5


def phase(t="t", t0="t0", period="period") -> Column:
    """Phase in [-0.5, 0.5)."""
    t, t0, p = map(lit_or_col, (t, t0, period))
    return F.pmod(t - t0 + p * 0.5, p) / p - 0.5


def epoch(t="t", t0="t0", period="period") -> Column:
    """Number of the nearest event; halves go to the even number."""
    t, t0, p = map(lit_or_col, (t, t0, period))
    return F.rint((t - t0) / p)


def from_mid_event(t="t", t0="t0", period="period") -> Column:
    t, t0, p = map(lit_or_col, (t, t0, period))
    return (t - t0) - F.rint((t - t0) / p) * p


def parity(e: Column) -> Column:
    return F.pmod(e.cast("bigint"), F.lit(2))


def in_event(t="t", t0="t0", period="period", duration="duration", n_durations: float = 1.5) -> Column:
    """True within n_durations/2 of an event; false everywhere for an unusable ephemeris."""
    p, d = lit_or_col(period), lit_or_col(duration)
    usable = is_finite(p) & (p > 0) & is_finite(d)
    safe = F.when(usable, p).otherwise(F.lit(1.0))
    return F.coalesce(usable & (F.abs(phase_time(t, t0, safe)) < d * n_durations / 2.0), F.lit(False))


# -- geometry ------------------------------------------------------------------------------------

def implied_density(period="period", duration="duration", depth="depth") -> Column:
    p, d, depth = map(lit_or_col, (period, duration, depth))
    ok = (p > 0) & (d > 0)
    p1, d1 = F.when(ok, p), F.when(ok, d)
    ars = p1 / (d1 * math.pi) * (1.0 + F.sqrt(F.greatest(depth, F.lit(0.0))))
    secs = p1 * K.DAY_SECONDS
    return F.lit(3.0 * math.pi) / (F.lit(K.G_CGS) * secs * secs) * ars * ars * ars


def a_over_rs(period, density) -> Column:
    p, rho = lit_or_col(period) * K.DAY_SECONDS, lit_or_col(density)
    return F.pow(F.lit(K.G_CGS) * rho * p * p / (3.0 * math.pi), F.lit(1.0 / 3.0))


def transit_duration(period, rp, ars, b) -> Column:
    """First-to-fourth contact time; a grazing-all-orbit geometry gives P/pi."""
    p, rp, a, b = map(lit_or_col, (period, rp, ars, b))
    inc = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), b / a)))
    arg = F.try_divide(F.sqrt(F.greatest((rp + 1.0) * (rp + 1.0) - b * b, F.lit(0.0))), a * F.sin(inc))
    return p / math.pi * F.when(arg.isNull() | (arg >= 1.0), F.lit(1.0)).otherwise(F.asin(arg))


def limb_u(q1, q2) -> tuple[Column, Column]:
    q1, q2 = lit_or_col(q1), lit_or_col(q2)
    r = F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), q1)))
    return r * q2 * 2.0, r * (1.0 - q2 * 2.0)


def limb_q(u1, u2) -> tuple[Column, Column]:
    u1, u2 = lit_or_col(u1), lit_or_col(u2)
    s = u1 + u2
    return (F.when(s <= 0, F.lit(0.0)).otherwise(s * s),
            F.when(s <= 0, F.lit(0.5)).otherwise(F.try_divide(u1, s * 2.0)))


def trapezoid_shape(dt, t14, t23) -> Column:
    """1 in the flat part, 0 outside, linear between."""
    x, h14, h23 = F.abs(lit_or_col(dt)), lit_or_col(t14) / 2.0, lit_or_col(t23) / 2.0
    return (F.when(x <= h23, F.lit(1.0))
            .when((x < h14) & (h14 > h23), (h14 - x) / (h14 - h23)).otherwise(F.lit(0.0)))


def trapezoid(dt, depth, t14, t23, base) -> Column:
    return lit_or_col(base) - lit_or_col(depth) * trapezoid_shape(dt, t14, t23)


# -- labels and names ----------------------------------------------------------------------------

def label_from_flags(disposition="koi_disposition", nt="nt", ss="ss", co="co", ec="ec") -> Column:
    """Class of a vetted object; ambiguous flag sets and open candidates give NULL."""
    nt, ss, co, ec = (lit_or_col(c) != 0 for c in (nt, ss, co, ec))
    false_pos = lit_or_col(disposition) == "FALSE POSITIVE"
    return (F.when(lit_or_col(disposition) == "CONFIRMED", "transit")
            .when(false_pos & ss & ~nt & ~co & ~ec, "eclipse")
            .when(false_pos & nt & ~ss & ~co & ~ec, "variable")
            .when(false_pos & (co | ec) & ~ss & ~nt, "blend"))


def label_from_code(code) -> Column:
    code = lit_or_col(code)
    return (F.when(code.isin("CP", "KP"), "transit")
            .when(code.isin("FP", "FA"), "false_positive"))


def digits_of(c) -> Column:
    """Digits of a free-text id; NULL when there are none."""
    d = F.regexp_replace(lit_or_col(c).cast("string"), "[^0-9]", "")
    return F.when(F.length(d) > 0, d)


def prefixed_id(prefix: str, number) -> Column:
    return F.concat(F.lit(prefix + " "), lit_or_col(number).cast("bigint").cast("string"))


def settled(error="error") -> Column:
    """A success, or a failure that running again cannot change."""
    e = lit_or_col(error)
    return e.isNull() | F.startswith(e, F.lit("no detection"))


def brightness_bin(mission="mission", mag="mag") -> Column:
    m, x = lit_or_col(mission), lit_or_col(mag)
    out = F.lit(None).cast("string")
    for name, bins in K.BRIGHTNESS_BINS.items():
        for label, lo, hi in bins:
            out = F.when((m == name) & (x >= lo) & (x < hi), label).otherwise(out)
    return out


# -- evaluation ----------------------------------------------------------------------------------

def harmonic_error(recovered, true) -> Column:
    r = F.try_divide(lit_or_col(recovered), lit_or_col(true))
    return F.least(F.abs(r - 1.0), F.abs(r - 2.0) / 2.0, F.abs(r - 0.5) * 2.0)


def wilson(correct, n) -> tuple[Column, Column]:
    """95 % Wilson bounds; NULL when n = 0.

    The bounds are the rates r at which ``hits`` is exactly Z95 standard errors off, (hits - n r)^2 = Z95^2 n r (1 - r): the roots of a quadratic.
    """
    hits, trials = lit_or_col(correct).cast("double"), lit_or_col(n).cast("double")
    q = K.Z95 * K.Z95
    a, b = trials + q, hits * 2.0 + q
    root = F.sqrt(b * b - a * hits * hits / trials * 4.0)
    return tuple(F.when(trials > 0, r / (a * 2.0)) for r in (b - root, b + root))


def accuracy_difference(acc_a, acc_b, n) -> tuple[Column, Column, Column, Column]:
    """Accuracy b less accuracy a on n rows each, its 95 % interval, and whether that leaves out 0."""
    a, b, n = map(lit_or_col, (acc_a, acc_b, n))
    half = F.sqrt(a * (1.0 - a) / n + b * (1.0 - b) / n) * K.Z95
    d = b - a
    return d, d - half, d + half, F.abs(d) > half


# -- fit verdicts ----------------------------------------------------------------------------------

def fit_reliable(converged="converged", chi2="chi2_red") -> Column:
    return F.coalesce(lit_or_col(converged) & is_finite(chi2) & (lit_or_col(chi2) < K.CHI2_RELIABLE_MAX),
                      F.lit(False))


def caution(label="label", converged="converged", chi2="chi2_red") -> Column:
    """A geometric label whose fit converged to a reduced chi-square beyond the limit."""
    c = lit_or_col(chi2)
    return F.coalesce(lit_or_col(label).isin(K.GEOMETRIC_CLASSES) & lit_or_col(converged)
                      & is_finite(c) & ~(c < K.CHI2_RELIABLE_MAX), F.lit(False))


def caution_reason(label="label", converged="converged", chi2="chi2_red", confidence="confidence") -> Column:
    conf = lit_or_col(confidence)
    text = F.concat(
        F.format_string("reduced chi-square %.1f is above %.0f, yet the label is '%s'",
                        lit_or_col(chi2), F.lit(K.CHI2_RELIABLE_MAX), lit_or_col(label)),
        F.when(conf.isNotNull() & (conf != 0), F.format_string(" at %.0f%% confidence", conf * 100.0))
        .otherwise(F.lit("")),
        F.lit("; do not use the fitted values"))
    return F.when(caution(label, converged, chi2), text)
