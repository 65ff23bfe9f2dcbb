"""Upper tail and quantile of the standard normal law as SQL text, for Spark and for DuckDB, which have neither.

Both take and give *tail* probabilities, so that nothing is lost far out. The tail is a power series up to 3 and Laplace's continued fraction beyond; the quantile is
Wichura's rational approximation (algorithm AS 241). Values that are used several times are bound by a one-element array and a lambda, the
only difference between the two dialects.
"""

from __future__ import annotations

from itertools import count

# Coefficients of AS 241, highest power first; the middle, then the tails up to 5 and beyond
CENTRE = (
    (2.5090809287301226727e+3, 3.3430575583588128105e+4, 6.7265770927008700853e+4, 4.5921953931549871457e+4,
     1.3731693765509461125e+4, 1.9715909503065514427e+3, 1.3314166789178437745e+2, 3.3871328727963666080e+0),
    (5.2264952788528545610e+3, 2.8729085735721942674e+4, 3.9307895800092710610e+4, 2.1213794301586595867e+4,
     5.3941960214247511077e+3, 6.8718700749205790830e+2, 4.2313330701600911252e+1, 1.0),
)
NEAR = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e+0,
     3.64784832476320460504e+0, 5.76949722146069140550e+0, 4.63033784615654529590e+0, 1.42343711074968357734e+0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
     6.89767334985100004550e-1, 1.67638483018380384940e+0, 2.05319162663775882187e+0, 1.0),
)
FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
     2.96560571828504891230e-1, 1.78482653991729133580e+0, 5.46378491116411436990e+0, 6.65790464350110377720e+0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
     1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)
# terms of the series at 3, levels of the fraction beyond: both settle to the last digit
TERMS, LEVELS = 45, 50


def _number(x: float) -> str:
    return f"{x:.20E}"


class Dialect:
    """Writes expressions for one engine; ``lambda_`` binds a name to a value inside an expression."""

    def __init__(self, lambda_: str):
        self._lambda, self._names = lambda_, count()

    def let(self, value: str, body) -> str:
        name = f"v{next(self._names)}"
        return self._lambda.format(value=value, name=name, body=body(name))

    def polynomials(self, pair, r: str) -> str:
        out = []
        for coefficients in pair:
            text = _number(coefficients[0])
            for c in coefficients[1:]:
                text = f"({text} * {r} + {_number(c)})"
            out.append(text)
        return f"{out[0]} / {out[1]}"

    def tail(self, z: str) -> str:
        """Chance of more than ``z``."""
        def above_zero(a: str) -> str:
            series = "1.0E0"
            for k in range(TERMS, 0, -1):
                series = f"(1.0E0 + q * {series} / {2 * k + 1}.0E0)"
            fraction = a
            for k in range(LEVELS, 0, -1):
                fraction = f"({a} + {k}.0E0 / {fraction})"
            density = f"(exp({a} * {a} * -5.0E-1) * 3.98942280401432677940E-1)"
            near = self.let(f"{a} * {a}", lambda q: series.replace("q", q))
            return f"CASE WHEN {a} < 3.0E0 THEN 5.0E-1 - {density} * {a} * {near} ELSE {density} / {fraction} END"

        return self.let(f"abs({z})", lambda a: self.let(above_zero(a), lambda p: f"CASE WHEN {z} < 0 THEN 1.0E0 - {p} ELSE {p} END"))

    def quantile(self, p: str) -> str:
        """The value that is exceeded with chance ``p``, 0 < p < 1."""
        def outside(r: str) -> str:
            near = self.let(f"{r} - 1.6E0", lambda x: self.polynomials(NEAR, x))
            far = self.let(f"{r} - 5.0E0", lambda x: self.polynomials(FAR, x))
            return f"CASE WHEN {r} <= 5.0E0 THEN {near} ELSE {far} END"

        centre = self.let(f"1.80625E-1 - (5.0E-1 - {p}) * (5.0E-1 - {p})", lambda r: f"(5.0E-1 - {p}) * ({self.polynomials(CENTRE, r)})")
        wing = self.let(f"sqrt(-ln(least({p}, 1.0E0 - {p})))", outside)
        return f"CASE WHEN abs({p} - 5.0E-1) <= 4.25E-1 THEN {centre} WHEN {p} < 5.0E-1 THEN {wing} ELSE -({wing}) END"

    def corrected(self, sde: str, trials: str) -> str:
        """A statistic discounted for the number of trials it was chosen from (Sidak), never above the raw one and never below 0."""
        def discounted(p1: str) -> str:
            # ln(1 - p1) and 1 - exp(u), by series where digits would be lost
            log1p = f"CASE WHEN {p1} < 1.0E-4 THEN -{p1} * (1.0E0 + {p1} * (5.0E-1 + {p1} * (1.0E0 / 3.0E0 + {p1} * 2.5E-1))) ELSE ln(1.0E0 - {p1}) END"

            def chance(u: str) -> str:
                return f"CASE WHEN {u} > -1.0E-4 THEN -{u} * (1.0E0 + {u} * (5.0E-1 + {u} * (1.0E0 / 6.0E0 + {u} / 2.4E1))) ELSE 1.0E0 - exp({u}) END"

            def back(pn: str) -> str:
                return (f"CASE WHEN {pn} >= 1.0E0 THEN least(0.0E0, {sde}) WHEN {pn} <= 0 THEN {sde} "
                        f"ELSE least(greatest({self.quantile(pn)}, 0.0E0), {sde}) END")

            inner = self.let(f"{trials} * ({log1p})", lambda u: self.let(chance(u), back))
            return f"CASE WHEN {p1} <= 0 THEN {sde} WHEN {p1} >= 1.0E0 THEN least(0.0E0, {sde}) ELSE {inner} END"

        known = self.let(self.tail(sde), discounted)
        return (f"CASE WHEN {sde} IS NULL OR {trials} IS NULL OR isnan({sde}) THEN NULL WHEN {trials} <= 1 OR abs({sde}) > 1.0E300 THEN {sde} "
                f"WHEN {sde} > 3.8E1 THEN {sde} ELSE {known} END")


def spark() -> Dialect:
    return Dialect("element_at(transform(array({value}), {name} -> {body}), 1)")


def duck() -> Dialect:
    return Dialect("list_transform([{value}], lambda {name}: {body})[1]")
