"""Numeric helpers expressed as SQL that Spark and DuckDB evaluate identically.

* ``round_half_up``: ``floor(x * 10^d + 0.5) / 10^d`` on the binary value.
  Spark's ``round`` works on the decimal string of a double and DuckDB's on
  the binary value, so they disagree on ties; this form is the same in both.
* ``student_t_p_sql``: two-sided p-value of Student's t with an integer number
  of degrees of freedom, in closed form (Abramowitz & Stegun 26.7.3-26.7.4),
  so a trend's significance needs no UDF and no SciPy.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_double(x: float) -> str:
    """A literal both engines parse as DOUBLE (scientific notation)."""
    return "%.17E" % x


def round_half_up(c: Column, digits: int) -> Column:
    scale = float(10 ** digits)
    return F.floor(c * scale + 0.5) / scale


def round_half_up_sql(expr: str, digits: int) -> str:
    scale = sql_double(float(10 ** digits))
    return f"(floor(({expr}) * {scale} + 5.0E-1) / {scale})"


def _nested_series(ratios: list[float], c: str) -> str:
    """1 + r1 c (1 + r2 c (1 + ... )) as SQL text."""
    expr = "1.0E0"
    for r in reversed(ratios):
        expr = f"(1.0E0 + {sql_double(r)} * {c} * {expr})"
    return expr


def _cdf_branch(nu: int, theta: str) -> str:
    """A = P(|T| <= t) for integer ``nu`` given theta = atan(|t| / sqrt(nu))."""
    c = f"(cos({theta}) * cos({theta}))"
    if nu == 1:
        return f"(2.0E0 * {theta} / pi())"
    if nu % 2 == 0:
        m = nu // 2 - 1
        ratios = [(2 * j - 1) / (2 * j) for j in range(1, m + 1)]
        return f"(sin({theta}) * {_nested_series(ratios, c)})"
    m = (nu - 3) // 2
    ratios = [(2 * j) / (2 * j + 1) for j in range(1, m + 1)]
    return (f"(2.0E0 / pi() * ({theta} + sin({theta}) * cos({theta}) * "
            f"{_nested_series(ratios, c)}))")


def student_t_p_sql(theta: str, nu: str, max_nu: int) -> str:
    """Two-sided p-value, ``theta`` = atan(|t|/sqrt(nu)) column, ``nu`` >= 1."""
    whens = " ".join(f"WHEN {nu} = {k} THEN {_cdf_branch(k, theta)}" for k in range(1, max_nu + 1))
    return f"greatest(0.0E0, 1.0E0 - (CASE {whens} END))"


def theta_from_r_sql(r: str) -> str:
    """atan(|t| / sqrt(nu)) for the t statistic of a correlation ``r``.

    t = r sqrt(nu / ((1 - r + 1e-20)(1 + r + 1e-20))); the tiny offset keeps a
    perfect fit finite, as the usual least-squares routines do.
    """
    return f"atan2(abs({r}), sqrt((1.0E0 - ({r}) + 1.0E-20) * (1.0E0 + ({r}) + 1.0E-20)))"


def student_t_p(theta: Column, nu: Column) -> Column:
    """Same value as ``student_t_p_sql`` as a compact Spark expression.

    The series is evaluated with ``aggregate`` over j = m..1 in Horner order,
    the same operations in the same order as the unrolled SQL text, so both
    agree to the last bit; the expression stays small whatever the largest
    number of degrees of freedom (no generated-code size limit is hit when it
    is fused into an aggregation stage).
    """
    c = F.cos(theta) * F.cos(theta)
    m_even = (nu / 2).cast("int") - 1
    m_odd = ((nu - 3) / 2).cast("int")

    def horner(m: Column, ratio) -> Column:
        js = F.when(m >= 1, F.reverse(F.sequence(F.lit(1), m))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(js, F.lit(1.0), lambda acc, j: F.lit(1.0) + ratio(j) * c * acc)

    even = F.sin(theta) * horner(m_even, lambda j: (2.0 * j - 1.0) / (2.0 * j))
    odd = F.lit(2.0) / F.pi() * (theta + F.sin(theta) * F.cos(theta)
                                 * horner(m_odd, lambda j: (2.0 * j) / (2.0 * j + 1.0)))
    a = F.when(nu == 1, F.lit(2.0) * theta / F.pi()).when(nu % 2 == 0, even).otherwise(odd)
    return F.greatest(F.lit(0.0), F.lit(1.0) - a)
