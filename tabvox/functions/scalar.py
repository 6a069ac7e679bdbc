"""Column expressions shared by the operators. Null means missing; NaN and infinities become null at ingest."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """A number from text or number; null for blank, invalid, NaN and infinite."""
    d = c.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(d)


def num_or_zero(c: Column) -> Column:
    """The other parse mode: what finite leaves out is 0."""
    return F.coalesce(finite(c), F.lit(0.0))


def safe_divide(a: Column, b: Column, least: float = 1e-10) -> Column:
    """a / b; null if |b| < least."""
    return F.when(F.abs(b) >= least, a / b)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's r over rows that have both values, as an aggregate; null where either is constant."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def stars(p: Column) -> Column:
    return F.when(p.isNull(), F.lit("")).when(p < 0.0001, "****").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution by the five-term polynomial of Abramowitz and Stegun 7.1.26."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    # fixed values of the published approximation
    poly = reduce(lambda acc, k: (acc * t) + k, (-1.453152027, 1.421413741, -0.284496736, 0.254829592), F.lit(1.061405429)) * t
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


NORM_CDF_SQL = "(CASE WHEN ({z}) >= 0 THEN 0.5*(1+(1-((((1.061405429*(1/(1+0.3275911*abs({z})/sqrt(2.0::DOUBLE)))-1.453152027)*(1/(1+0.3275911*abs({z})/sqrt(2.0::DOUBLE)))+1.421413741)*(1/(1+0.3275911*abs({z})/sqrt(2.0::DOUBLE)))-0.284496736)*(1/(1+0.3275911*abs({z})/sqrt(2.0::DOUBLE)))+0.254829592)*(1/(1+0.3275911*abs({z})/sqrt(2.0::DOUBLE)))*exp(-({z})*({z})/2))) ELSE 0.5*(1-(1-((((1.061405429*(1/(1+0.3275911*abs({z})/sqrt(2.0::DOUBLE)))-1.453152027)*(1/(1+0.3275911*abs({z})/sqrt(2.0::DOUBLE)))+1.421413741)*(1/(1+0.3275911*abs({z})/sqrt(2.0::DOUBLE)))-0.284496736)*(1/(1+0.3275911*abs({z})/sqrt(2.0::DOUBLE)))+0.254829592)*(1/(1+0.3275911*abs({z})/sqrt(2.0::DOUBLE)))*exp(-({z})*({z})/2))) END)"


def chi2_sf(x: Column, df: int) -> Column:
    """Upper tail of chi-squared with integer df, as a finite series."""
    half = x / 2
    if df % 2 == 0:
        term, total = F.lit(1.0), F.lit(1.0)
        for k in range(1, df // 2):
            term = term * half / k
            total = total + term
        return F.exp(-half) * total
    out = 2 * (1 - norm_cdf(F.sqrt(x)))
    term = F.sqrt(2 * x / 3.141592653589793) * F.exp(-half)
    for k in range(1, (df + 1) // 2):
        out = out + term
        term = term * x / (2 * k + 1)
    return out


def chi2_tail(x: Column, df: Column) -> Column:
    """Upper tail of chi-squared, with df a column of any whole numbers from 1 on; null for others."""
    half, steps = x / 2, F.sequence(F.lit(1), F.greatest(F.floor(df / 2), F.lit(1)))
    series = lambda first, factor: F.aggregate(steps, F.struct(first.alias("term"), F.lit(0.0).alias("total")), lambda a, k: F.struct((a["term"] * factor(k)).alias("term"), (a["total"] + a["term"]).alias("total")))["total"]
    even = series(F.exp(-half), lambda k: half / k)
    odd = 2 * (1 - norm_cdf(F.sqrt(x))) + F.when(df > 1, series(F.sqrt(2 * x / math.pi) * F.exp(-half), lambda k: x / (2 * k + 1))).otherwise(0.0)
    return F.when((df >= 1) & (x >= 0), F.when(df % 2 == 0, even).otherwise(odd))


def shape_composites(sphericity: Column, mean: Column, sd: Column, spareness: Column, elongation: Column, flatness: Column, feret: Column, volume: Column) -> dict[str, Column]:
    """Composite shape scores; null where a denominator vanishes."""
    radius = F.pow(3 * volume / (4 * 3.141592653589793), F.lit(1 / 3))
    return {
        "ri": safe_divide(F.lit(1.0), sphericity),
        "sri": safe_divide(sd, mean),
        "pb": 1 - spareness,
        "mp": safe_divide(elongation - 1, elongation + flatness - 2 + 0.001),
        "vsd": F.when((feret > 0) & (volume > 0), F.log10(F.pow(feret, 3) / volume)),
        "fev": safe_divide(feret, 2 * radius),
    }


def morph_predicate(text: str, columns: dict[str, str]) -> Column:
    """A filter from `feature op number` terms joined by `,` or `;`, ops >= <= > <.

    Missing values fail; features that columns doesn't name pass.
    """
    import re

    out = F.lit(True)
    for term in filter(None, (t.strip() for t in re.split(r"[,;]", text))):
        m = re.fullmatch(r"(\w+)\s*(>=|<=|>|<)\s*([-+.\deE]+)", term)
        if not m:
            raise ValueError(f"not a condition: {term}")
        if m[1].lower() not in columns:
            continue
        c, v = F.col(columns[m[1].lower()]), float(m[3])
        test = {">=": c >= v, "<=": c <= v, ">": c > v, "<": c < v}[m[2]]
        out = out & F.coalesce(test, F.lit(False))
    return out


def all_of(columns) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))
