"""Missing tokens and numbers in text columns, and the distribution functions of the diagnostics.

Columns are handled by built-in expressions. The distributions are scalars for the driver: a model needs a handful.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# What readers and editors take for a missing cell.
READER_TOKENS = ("", "NA", "N/A", "nan", "NaN", "null", "NULL", "m")
UTILITY_TOKENS = ("", "na", "n/a", "nan", "null", "m")
EDITOR_TOKENS = ("", "na", "n/a", "nan", "null", "m", "-", "?", "none", "missing")
# Chi-square quantiles for two degrees of freedom.
CHI_SQUARE_2 = {0.90: 4.605, 0.95: 5.991, 0.99: 9.210}

BLANKS = " \t\n\x0b\x0c\r"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITE = r"(?i)^[+-]?inf(inity)?$"


def is_missing(column: Column | str, tokens: tuple[str, ...] = UTILITY_TOKENS, any_case: bool = True) -> Column:
    """True for null and for a cell that, trimmed, is one of the tokens."""
    c = F.btrim(F.col(column) if isinstance(column, str) else column, F.lit(BLANKS))
    c, tokens = (F.lower(c), tuple(t.lower() for t in tokens)) if any_case else (c, tokens)
    return c.isNull() | c.isin(*tokens)


def parse_number(column: Column | str, decimal: str = ".", tokens: tuple[str, ...] = READER_TOKENS) -> Column:
    """Double of a text cell; null where it is missing or no number. Infinities are numbers, suffixes such as 1d aren't."""
    c = F.btrim(F.col(column) if isinstance(column, str) else column, F.lit(BLANKS))
    swapped = F.replace(c, F.lit(","), F.lit(".")) if decimal == "," else c
    sign = F.when(F.startswith(c, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    number = F.when(swapped.rlike(NUMBER), swapped.try_cast("double")).when(c.rlike(INFINITE), sign)
    return F.when(is_missing(c, tokens, any_case=False), None).otherwise(number)


def is_numeric(column: Column | str, decimal: str = ".", tokens: tuple[str, ...] = READER_TOKENS) -> Column:
    """Whether a cell is a number or missing."""
    return is_missing(column, tokens, any_case=False) | parse_number(column, decimal, tokens).isNotNull()


def finite_or_null(column: Column) -> Column:
    """Nulls for NaN and infinities, as JSON and CSV ask for."""
    return F.when(F.isnan(column) | (F.abs(column) == float("inf")), None).otherwise(column)


def general(column: Column, digits: int = 6) -> Column:
    """Text of at most ``digits`` significant digits, with an exponent below -4 and from ``digits`` on."""
    rough = F.format_string(f"%.{digits - 1}e", column.cast("double"))
    power = F.substring_index(rough, "e", -1).cast("int")
    bare = lambda text: F.when(F.contains(text, F.lit(".")), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
    out = F.concat(bare(F.substring_index(rough, "e", 1)), F.lit("e"), F.substring_index(rough, "e", -1))
    for k in range(-4, digits):
        out = F.when(power == k, bare(F.format_string(f"%.{max(0, digits - 1 - k)}f", column.cast("double")))).otherwise(out)
    return F.when(column == 0, "0").otherwise(out)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_quantile(p: float, d1: float, d2: float) -> float:
    """Quantile of the F distribution, by bisection of the beta variable."""
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if incomplete_beta(d1 / 2, d2 / 2, mid) < p else (low, mid)
    x = (low + high) / 2
    return d2 * x / (d1 * (1 - x)) if x < 1 else math.inf


def correlation_p_value(r: float | None, n: int, exact: bool = False) -> float:
    """Two-sided p of a correlation of n pairs: normal beyond 30 degrees of freedom, else (df/(df+t^2))^(df/2).

    The latter isn't Student's distribution; ``exact`` uses that one at every n.
    """
    df = n - 2
    if r is None or n < 3:
        return 0.0
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * df / (1 - r * r)
    if exact:
        return incomplete_beta(df / 2, 0.5, df / (df + t2))
    if df > 30:
        return math.erfc(math.sqrt(t2 / 2))
    return (df / (df + t2)) ** (df / 2)
