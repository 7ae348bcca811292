"""Column functions with the exact roundings and fallbacks that prices, identities and dates need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = str | Column


def c(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round2(x: Name) -> Column:
    """Paisa: half away from zero on the scaled double, which differs from rounding the decimal text."""
    return F.round(c(x) * 100.0) / 100.0


def fixed6(x: Name) -> Column:
    """Six places, the same in any engine: floor(|x| * 1e6 + 0.5) with the sign put back."""
    v = c(x).cast("double")
    return F.signum(v) * F.floor(F.abs(v) * 1e6 + 0.5) / 1e6


def round4(x: Name) -> Column:
    """Four places as floor(x * 1e4 + 0.5) / 1e4, for numbers not below 0."""
    return F.floor(c(x) * 1e4 + 0.5) / 1e4


def months_before(day: Name, months: int) -> Column:
    """`months` earlier, days past the target month's end running over into the next: 31 March less one month is 2 or 3 March."""
    d = c(day)
    return F.date_add(F.add_months(F.trunc(d, "MM"), -months), F.dayofmonth(d) - 1)


def finite(x: Name, what: str) -> Column:
    """The number, or an error for NaN and infinities, which would sort above all others."""
    v = c(x)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.raise_error(F.lit(f"{what} is not finite")).cast("double")).otherwise(v)


def _isin_digits(isin: Column) -> Column:
    """The digits of an ISIN, letters as two (A = 10 .. Z = 35)."""
    chars = F.filter(F.split(F.upper(isin), ""), lambda x: x != "")
    return F.array_join(F.transform(chars, lambda x: F.when(x.rlike("[A-Z]"), (F.ascii(x) - 55).cast("string")).otherwise(x)), "")


def well_formed_isin(isin: Name) -> Column:
    return F.coalesce(c(isin).rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$"), F.lit(False))


def isin_check_ok(isin: Name) -> Column:
    """The check digit by the mod-10 rule over the expanded digits, every second one from the right but one doubled."""
    x = c(isin)
    digits = F.transform(F.filter(F.split(F.reverse(_isin_digits(x)), ""), lambda d: d != ""), lambda d: d.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d >= 5, d * 2 - 9).otherwise(d * 2))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
    return F.when(well_formed_isin(x), total % 10 == 0).otherwise(False)


def issuer_prefix(isin: Name) -> Column:
    return F.substring(c(isin), 1, 9)


def issue_serial(isin: Name) -> Column:
    """Positions 10 and 11 as a number; null if they are no digits."""
    s = F.substring(c(isin), 10, 2)
    return F.when(s.rlike("^[0-9]{2}$"), s.cast("int"))


def slug(name: Name) -> Column:
    """Upper-case letters and digits of a name, UNKNOWN if there are none."""
    return F.coalesce(F.nullif(F.regexp_replace(F.upper(c(name)), "[^A-Z0-9]", ""), F.lit("")), F.lit("UNKNOWN"))


def plain_name(name: Name) -> Column:
    return F.upper(F.regexp_replace(F.trim(c(name)), r"\s+", " "))


#: Face-value factors that a boundary step may have. Each covers +-25 %.
RATIO_BANDS = (("1/1", 1.0), ("1/2", 0.5), ("2/5", 0.4), ("1/4", 0.25), ("1/5", 0.2), ("1/10", 0.1), ("1/20", 0.05), ("1/50", 0.02), ("1/100", 0.01))
BAND = 0.25


def ratio_band(ratio: Name, bands: tuple[tuple[str, float], ...] = RATIO_BANDS, tolerance: float = BAND) -> Column:
    """The band with the nearest relative error within the tolerance, the first of equals; null if none holds the ratio."""
    r = c(ratio)
    near = F.array(*[F.struct((F.abs(r - v) / v).alias("error"), F.lit(i).alias("place"), F.lit(n).alias("band"), F.lit(v).alias("value")) for i, (n, v) in enumerate(bands)])
    held = F.filter(near, lambda b: (r >= b.value * (1 - tolerance)) & (r <= b.value * (1 + tolerance)))
    return F.array_min(held).band


MIN_STEP = 0.09


def simple_fraction(ratio: Name, tolerance: float) -> Column:
    """struct(num, den) of the first num / den (den 1..10, then num 1..20, num <> den) within a relative tolerance of the ratio; null
    for ratios within MIN_STEP of 1 or not above 0."""
    r = c(ratio).cast("double")
    grid = F.array(*[F.struct(F.lit(n).alias("num"), F.lit(d).alias("den")) for d in range(1, 11) for n in range(1, 21) if n != d])
    hit = F.get(F.filter(grid, lambda f: F.abs(r / (f.num.cast("double") / f.den) - 1.0) <= tolerance), F.lit(0))
    return F.when((r > 0) & (F.abs(r - 1.0) >= MIN_STEP), hit)
