"""Column functions for rounding, noise and guarded statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefix of every hashed draw in tests. A production release sets its own secret.
SALT = "42"


def clean(value: Column) -> Column:
    """A double without NaN: NaN becomes null, so that no aggregate ranks it."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def _power(x: Column, digits: int) -> Column:
    """The power of ten that `digits` significant figures of x are whole multiples of, negated."""
    return F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))


def _rounded(x: Column, d: Column, scale: Column) -> Column:
    moved = F.when(d >= 0, F.rint(x * scale) / scale).otherwise(F.rint(x / scale) * scale)
    return F.when(F.abs(x) == float("inf"), x).otherwise(F.coalesce(moved, x))


def significant(value: Column, digits: int) -> Column:
    """Round to `digits` significant figures, ties to even. Null, 0 and infinities pass."""
    x = value.cast("double")
    d = _power(x, digits)
    return _rounded(x, d, F.pow(F.lit(10.0), F.abs(d)))


def significant_columns(df: DataFrame, columns: list[str], digits: int) -> DataFrame:
    """`significant` of many columns of rows, in steps that each use the one before: as one
    expression a column would be computed many times, by code too long to be compiled."""
    if not columns:
        return df
    df = df.withColumns({f"_d_{c}": _power(F.col(c).cast("double"), digits) for c in columns})
    df = df.withColumns({f"_s_{c}": F.pow(F.lit(10.0), F.abs(f"_d_{c}")) for c in columns})
    df = df.withColumns({c: _rounded(F.col(c).cast("double"), F.col(f"_d_{c}"), F.col(f"_s_{c}")) for c in columns})
    return df.drop(*[f"{k}{c}" for c in columns for k in ("_d_", "_s_")])


def report(value: Column) -> Column:
    """Six significant figures, null where the value is not finite."""
    x = clean(value)
    return F.when(F.abs(x) != float("inf"), significant(x, 6))


def percent(part: Column, whole: Column) -> Column:
    return report(F.try_divide(part.cast("double") * 100.0, whole.cast("double")))


def tenth(value: Column) -> Column:
    """One decimal, ties to even."""
    return F.rint(value * 10.0) / 10.0


def draw_key(*parts: Column) -> Column:
    """An unambiguous text key of a draw; timestamps as epoch seconds, nulls as \\N."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts])


def uniform(key: Column, salt: str = SALT) -> Column:
    """A number in (-0.5, 0.5) that depends on the key alone, however rows are dealt."""
    digest = F.substring(F.md5(F.concat(F.lit(salt + "|"), key).cast("binary")), 1, 8)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / 4294967296.0 - 0.5


def laplace(key: Column, scale: Column | float, salt: str = SALT) -> Column:
    u = uniform(key, salt)
    b = scale if isinstance(scale, Column) else F.lit(float(scale))
    return -b * F.signum(u) * F.ln(1.0 - 2.0 * F.abs(u))


def noisy_count(count: Column, key: Column, scale: Column | float, salt: str = SALT) -> Column:
    """max(0, round(count + Laplace(0, scale)))."""
    return F.greatest(F.lit(0.0), F.rint(count.cast("double") + laplace(key, scale, salt))).cast("long")


def quantile(value: Column, q: float) -> Column:
    """The exact quantile by linear interpolation (an aggregate)."""
    return F.percentile(value, F.lit(float(q)))
