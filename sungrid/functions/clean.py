"""Cleaning of text cells, units, flags and ranges, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Texts that mean "no value" in the inverter exports.
MISSING_TOKENS = ("n/a", "#WERT!", "")

# Fixed value: the units row starts with a bracketed unit, such as "[Wh]".
UNITS_CELL = r"\[.*\]"


def drop_units_rows(df: DataFrame, first: str) -> DataFrame:
    return df.where(F.col(first).isNull() | ~F.col(first).rlike(UNITS_CELL))


def no_nan(x: Column) -> Column:
    """NULL where a double is NaN, which would spoil every mean it enters."""
    return F.when(~F.isnan(x), x)


def coerce_double(text: Column) -> Column:
    """Number in ``text``, or NULL where there is none; the text NaN is none."""
    return no_nan(text.try_cast("double"))


def euro_double(text: Column, missing: Sequence[str] = MISSING_TOKENS) -> Column:
    """Number written with a decimal comma; missing tokens become NULL."""
    trimmed = F.trim(text)
    kept = F.when(~trimmed.isin(*missing), trimmed)
    return coerce_double(F.replace(kept, F.lit(","), F.lit(".")))


def comma_text(number: Column) -> Column:
    """The number as text with a decimal comma."""
    return F.replace(number.cast("string"), F.lit("."), F.lit(","))


def select_present(df: DataFrame, renames: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Keep and rename the columns of ``renames`` that ``df`` has."""
    have = set(df.columns)
    cols = [F.col(f"`{c}`") for c in keep if c in have]
    cols += [F.col(f"`{old}`").alias(new) for old, new in renames.items() if old in have]
    return df.select(*cols)


def pick_column(columns: Sequence[str], terms: Sequence[str]) -> str:
    """The first column whose name holds any of ``terms``; else the second column."""
    return next((name for name in columns if any(term in name for term in terms)), columns[1])


def first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of ``names`` that ``df`` has; an error where it has none."""
    for name in names:
        if name in df.columns:
            return F.col(f"`{name}`")
    raise ValueError(f"none of {list(names)} among {df.columns}")


def keep_good(df: DataFrame, flags: Sequence[str], good: int = 12) -> DataFrame:
    """Rows whose every present quality flag is ``good``."""
    present = [F.col(f) == good for f in flags if f in df.columns]
    return df.where(reduce(lambda a, b: a & b, present)) if present else df


def energy_to_power(energy_wh: Column, step_minutes: int = 5) -> Column:
    """Energy of one step in Wh to mean power in W."""
    return energy_wh * F.lit(60 / step_minutes)


def magnitude(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound ``x``; NULL stays NULL (greatest and least would skip it)."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def night_below(x: Column, threshold: float) -> Column:
    """1 where the radiation is below the threshold; missing counts as zero."""
    return (F.coalesce(x, F.lit(0.0)) < threshold).cast("int")


def any_flag(*flags: Column) -> Column:
    """1 where one of the flags is set; missing flags count as 0."""
    filled = [F.coalesce(f, F.lit(0)) for f in flags]
    return F.greatest(*filled) if len(filled) > 1 else filled[0]


def guarded_ratio(num: Column, den: Column, above: float, high: float = 1.5) -> Column:
    """``num / den`` bounded to [0, high] where ``den`` exceeds ``above``, else 0."""
    ratio = F.when(den > above, F.try_divide(num, den)).otherwise(F.lit(0.0))
    return clip(ratio, 0.0, high)


def row_mean(*cols: Column) -> Column:
    """Mean over the columns of a row, skipping missing ones."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.try_divide(total, count)


def cloud_to_index(cloud: Column | None, default: Column | float = 0.5) -> Column:
    """Clear-sky index from cloud cover: what the clouds leave, or a default."""
    fallback = F.lit(float(default)) if isinstance(default, (int, float)) else default
    return fallback if cloud is None else F.coalesce(F.lit(1.0) - cloud, fallback)


def to_rated(fraction: Column, rated_w: float = 5000.0) -> Column:
    return fraction * F.lit(float(rated_w))


def from_rated(power_w: Column, rated_w: float = 5000.0) -> Column:
    return power_w / F.lit(float(rated_w))


def zero_without_radiation(pred: Column, ghi: Column, below: float = 1.0, zero: Column | float = 0.0) -> Column:
    """Predictions become the (scaled) zero where there is no radiation."""
    z = F.lit(float(zero)) if isinstance(zero, (int, float)) else zero
    return F.when(ghi < below, z).otherwise(pred)
