"""Whole flows: from raw readings to a prepared data set, and its evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import solar
from ..functions.clean import any_flag, guarded_ratio, night_below
from ..functions.timecols import ceil_ts, cyclical, floor_ts, hour_of_day, local_to_utc
from ..operators import grid, joins, metrics, model, splits
from ..operators.blocks import DAY, block_seconds
from ..operators.keys import match
from ..operators.stats import linear_fit
from ..session import cut_lineage


def time_features(ts: Column, year: float = 365.25) -> dict[str, Column]:
    """Hour and day of year with their sine and cosine."""
    hour, day = hour_of_day(ts), F.dayofyear(ts)
    out = {"hour": hour, "day_of_year": day}
    out["hour_sin"], out["hour_cos"] = cyclical(hour, 24.0)
    out["day_sin"], out["day_cos"] = cyclical(day, year)
    return out


def prepare_station(weather: DataFrame, power: DataFrame, places: DataFrame, *, key: Sequence[str], ts: str = "ts",
                    step_s: int = 600, impute_days: tuple[str, str] | None = None, zone: str = "Europe/Vienna",
                    zero_fill: Sequence[str] = ("power_w",), block_s: int | None = None, local_power: bool = False,
                    first_day: str | None = None) -> DataFrame:
    """Weather and inverter readings of many sites as one regular, complete table.

    ``weather`` has ghi_wm2, temp_c, wind_ms and pressure_hpa, ``power`` has
    power_w, and ``places`` lat, lon and alt per series; a series without a place
    keeps its readings, without sun columns. Both are cut to their
    common span and set on one grid by nearest reading; sun, clear-sky and night
    columns follow, then imputation of listed days, and time columns.

    With ``local_power`` the inverter's times are wall-clock times of ``zone``: they
    become UTC, and times of the spring gap and the autumn fold are dropped.
    ``first_day`` cuts both tables to that day (UTC) and later.
    """
    if local_power:
        power = power.withColumn(ts, local_to_utc(F.col(ts), zone)).where(F.col(ts).isNotNull())
    if first_day:
        weather, power = (df.where(F.col(ts) >= F.lit(first_day).cast("timestamp_ntz")) for df in (weather, power))
    weather_cols = [c for c in weather.columns if c not in (*key, ts)]
    power_cols = [c for c in power.columns if c not in (*key, ts)]
    if block_s is None:  # readings come at irregular times: blocks by the density of the denser table
        block_s = min(block_seconds(df, key=key, ts=ts) for df in (weather, power))
    span = cut_lineage(grid.common_range(weather, power, key=key, ts=ts))
    ends = span.select(*key, floor_ts(F.col("lo"), step_s).alias("lo"), ceil_ts(F.col("hi"), step_s).alias("hi"))
    times = grid.spine_between(ends, key=key, low="lo", high="hi", step_s=step_s, ts=ts)
    cut = [grid.clip_to_range(df, span, key=key, ts=ts) for df in (weather, power)]
    table = joins.asof_nearest(cut[0], cut[1], times, key=key, ts=ts, left_cols=weather_cols, right_cols=power_cols, step_s=step_s, block_s=block_s)

    table = solar.with_sun(match(table, cut_lineage(places), key, "left"), ts=ts)
    table = table.withColumn("aoi_deg", solar.incidence_angle(F.col("zenith_deg"), F.col("azimuth_deg")))
    table = table.withColumn("_p", solar.pressure_pa(F.col("pressure_hpa"), F.col("alt")))
    table = table.withColumns(solar.clear_sky(F.col("apparent_elev_deg"), F.col("_p"))).drop("_p")
    dark = any_flag(night_below(F.col("ghi_wm2"), 10), solar.solar_night(F.col("apparent_elev_deg")))
    table = table.withColumns({"csi": guarded_ratio(F.col("ghi_wm2"), F.col("clear_ghi"), above=10), "is_night": dark})
    if impute_days:
        table = cut_lineage(table)  # the fit and the data both read it
        line = linear_fit(table, key=key, x="ghi_wm2", y="power_w", x_above=50)
        table = grid.impute_range(table, line, key=key, ts=ts, target="power_w", driver="ghi_wm2", zone=zone,
                                  first_day=impute_days[0], last_day=impute_days[1])
    return table.fillna(0.0, subset=[c for c in zero_fill if c in table.columns]).withColumns(time_features(F.col(ts)))


# How each column of a prepared table becomes hourly; energy_wh is a running counter.
HOURLY = {
    "ghi_wm2": "mean", "temp_c": "mean", "wind_ms": "mean", "precip_mm": "sum", "pressure_hpa": "mean", "energy_wh": "last", "energy_interval": "sum", "power_w": "mean",
    "zenith_deg": "mean", "azimuth_deg": "mean", "aoi_deg": "mean", "clear_ghi": "mean", "clear_dni": "mean", "clear_dhi": "mean", "csi": "mean",
    "is_night": "max",
}


def to_hourly(table: DataFrame, *, key: Sequence[str], ts: str = "ts") -> DataFrame:
    """The hourly form of a prepared table, for the columns it has."""
    aggs = {c: (c, how) for c, how in HOURLY.items()}
    return grid.resample(table, key=key, ts=ts, step_s=3600, aggs=aggs).withColumns(time_features(F.col(ts)))


def evaluate_baseline(table: DataFrame, *, key: Sequence[str], ts: str = "ts", ghi: str = "ghi_wm2", power: str = "power_w",
                      block_s: int = 365 * DAY) -> DataFrame:
    """Error measures per series of the linear baseline on the last 15 %."""
    rows = cut_lineage(splits.chrono_split(table.dropna(subset=[ghi, power]).select(*key, ts, ghi, power), key=key, ts=ts, block_s=block_s))
    pred = model.linear_baseline(rows, key=key, x=ghi, y=power, ghi=ghi)
    y, p = F.col(power), F.col("y_pred")
    return metrics.measure(pred, metrics.basic(y, p), metrics.pearson_r2(y, p), metrics.mape(y, p), metrics.smape(y, p), metrics.relative(y, p), group=key)
