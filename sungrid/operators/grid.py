"""Regular time grids: spines, resampling, alignment, gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timecols import SECOND, ceil_ts, floor_ts, from_micros, micros, utc_to_local
from ..session import cut_lineage
from .keys import match
from .blocks import DAY, neighbours, previous_row, running_sum

SPINE_CHUNK = 4096  # grid steps made from one chunk row


def spine_between(bounds: DataFrame, *, key: Sequence[str], low: str, high: str, step_s: int, ts: str = "ts") -> DataFrame:
    """All grid times from ``low`` to ``high`` of each series, both included.

    A long series is first cut into chunk rows, which are spread over the
    cluster before each makes its grid times, so no task makes a whole series.
    """
    step = step_s * SECOND
    chunk = step * SPINE_CHUNK
    lo, hi = micros(F.col(low)), micros(F.col(high))
    # A given number of partitions: chunk rows are small, and left to its own Spark
    # would put them together by size, into a task that then makes all grid times.
    tasks = int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A span that ends before it begins has no grid times.
    chunks = bounds.where(F.col(low) <= F.col(high)).select(
        *key, hi.alias("_hi"), F.explode(F.sequence(lo, hi, F.lit(chunk).cast("long"))).alias("_from")
    ).repartition(tasks, *key, "_from")
    last = F.least(F.col("_hi"), F.col("_from") + (chunk - step))
    times = F.explode(F.sequence(F.col("_from"), last, F.lit(step).cast("long")))
    return chunks.select(*key, times.alias("_us")).select(*key, from_micros(F.col("_us")).alias(ts))


def series_bounds(df: DataFrame, *, key: Sequence[str], ts: str, step_s: int, ceil: bool = True) -> DataFrame:
    high = ceil_ts(F.max(ts), step_s) if ceil else floor_ts(F.max(ts), step_s)
    return df.groupBy(*key).agg(floor_ts(F.min(ts), step_s).alias("_low"), high.alias("_high"))


def time_spine(df: DataFrame, *, key: Sequence[str], ts: str, step_s: int, ceil: bool = True) -> DataFrame:
    """Uniform grid from the first to the last time of each series."""
    bounds = series_bounds(df, key=key, ts=ts, step_s=step_s, ceil=ceil)
    return spine_between(bounds, key=key, low="_low", high="_high", step_s=step_s, ts=ts)


AGGREGATES = {
    "mean": lambda x, ts: F.avg(x),
    "sum": lambda x, ts: F.coalesce(F.sum(x), F.lit(0.0)),  # an empty bin sums to zero
    "max": lambda x, ts: F.max(x),
    "min": lambda x, ts: F.min(x),
    "std": lambda x, ts: F.stddev_samp(x),
    "last": lambda x, ts: F.max(F.when(x.isNotNull(), F.struct(ts.alias("t"), x.alias("x"))))["x"],  # the last known value by time; the largest of equal times
    "count": lambda x, ts: F.count(x),
}


def resample(df: DataFrame, *, key: Sequence[str], ts: str, step_s: int, aggs: dict[str, tuple[str, str]],
             empty_bins: bool = True) -> DataFrame:
    """Bin each series at ``step_s`` seconds; ``aggs`` maps result to (column, how).

    Columns that ``df`` lacks are left out. Empty bins appear by adding the grid
    times as rows without values: one shuffle, with map-side partial sums, and
    no join of the grid with the data.
    """
    present = {out: spec for out, spec in aggs.items() if spec[0] in df.columns}
    used = list(dict.fromkeys(spec[0] for spec in present.values()))
    rows = df.select(*key, floor_ts(F.col(ts), step_s).alias("_bin"), F.col(ts).alias("_ts"), *used)
    if empty_bins:
        grid = time_spine(df, key=key, ts=ts, step_s=step_s, ceil=False)
        empty = grid.select(*key, F.col(ts).alias("_bin"))
        rows = rows.unionByName(empty, allowMissingColumns=True)
    measures = [AGGREGATES[how](F.col(c), F.col("_ts")).alias(out) for out, (c, how) in present.items()]
    return rows.groupBy(*key, "_bin").agg(*measures).withColumnRenamed("_bin", ts)


def resample_from_start(df: DataFrame, *, key: Sequence[str], ts: str, step_s: int,
                        aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """As ``resample``, with bins counted from the first time of each series."""
    starts = cut_lineage(df.groupBy(*key).agg(micros(F.min(ts)).alias("_start"), micros(F.max(ts)).alias("_end")))
    step = F.lit(step_s * SECOND)
    rows = match(df, starts.select(*key, "_start"), key)
    rows = rows.select(*df.columns, floor_ts(F.col(ts), step_s, F.col("_start")).alias("_bin"))
    ends = starts.select(*key, from_micros(F.col("_start")).alias("_low"),
                         from_micros(F.col("_end") - F.pmod(F.col("_end") - F.col("_start"), step)).alias("_high"))
    grid = spine_between(ends, key=key, low="_low", high="_high", step_s=step_s, ts="_bin")
    rows = rows.unionByName(grid, allowMissingColumns=True)
    measures = [AGGREGATES[how](F.col(c), F.col(ts)).alias(out) for out, (c, how) in aggs.items()]
    return rows.groupBy(*key, "_bin").agg(*measures).withColumnRenamed("_bin", ts)


def place_on_grid(df: DataFrame, grid: DataFrame, *, key: Sequence[str], ts: str, cols: Sequence[str],
                  block_s: int = DAY) -> DataFrame:
    """Readings and grid times in one ordered series; ``_grid`` marks grid times.

    The result has the columns of ``neighbours`` for each row that is on the grid.
    """
    marked = grid.select(*key, ts, F.lit(1).alias("_g"))
    rows = df.select(*key, ts, *cols).unionByName(marked, allowMissingColumns=True)
    return neighbours(rows, key=key, ts=ts, cols=cols, block_s=block_s, mark="_g").where("_g = 1").drop("_g")


def _gap(later: Column, earlier: Column) -> Column:
    return micros(later) - micros(earlier)


def nearest_value(c: str, ts: str, tolerance_s: int | None = None) -> Column:
    """The closer of the two known neighbours; a tie takes the later one."""
    t = F.col(ts)
    back, ahead = _gap(t, F.col(f"prev_{c}_ts")), _gap(F.col(f"next_{c}_ts"), t)
    take_next = back.isNull() | (ahead <= back)
    value = F.when(take_next & ahead.isNotNull(), F.col(f"next_{c}")).otherwise(F.col(f"prev_{c}"))
    if tolerance_s is None:
        return value
    return F.when(F.least(back, ahead) <= tolerance_s * SECOND, value)


def linear_value(c: str, ts: str) -> Column:
    """Time-weighted blend of the two neighbours; the last known value after the end."""
    t = F.col(ts)
    p, n, pt, nt = (F.col(f"prev_{c}"), F.col(f"next_{c}"), F.col(f"prev_{c}_ts"), F.col(f"next_{c}_ts"))
    share = F.try_divide(_gap(t, pt).cast("double"), _gap(nt, pt).cast("double"))
    return F.when(pt == nt, p).when(n.isNull(), p).otherwise(p + (n - p) * share)


def reindex_nearest(df: DataFrame, *, key: Sequence[str], ts: str, cols: Sequence[str], step_s: int,
                    grid: DataFrame | None = None, tolerance_s: int | None = None, block_s: int = DAY, known: bool = True) -> DataFrame:
    """Give each grid time the reading nearest to it. Times of a series are unique.

    The nearest known value of each column, or with ``known`` off the values of the
    nearest row, missing ones too.
    """
    grid = time_spine(df, key=key, ts=ts, step_s=step_s) if grid is None else grid
    if not known:
        rows = df.select(*key, ts, F.struct(*cols).alias("_row"))
        placed = place_on_grid(rows, grid, key=key, ts=ts, cols=["_row"], block_s=block_s)
        near = nearest_value("_row", ts, tolerance_s)
        return placed.select(*key, ts, near.alias("_near")).select(*key, ts, *[F.col(f"_near.`{c}`").alias(c) for c in cols])
    placed = place_on_grid(df, grid, key=key, ts=ts, cols=cols, block_s=block_s)
    return placed.select(*key, ts, *[nearest_value(c, ts, tolerance_s).alias(c) for c in cols])


def upsample_linear(df: DataFrame, *, key: Sequence[str], ts: str, cols: Sequence[str], step_s: int,
                    block_s: int = DAY) -> DataFrame:
    """Insert grid times between the rows of a coarser series, by straight lines."""
    grid = time_spine(df, key=key, ts=ts, step_s=step_s)
    placed = place_on_grid(df, grid, key=key, ts=ts, cols=cols, block_s=block_s)
    return placed.select(*key, ts, *[linear_value(c, ts).alias(c) for c in cols])


def fill_edges(df: DataFrame, *, key: Sequence[str], ts: str, cols: Sequence[str], block_s: int = DAY) -> DataFrame:
    """Carry the last known value forward, then the first known one back."""
    near = neighbours(df, key=key, ts=ts, cols=cols, block_s=block_s)
    filled = {c: F.coalesce(f"prev_{c}", f"next_{c}") for c in cols}
    return near.withColumns(filled).select(*df.columns)


def common_range(left: DataFrame, right: DataFrame, *, key: Sequence[str], ts: str) -> DataFrame:
    """Per series: the span that both sides cover. Series that one side lacks are
    left out; where the sides do not overlap, ``lo`` is after ``hi``."""
    ends = [side.groupBy(*key).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")) for side in (left, right)]
    both = ends[0].unionByName(ends[1]).groupBy(*key).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.count(F.lit(1)).alias("_n"))
    return both.where("_n = 2").drop("_n")


def clip_to_range(df: DataFrame, span: DataFrame, *, key: Sequence[str], ts: str) -> DataFrame:
    return match(df, cut_lineage(span), key).where(F.col(ts).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def impute_range(df: DataFrame, coefficients: DataFrame, *, key: Sequence[str], ts: str, target: str, driver: str,
                 zone: str, first_day: str, last_day: str) -> DataFrame:
    """Replace all target values of local days by a fitted line on the driver.

    ``coefficients`` has ``intercept`` and ``slope`` per series. Adds ``imputed``.
    """
    local_day = F.to_date(utc_to_local(F.col(ts), zone))
    hit = local_day.between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")) & F.col(driver).isNotNull()
    line = F.greatest(F.col("intercept") + F.col("slope") * F.col(driver), F.lit(0.0))
    out = match(df, cut_lineage(coefficients.select(*key, "intercept", "slope")), key, "left")
    hit = hit & F.col("slope").isNotNull()
    return out.withColumns({
        target: F.when(hit, line).otherwise(F.col(target)),
        "imputed": F.coalesce(hit, F.lit(False)).cast("int"),
    }).drop("intercept", "slope")


def subhourly_stats(df: DataFrame, hourly: DataFrame, *, key: Sequence[str], ts: str,
                    stats: dict[str, Sequence[str]], block_s: int = 30 * DAY) -> DataFrame:
    """Statistics inside each hour, attached to the hourly rows, gaps filled.

    All statistics come from one aggregation; ``stats`` maps column to names.
    """
    fine = df.select(*key, floor_ts(F.col(ts), 3600).alias("_bin"), F.col(ts).alias("_ts"), *stats)
    names = [f"{c}_{how}" for c, hows in stats.items() for how in hows]
    measures = [AGGREGATES[how](F.col(c), F.col("_ts")).alias(f"{c}_{how}") for c, hows in stats.items() for how in hows]
    per_hour = fine.groupBy(*key, "_bin").agg(*measures).withColumnRenamed("_bin", ts)
    joined = match(hourly, per_hour, [*key, ts], "left")
    return fill_edges(joined, key=key, ts=ts, cols=names, block_s=block_s)


def monthly_energy(df: DataFrame, *, key: Sequence[str], ts: str, power: str) -> DataFrame:
    """Monthly sum in thousands and its running total."""
    month = F.trunc(F.to_date(F.col(ts)), "month").alias("month")
    per_month = df.groupBy(*key, month).agg((F.sum(power) / 1000.0).alias("energy_k"))
    # Months of a series are few, and summed before this window sees them.
    out = running_sum(per_month.withColumn("_m", F.col("month").cast("timestamp_ntz")), key=key, ts="_m",
                      cols={"energy_k": "energy_k_total"}, block_s=3650 * DAY)
    return out.drop("_m")


def daily_energy(df: DataFrame, *, key: Sequence[str], ts: str, energy: str) -> DataFrame:
    day = F.to_date(F.col(ts)).alias("day")
    return df.where(F.col(ts).isNotNull()).groupBy(*key, day).agg((F.sum(energy) / 1000.0).alias("energy_kwh"))


def trim_to_first_positive(df: DataFrame, *, key: Sequence[str], ts: str, value: str) -> DataFrame:
    first = cut_lineage(df.where(F.col(value) > 0).groupBy(*key).agg(F.min(ts).alias("first_positive")))
    return match(df, first, key).where(F.col(ts) >= F.col("first_positive"))


def infer_step(df: DataFrame, *, key: Sequence[str], ts: str, block_s: int = DAY) -> DataFrame:
    """Most frequent difference between consecutive times; the smallest on a tie."""
    pairs = previous_row(df.select(*key, ts), key=key, ts=ts, cols={ts: "_before"}, block_s=block_s)
    gap = (micros(F.col(ts)) - micros(F.col("_before"))).alias("_d")
    counts = pairs.where(F.col("_before").isNotNull()).groupBy(*key, gap).agg(F.count(F.lit(1)).alias("_n"))
    best = F.max_by(F.struct("_d", "_n"), F.struct(F.col("_n"), -F.col("_d")))
    return counts.groupBy(*key).agg(best.alias("_b")).select(
        *key, (F.col("_b._d") / SECOND).alias("step_s"), F.col("_b._n").alias("n_steps"))
