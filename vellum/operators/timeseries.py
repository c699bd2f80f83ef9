"""Time-series preparation and forecasting for many series at once.

Series are identified by ``keys`` (zero or more columns); every step is
a grouped aggregation or a window partitioned by the key, so thousands of
series are fitted in one job. The models are closed-form re-aims of the
reference's solvers (which are single-machine maximum-likelihood fits):

* ``trend_weekly`` (for the Prophet call): least-squares line in time
  plus the mean residual per weekday, all from sums per (key, weekday),
  interval +-1.2816 residual std (80 %);
* ``arma_diff`` (for ARIMA(1,1,1)): ARMA(1,1) with intercept on first
  differences by two regressions (Hannan and Rissanen), interval from the
  psi weights; ``ar_diff``: AR(1) on first differences, forecast by the
  recursion d_h = c + phi d_(h-1), interval +-1.2816 sigma sqrt(h);
  ``seasonal_ar`` (for SARIMA): the same on differences at the seasonal lag;
* ``simple``: mean, last value or seasonal naive.

A null key is a series of its own everywhere. They are not numerically equal to Prophet / statsmodels fits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.numeric import to_number, to_timestamp
from vellum.operators import ordered
from vellum.operators.common import col

Z80 = 1.2816
GRID_BLOCK = 4096

# Fixed frequency aliases understood by asfreq / future / infer_freq.
STEP_SECONDS = {"D": 86400, "h": 3600, "H": 3600, "min": 60, "T": 60, "s": 1, "S": 1}
# month-based aliases: (months per step, period unit, anchored at the period end)
MONTH_FREQS = {"MS": (1, "month", False), "M": (1, "month", True), "ME": (1, "month", True),
               "QS": (3, "quarter", False), "Q": (3, "quarter", True), "QE": (3, "quarter", True),
               "YS": (12, "year", False), "AS": (12, "year", False), "Y": (12, "year", True),
               "YE": (12, "year", True), "A": (12, "year", True)}
MODELS = ("prophet", "arima", "sarima", "simple")


def prepare(df: DataFrame, time_col: str, target_col: str, keys=()) -> DataFrame:
    """``keys..., ds, y``: parsed time, numeric target, duplicate timestamps averaged."""
    dt = df.schema[time_col].dataType
    ds = to_timestamp(col(time_col), dt=dt)
    if isinstance(dt, (T.DateType, T.TimestampNTZType)):
        ds = col(time_col)
    y = to_number(col(target_col), df.schema[target_col].dataType)
    base = df.select(*[col(k) for k in keys], ds.alias("ds"), y.alias("y")).filter(F.col("ds").isNotNull())
    return base.groupBy(*keys, "ds").agg(F.avg("y").alias("y"))


def attach(rows: DataFrame, per_key: DataFrame, keys=(), on=(), how: str = "left") -> DataFrame:
    """``rows`` with the other columns of ``per_key`` joined by the keys, null
    being a key like any other, and by the columns ``on``."""
    names = [*keys, *on]
    if not names:
        return _with_row(rows, per_key)
    other = per_key.select(*[col(k).alias(f"_on{i}") for i, k in enumerate(names)],
                           *[col(c) for c in per_key.columns if c not in names])
    same = reduce(lambda a, b: a & b, [
        col(k).eqNullSafe(F.col(f"_on{i}")) if k in keys else col(k) == F.col(f"_on{i}") for i, k in enumerate(names)])
    return rows.join(other, same, how).drop(*[f"_on{i}" for i in range(len(names))])


def _seconds(c: Column) -> Column:
    """Seconds since the epoch for DATE / TIMESTAMP / TIMESTAMP_NTZ (UTC session)."""
    return F.unix_micros(c.cast("timestamp")) / 1e6


def infer_freq(df: DataFrame, keys=(), ds: str = "ds") -> DataFrame:
    """``keys..., freq``: D/h/min/s or W-SUN (constant step), MS / M, QS / Q,
    YS / Y (period starts / ends one period apart), else null. Needs at least
    3 timestamps per series."""
    # previous timestamp of the same series without a per-series window (skew-safe)
    prev = ordered.previous_in_key(df.select(*keys, ds), [ds], [ds], list(keys))
    p = F.col(f"prev_{ds}")
    step = _seconds(F.col(ds)) - _seconds(p)
    months = (F.year(ds) * 12 + F.month(ds)) - (F.year(p) * 12 + F.month(p))
    steps = prev.select(*keys, F.col(ds), step.alias("step"), months.alias("months"))
    g = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("step").alias("lo"), F.max("step").alias("hi"),
        F.min("months").alias("mlo"), F.max("months").alias("mhi"),
        F.bool_and(F.dayofmonth(ds) == 1).alias("starts"),
        F.bool_and(F.to_date(F.col(ds)) == F.last_day(F.col(ds))).alias("ends"),
        F.bool_and(F.dayofweek(ds) == 1).alias("sundays"),
        F.bool_and(F.month(ds) % 3 == 1).alias("q_start_months"), F.bool_and(F.month(ds) % 3 == 0).alias("q_end_months"),
        F.bool_and(F.month(ds) == 1).alias("jan"), F.bool_and(F.month(ds) == 12).alias("dec"))
    const = F.col("lo") == F.col("hi")
    freq = (F.when(F.col("n") < 3, None)
            .when(const & (F.col("lo") == 604800) & F.col("sundays"), "W-SUN")
            .when(const & (F.col("lo") == 86400), "D").when(const & (F.col("lo") == 3600), "h")
            .when(const & (F.col("lo") == 60), "min").when(const & (F.col("lo") == 1), "s")
            .when((F.col("mlo") == 1) & (F.col("mhi") == 1) & F.col("starts"), "MS")
            .when((F.col("mlo") == 1) & (F.col("mhi") == 1) & F.col("ends"), "M")
            .when((F.col("mlo") == 3) & (F.col("mhi") == 3) & F.col("starts") & F.col("q_start_months"), "QS")
            .when((F.col("mlo") == 3) & (F.col("mhi") == 3) & F.col("ends") & F.col("q_end_months"), "Q")
            .when((F.col("mlo") == 12) & (F.col("mhi") == 12) & F.col("starts") & F.col("jan"), "YS")
            .when((F.col("mlo") == 12) & (F.col("mhi") == 12) & F.col("ends") & F.col("dec"), "Y"))
    return g.select(*keys, F.col("n").alias("points"), freq.alias("freq"))


def _grid(span: DataFrame, start: Column, stop: Column, freq: str) -> DataFrame:
    """Rows of ``span`` once per grid timestamp ``_g`` from ``start`` (the first
    point) to ``stop``. Steps of a fixed length are made block by block, so
    no row holds more than a list of blocks or ``GRID_BLOCK`` points; weeks
    and months are few."""
    if freq in STEP_SECONDS:
        step = STEP_SECONDS[freq]
        last = F.floor((F.unix_micros(stop.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(step * 1_000_000))
        blocks = span.select("*", last.cast("long").alias("_last")).select(
            "*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / GRID_BLOCK))).alias("_block"))
        points = F.sequence(F.col("_block") * GRID_BLOCK, F.least(F.col("_last"), F.col("_block") * GRID_BLOCK + (GRID_BLOCK - 1)))
        return blocks.select("*", F.explode(points).alias("_nth")).withColumn(
            "_g", start + F.make_dt_interval(secs=(F.col("_nth") * step).cast("decimal(18,6)"))).drop("_last", "_block", "_nth")
    return span.select("*", F.explode(_calendar_grid(start, stop, freq)).alias("_g"))


def _calendar_grid(start: Column, stop: Column, freq: str) -> Column:
    """Array of the weeks or months from ``start`` to ``stop``."""
    if freq in ("W", "W-SUN"):
        first = F.next_day(F.date_sub(start, 1), "Sun")
        first_ts = F.to_timestamp_ntz(F.concat(first.cast("string"), F.lit(" "), F.date_format(start, "HH:mm:ss")))
        return F.filter(F.sequence(first_ts, F.greatest(first_ts, stop), F.expr("INTERVAL 7 DAYS")),
                        lambda x: x <= stop)
    if freq in MONTH_FREQS:
        months, unit, at_end = MONTH_FREQS[freq]
        base = F.trunc(start, unit)
        seq = F.sequence(base, F.greatest(base, F.to_date(stop)), F.expr(f"INTERVAL {months} MONTH"))
        if at_end:
            seq = F.transform(seq, lambda x: F.last_day(F.add_months(x, months - 1)))
        return F.filter(F.transform(seq, lambda x: x.cast("timestamp_ntz")), lambda x: (x >= start) & (x <= stop))
    raise ValueError(f"Unsupported frequency '{freq}'")


def _bucket(ts: Column, start: Column, freq: str) -> Column:
    """The grid point that an observation is counted under: the last one not
    after it, or the end of its period for frequencies at period ends."""
    if freq in STEP_SECONDS:
        n = F.floor((_seconds(ts) - _seconds(start)) / STEP_SECONDS[freq])
        return start + F.make_dt_interval(secs=(n * STEP_SECONDS[freq]).cast("decimal(18,6)"))
    if freq in ("W", "W-SUN"):
        sunday = F.next_day(F.date_sub(ts, 1), "Sun")
        return F.to_timestamp_ntz(F.concat(sunday.cast("string"), F.lit(" "), F.date_format(start, "HH:mm:ss")))
    if freq in MONTH_FREQS:
        months, unit, at_end = MONTH_FREQS[freq]
        base = F.trunc(ts, unit)
        return (F.last_day(F.add_months(base, months - 1)) if at_end else base).cast("timestamp_ntz")
    raise ValueError(f"Unknown frequency '{freq}'")


RESAMPLERS = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def resample(df: DataFrame, freq: str, agg: str = "mean", keys=(), ds: str = "ds", y: str = "y") -> DataFrame:
    """One value per grid point and series: all observations are counted in
    their bucket (mean, sum, min, max or count), none is dropped for lying
    off the grid; buckets without an observation between the first and the
    last one are null (0 for ``count``)."""
    if agg not in RESAMPLERS:
        raise ValueError(f"Unknown resampling function '{agg}': one of {sorted(RESAMPLERS)}")
    first = df.groupBy(*keys).agg(F.min(ds).cast("timestamp_ntz").alias("_first"))
    rows = attach(df, first, keys)
    placed = rows.withColumn(ds, _bucket(F.col(ds).cast("timestamp_ntz"), F.col("_first"), freq))
    counted = placed.groupBy(*keys, ds).agg(RESAMPLERS[agg](y).alias(y))
    full = asfreq(counted, freq, keys, ds, y)
    return full.withColumn(y, F.coalesce(F.col(y), F.lit(0))) if agg == "count" else full


def asfreq(df: DataFrame, freq: str, keys=(), ds: str = "ds", y: str = "y") -> DataFrame:
    """Reindex every series on its grid from its first timestamp: values
    exactly on the grid are kept, grid points without a value get null,
    off-grid values are dropped (pandas ``asfreq``; see ``resample``)."""
    span = df.groupBy(*keys).agg(F.min(ds).alias("_lo"), F.max(ds).alias("_hi"))
    is_date = isinstance(df.schema[ds].dataType, T.DateType)
    lo = F.col("_lo").cast("timestamp_ntz") if is_date else F.col("_lo")
    hi = F.col("_hi").cast("timestamp_ntz") if is_date else F.col("_hi")
    grid = _grid(span.filter("_lo IS NOT NULL"), lo, hi, freq)
    grid = grid.select(*keys, (F.col("_g").cast("date") if is_date else F.col("_g")).alias(ds))
    return attach(grid, df.select(*keys, ds, y), keys, [ds])


def fill_gaps(df: DataFrame, keys=(), ds: str = "ds", y: str = "y") -> DataFrame:
    """Forward fill, then backward fill, per series. A running count of known
    values numbers the gap behind each; the value is joined back by (series,
    gap), so neither a long series nor a long gap meets in one task."""
    keys = list(keys)
    known = ordered.running_total(df.withColumn("_known", F.col(y).isNotNull().cast("long")), [*keys, ds], "_known", "_gap")
    known = known.drop("_known")
    value = known.filter(F.col(y).isNotNull()).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_gap").alias("_g"), F.col(y).alias("_fill"))
    match = F.col("_gap") == F.col("_g")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    filled = known.join(value, match, "left").drop("_g", "_gap", *[f"_k{i}" for i in range(len(keys))])
    if keys:
        first = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
            F.min_by(y, F.when(F.col(y).isNotNull(), F.col(ds))).alias("_first"))
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        filled = filled.join(first, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
        start = F.col("_first")
    else:
        start = df.filter(F.col(y).isNotNull()).select(F.min_by(y, ds)).scalar()
    cols = [F.coalesce(F.col(c), F.col("_fill"), start).alias(c) if c == y else F.col(c) for c in df.columns]
    return filled.select(*cols)


def _step_expr(freq: str) -> Callable[[Column, Column], Column]:
    """(last, h) -> timestamp h steps after last."""
    if freq in STEP_SECONDS:
        return lambda last, h: last + F.make_dt_interval(secs=h * STEP_SECONDS[freq])
    if freq in ("W", "W-SUN"):
        return lambda last, h: last + F.make_dt_interval(days=h * 7)
    if freq in MONTH_FREQS:
        # anchored at period boundaries: the h-th period start / end after ``last``
        months, unit, at_end = MONTH_FREQS[freq]
        if at_end:
            def nth_end(last, h):
                base = F.trunc(last, unit)
                current_end = F.last_day(F.add_months(base, months - 1))
                skip = F.when(current_end <= F.to_date(last), 1).otherwise(0)  # current period already ended
                return F.last_day(F.add_months(base, months - 1 + (h - 1 + skip) * months)).cast("timestamp_ntz")
            return nth_end
        return lambda last, h: F.add_months(F.trunc(last, unit), h * months).cast("timestamp_ntz")
    raise ValueError(f"Unsupported frequency '{freq}'")


def future(df: DataFrame, periods: int, freq: str = "D", keys=(), ds: str = "ds") -> DataFrame:
    """``keys..., h, ds`` for the next ``periods`` steps after each series' last point."""
    last = df.groupBy(*keys).agg(F.max(ds).alias("_last"))
    is_date = isinstance(df.schema[ds].dataType, T.DateType)
    step = _step_expr(freq)
    rows = last.select(*keys, "_last", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("h"))
    base = F.col("_last").cast("timestamp_ntz") if is_date else F.col("_last")
    nxt = step(base, F.col("h"))
    return rows.select(*keys, "h", (nxt.cast("date") if is_date else nxt).alias(ds))


def _sums(t: Column, y: Column) -> list[Column]:
    """What a least-squares line needs of its points (missing y: no point)."""
    t = F.when(y.isNotNull(), t)
    return [F.count(y).alias("n"), F.sum(t).alias("t"), F.sum(y).alias("y"), F.sum(t * t).alias("tt"),
            F.sum(t * y).alias("ty"), F.sum(y * y).alias("yy"), F.min(t).alias("lo"), F.max(t).alias("hi")]


def trend_weekly(df: DataFrame, periods: int, freq: str = "D", keys=(), ds: str = "ds", y: str = "y") -> DataFrame:
    """History and future rows: ``keys..., ds, y, trend, yhat, yhat_lower, yhat_upper``.

    Sums per (key, weekday) give line, weekday means and residual deviation
    in closed form; the model, one row per key, is joined back once."""
    keys = list(keys)
    # one origin for all series keeps the sums of squares small
    origin = df.select(F.min(_seconds(F.col(ds)))).scalar()
    t = (_seconds(F.col(ds)) - origin) / 86400.0
    value = F.col(y).cast("double")
    days = df.groupBy(*keys, F.weekday(ds).alias("_wd")).agg(*_sums(t, value), F.max(ds).alias("_end"))
    total = {c: F.sum(c).alias(f"_{c}") for c in ("n", "t", "y", "tt", "ty", "yy")}
    model = days.groupBy(*keys).agg(
        *total.values(), F.min("lo").alias("_lo"), F.max("hi").alias("_hi"), F.max("_end").alias("_last"),
        F.collect_list(F.struct("_wd", "n", "t", "y", "tt", "ty", "yy")).alias("_days"))  # 7 at most
    n, st, sy, stt, sty = (F.col(f"_{c}") for c in ("n", "t", "y", "tt", "ty"))
    slope = F.when(F.col("_hi") > F.col("_lo"), (sty - st * sy / n) / (stt - st * st / n))
    model = model.withColumn("_b", slope).withColumn("_a", (sy - F.col("_b") * st) / n)
    a, b = F.col("_a"), F.col("_b")

    def left(d):  # squared residuals of a weekday around their mean
        mean = (d["y"] - d["n"] * a - b * d["t"]) / d["n"]
        square = (d["yy"] - 2 * a * d["y"] - 2 * b * d["ty"] + d["n"] * a * a + 2 * a * b * d["t"] + b * b * d["tt"])
        return F.when(d["n"] > 0, square - d["n"] * mean * mean).otherwise(F.lit(0.0))
    spread = F.aggregate(F.transform("_days", left), F.lit(0.0), lambda s, x: s + x)
    season = F.map_from_entries(F.transform(F.filter("_days", lambda d: d["n"] > 0), lambda d: F.struct(
        d["_wd"], (d["y"] - d["n"] * a - b * d["t"]) / d["n"])))
    model = model.withColumn("_sigma", F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1)))) \
        .withColumn("_season", season).select(*keys, "_a", "_b", "_sigma", "_season", "_last")
    fitted = ["_a", "_b", "_sigma", "_season"]
    hist = attach(df.select(*keys, ds, value.alias(y)), model.drop("_last"), keys)
    step = _step_expr(freq)
    is_date = isinstance(df.schema[ds].dataType, T.DateType)
    ahead = model.select(*keys, *fitted, "_last", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("h"))
    base = F.col("_last").cast("timestamp_ntz") if is_date else F.col("_last")
    nxt = step(base, F.col("h"))
    ahead = ahead.select(*keys, (nxt.cast("date") if is_date else nxt).alias(ds), F.lit(None).cast("double").alias(y), *fitted)
    rows = hist.select(*keys, ds, y, *fitted).unionByName(ahead)
    trend = a + b * t
    yhat = trend + F.coalesce(F.col("_season")[F.weekday(ds)], F.lit(0.0))
    band = Z80 * F.coalesce(F.col("_sigma"), F.lit(0.0))
    return rows.select(*keys, ds, y, trend.alias("trend"), yhat.alias("yhat"),
                       (yhat - band).alias("yhat_lower"), (yhat + band).alias("yhat_upper"))


def _with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate as scalar subqueries (no join)."""
    out = df
    for c in one_row.columns:
        out = out.withColumn(c, one_row.select(c).scalar())
    return out


def _ar_fit(d: str, lagged: str) -> list[Column]:
    """``_phi`` and ``_c`` of d = c + phi * lagged; constant lagged values (two
    or more) leave the mean."""
    constant = (F.regr_count(d, lagged) >= 2) & (F.regr_sxx(d, lagged) == 0)
    return [F.when(constant, F.lit(0.0)).otherwise(F.regr_slope(d, lagged)).alias("_phi"),
            F.when(constant, F.regr_avgy(d, lagged)).otherwise(F.regr_intercept(d, lagged)).alias("_c")]


def _history_and_forecast(df: DataFrame, fut: DataFrame, keys, ds: str, y: str) -> DataFrame:
    """``keys..., ds, history, forecast, lower, upper``: a forecast begins
    behind its series, so the full outer join on (keys, ds) is a union."""
    return df.select(*keys, ds, F.col(y).alias("history")).unionByName(fut, allowMissingColumns=True)


def ar_diff(df: DataFrame, periods: int, freq: str = "D", keys=(), ds: str = "ds", y: str = "y") -> DataFrame:
    """AR(1) on first differences. Returns history and forecast rows shaped as
    ``keys..., ds, history, forecast, lower, upper``. Where the differences
    are constant there is no slope to fit: they go on as they are."""
    d = ordered.lags(df, y, [1, 2], [ds], list(keys))
    d = d.withColumn("_d", F.col(y) - F.col("lag_1")).withColumn("_dl", F.col("lag_1") - F.col("lag_2"))
    fit = d.groupBy(*keys).agg(*_ar_fit("_d", "_dl"), F.max_by(y, ds).alias("_yT"), F.max_by("_d", ds).alias("_dT"))
    res = attach(d, fit, keys)
    sig = (res.withColumn("_e", F.col("_d") - (F.col("_c") + F.col("_phi") * F.col("_dl")))
           .groupBy(*keys).agg(F.stddev_samp("_e").alias("_sigma")))
    fut = attach(attach(future(df, periods, freq, keys, ds), fit, keys), sig, keys)
    # recursion d_h = c + phi d_(h-1), y_h = y_(h-1) + d_h, evaluated per row over 1..h
    init = F.struct(F.col("_dT").alias("d"), F.col("_yT").alias("y"))
    path = F.aggregate(F.sequence(F.lit(1), F.col("h")), init,
                       lambda acc, _: F.struct((F.col("_c") + F.col("_phi") * acc["d"]).alias("d"),
                                               (acc["y"] + (F.col("_c") + F.col("_phi") * acc["d"])).alias("y")))
    fc = path["y"]
    band = Z80 * F.col("_sigma") * F.sqrt(F.col("h").cast("double"))
    fut = fut.select(*keys, ds, fc.alias("forecast"), (fc - band).alias("lower"), (fc + band).alias("upper"))
    return _history_and_forecast(df, fut, keys, ds, y)


def _plane(d: Column, u: Column, v: Column) -> list[Column]:
    """Moments of the rows where all three are known, for d = c + bu * u + bv * v."""
    known = d.isNotNull() & u.isNotNull() & v.isNotNull()
    d, u, v = (F.when(known, x) for x in (d, u, v))
    return [F.count(d).alias("n"), F.avg(d).alias("md"), F.avg(u).alias("mu"), F.avg(v).alias("mv"),
            F.var_pop(u).alias("uu"), F.var_pop(v).alias("vv"), F.covar_pop(u, v).alias("uv"),
            F.covar_pop(u, d).alias("ud"), F.covar_pop(v, d).alias("vd")]


def _solved(moments: DataFrame, names: tuple[str, str, str], phi: str, c: str) -> DataFrame:
    """Adds ``names`` = (bu, bv, c), the least-squares plane; where its points do
    not span one (or are fewer than four) the line ``phi``, ``c`` instead."""
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    flat = F.coalesce((F.col("n") < 4) | (det <= 1e-9 * F.col("uu") * F.col("vv")), F.lit(True))
    bu = F.when(flat, F.col(phi)).otherwise((F.col("ud") * F.col("vv") - F.col("vd") * F.col("uv")) / det)
    bv = F.when(flat, F.lit(0.0)).otherwise((F.col("vd") * F.col("uu") - F.col("ud") * F.col("uv")) / det)
    out = moments.withColumn(names[0], bu).withColumn(names[1], bv)
    level = F.col("md") - F.col(names[0]) * F.col("mu") - F.col(names[1]) * F.col("mv")
    return out.withColumn(names[2], F.when(flat, F.col(c)).otherwise(level)).drop("n", "md", "mu", "mv", "uu", "vv", "uv", "ud", "vd")


def arma_diff(df: DataFrame, periods: int, freq: str = "D", keys=(), ds: str = "ds", y: str = "y") -> DataFrame:
    """ARMA(1,1) with intercept on first differences (for ARIMA(1,1,1)), by the
    two regressions of Hannan and Rissanen: an AR(2) gives innovations e, then
    d_t = c + phi d_(t-1) + theta e_(t-1). The forecast starts from the last
    innovation; its interval sums the model's psi weights. Output as
    ``ar_diff``, which also stands in where a series is too short or too even."""
    keys = list(keys)
    lagged = ordered.lags(df, y, [1, 2, 3, 4], [ds], keys)
    past = [F.col(y), *[F.col(f"lag_{k}") for k in (1, 2, 3, 4)]]
    for k in range(4):
        lagged = lagged.withColumn(f"_d{k}", past[k] - past[k + 1])
    d, d1, d2, d3 = (F.col(f"_d{k}") for k in range(4))
    first = lagged.groupBy(*keys).agg(*_plane(d, d1, d2), *_ar_fit("_d0", "_d1"))
    first = _solved(first, ("_b1", "_b2", "_b0"), "_phi", "_c")
    seen = attach(lagged, first, keys)
    short = F.col("_b0") + F.col("_b1") * d1
    seen = seen.withColumn("_e0", d - (short + F.col("_b2") * F.coalesce(d2, F.lit(0.0)))).withColumn(
        "_e1", d1 - (F.col("_b0") + F.col("_b1") * d2 + F.col("_b2") * F.coalesce(d3, F.lit(0.0))))
    second = seen.groupBy(*keys).agg(*_plane(d, d1, F.col("_e1")), F.max("_phi").alias("_phi"), F.max("_c").alias("_c"),
                                     F.max_by(y, ds).alias("_yT"), F.max_by("_d0", ds).alias("_dT"), F.max_by("_e0", ds).alias("_eT"))
    second = _solved(second, ("_p", "_q", "_k"), "_phi", "_c").drop("_phi", "_c")
    left = attach(seen.drop("_phi", "_c"), second.select(*keys, "_p", "_q", "_k"), keys)
    off = d - (F.col("_k") + F.col("_p") * d1 + F.col("_q") * F.coalesce(F.col("_e1"), F.lit(0.0)))
    sigma = left.groupBy(*keys).agg(F.stddev_samp(off).alias("_sigma"))
    fut = attach(attach(future(df, periods, freq, keys, ds), second, keys), sigma, keys)
    zero = F.lit(0.0)
    # h steps: difference, level, psi weight, sum of psi weights, sum of squares of those sums
    init = F.struct(F.col("_dT").alias("d"), F.col("_yT").cast("double").alias("y"), zero.alias("w"), zero.alias("s"), zero.alias("v"))

    def step(a, h):
        nd = F.col("_k") + F.col("_p") * a["d"] + F.when(h == 1, F.col("_q") * F.coalesce(F.col("_eT"), zero)).otherwise(zero)
        w = F.when(h == 1, F.lit(1.0)).when(h == 2, F.col("_p") + F.col("_q")).otherwise(F.col("_p") * a["w"])
        s = a["s"] + w
        return F.struct(nd.alias("d"), (a["y"] + nd).alias("y"), w.alias("w"), s.alias("s"), (a["v"] + s * s).alias("v"))
    end = F.aggregate(F.sequence(F.lit(1), F.col("h")), init, step)
    fc, band = end["y"], Z80 * F.col("_sigma") * F.sqrt(end["v"])
    fut = fut.select(*keys, ds, fc.alias("forecast"), (fc - band).alias("lower"), (fc + band).alias("upper"))
    return _history_and_forecast(df, fut, keys, ds, y)


def newest(df: DataFrame, n: int, keys=(), ds: str = "ds") -> DataFrame:
    """The last ``n`` rows of every series with ``_k``, 1 for the newest. Per
    key every task first trims its rows to n; a lone series is a top-n whose
    n rows are then numbered."""
    if not keys:
        df = df.orderBy(F.col(ds).desc()).limit(n)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return df.withColumn("_k", F.row_number().over(w.orderBy(F.col(ds).desc()))).filter(F.col("_k") <= n)


def seasonal_ar(df: DataFrame, periods: int, season: int = 12, freq: str = "D", keys=(), ds: str = "ds",
                y: str = "y") -> DataFrame:
    """Seasonal re-aim of the SARIMA call: difference at lag ``season``
    (D_t = y_t - y_(t-season)), fit AR(1) with intercept on D, and forecast
    y_(T+h) = y_(T+h-season) + D_h, carrying the last ``season`` values (a
    bounded buffer per series) through the recursion. Same output shape as
    ``ar_diff``."""
    d = ordered.lags(df, y, [1, season, season + 1], [ds], list(keys))
    d = d.withColumn("_d", F.col(y) - F.col(f"lag_{season}")).withColumn("_dl", F.col("lag_1") - F.col(f"lag_{season + 1}"))
    tail = (newest(df, season, keys, ds)
            .groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ds).alias("t"), F.col(y).alias("v")))),
                                            lambda e: e["v"]).alias("_buf")))
    fit = d.groupBy(*keys).agg(*_ar_fit("_d", "_dl"), F.max_by("_d", ds).alias("_dT"))
    fit = attach(fit, tail, keys)
    res = attach(d, fit, keys)
    sig = (res.withColumn("_e", F.col("_d") - (F.col("_c") + F.col("_phi") * F.col("_dl")))
           .groupBy(*keys).agg(F.stddev_samp("_e").alias("_sigma")))
    fut = attach(attach(future(df, periods, freq, keys, ds), fit, keys), sig, keys)
    init = F.struct(F.col("_dT").alias("d"), F.col("_buf").alias("buf"))

    def step(acc, _):
        dn = F.col("_c") + F.col("_phi") * acc["d"]
        yn = F.element_at(acc["buf"], 1) + dn
        return F.struct(dn.alias("d"), F.concat(F.slice(acc["buf"], 2, season - 1), F.array(yn)).alias("buf"))

    # no forecast without a full season and a fitted model: an error for one
    # series, null for the short ones among many
    enough = (F.size("_buf") >= season) & F.col("_phi").isNotNull() & F.col("_dT").isNotNull()
    short = F.lit(None).cast("double") if keys else \
        F.raise_error(F.lit(f"The series is too short for a season of {season}.")).cast("double")
    fc = F.when(enough, F.element_at(F.aggregate(F.sequence(F.lit(1), F.col("h")), init, step)["buf"], -1)).otherwise(short)
    band = Z80 * F.col("_sigma") * F.sqrt(F.col("h").cast("double"))
    fut = fut.select(*keys, ds, fc.alias("forecast"), (fc - band).alias("lower"), (fc + band).alias("upper"))
    return _history_and_forecast(df, fut, keys, ds, y)


def simple(df: DataFrame, periods: int, freq: str = "D", keys=(), ds: str = "ds", y: str = "y",
           method: str = "mean", season: int = 7) -> DataFrame:
    """``keys..., ds, forecast`` for the future steps: mean, last value or seasonal naive."""
    fut = future(df, periods, freq, keys, ds)
    if method in ("mean", "last"):
        stat = F.avg(y) if method == "mean" else F.max_by(y, ds)
        v = df.groupBy(*keys).agg(stat.alias("forecast"))
        return attach(fut, v, keys).select(*keys, ds, "forecast")
    if method == "seasonal_naive":
        lastm = newest(df, season, keys, ds)
        src = fut.withColumn("_k", F.lit(season) - ((F.col("h") - 1) % season))
        return attach(src, lastm.select(*keys, "_k", F.col(y).alias("forecast")), keys, ["_k"]).select(*keys, ds, "forecast")
    raise ValueError(f"Unknown simple method '{method}'")


def per_series(df: DataFrame, keys: list, fn, schema) -> DataFrame:
    """A user's own model per series: ``groupBy(keys).applyInPandas``; each
    series (one group) goes to one Python worker as a pandas frame."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def series_freqs(series: DataFrame, keys=(), ds: str = "ds") -> DataFrame:
    """``keys..., freq`` of every series: inferred, else ``D``. A lone series with
    fewer than 3 timestamps cannot be inferred (ValueError); among many such a
    series counts as daily and leaves the others alone."""
    found = infer_freq(series, keys, ds)
    if not keys:
        points = found.agg(F.max("points")).first()[0]
        if points is None or points < 3:
            raise ValueError("A frequency needs three timestamps or more.")
    return found.select(*keys, F.coalesce("freq", F.lit("D")).alias("freq"))


def generate_forecast(df: DataFrame, time_col: str, target_col: str, periods: int = 30, freq: str | None = None,
                      model_name: str = "prophet", keys=()) -> DataFrame:
    """Prepare the series (``keys`` for many at once), put it on its frequency grid
    (given, else inferred), fill gaps and forecast ``periods`` steps with the
    named model: ``prophet`` (trend + weekly), ``arima`` (ARMA on differences),
    ``sarima`` (AR on seasonal differences) or ``simple`` (mean)."""
    if model_name not in MODELS:
        raise ValueError(f"Unsupported model: {model_name}. Choose one of {list(MODELS)}.")
    series = prepare(df, time_col, target_col, keys)
    if freq is None:
        found = series_freqs(series, keys)
        kinds = sorted(r["freq"] for r in found.select("freq").distinct().collect())  # a dozen names at most
        out = None
        for kind in kinds:  # every series on its own grid
            part = attach(series, found.filter(F.col("freq") == kind), keys, how="inner").drop("freq") \
                if keys and len(kinds) > 1 else series
            done = _forecast(part, periods, kind, model_name, keys)
            out = done if out is None else out.unionByName(done)
        return out if out is not None else _forecast(series, periods, "D", model_name, keys)
    return _forecast(series, periods, freq, model_name, keys)


def _forecast(series: DataFrame, periods: int, freq: str, model_name: str, keys) -> DataFrame:
    grid = fill_gaps(asfreq(series, freq, keys), keys)
    if model_name == "prophet":
        return trend_weekly(grid, periods, freq, keys)
    if model_name == "arima":
        return arma_diff(grid, periods, freq, keys)
    if model_name == "sarima":
        return seasonal_ar(grid, periods, 12, freq, keys)
    return simple(grid, periods, freq, keys)
