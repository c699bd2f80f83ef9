"""Time series (TS1-TS11, AG18, WN3, JN6)."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from vellum.operators import timeseries as ts
from vellum.suite import query

USER_DAILY = "SELECT user_id, CAST(ts AS DATE) AS ds, sum(value) AS y FROM events GROUP BY user_id, CAST(ts AS DATE)"


@query("ts1_prepare", rounds={"y": 6}, sql="SELECT ts AS ds, avg(value) AS y FROM events GROUP BY ts")
def ts1(spark, sf):
    return ts.prepare(spark.table("events"), "ts", "value")


@query("ag18_average_duplicate_timestamps", rounds={"y": 6}, sql="""
SELECT user_id, date_trunc('hour', ts) AS ds, avg(value) AS y FROM events GROUP BY user_id, date_trunc('hour', ts)""")
def ag18(spark, sf):
    df = spark.table("events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return ts.prepare(df, "hour", "value", keys=["user_id"])


@query("ts5_ds_y_shape", views=["events_daily"], sql="SELECT ds, avg(y) AS y FROM events_daily GROUP BY ds")
def ts5(spark, sf):
    return ts.prepare(spark.table("events_daily"), "ds", "y")


FREQ_INPUT = """
SELECT 'daily' AS series, CAST(ds AS TIMESTAMP) AS ds FROM events_daily
UNION ALL SELECT 'monthly', CAST(m AS TIMESTAMP) FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders)
UNION ALL SELECT 'irregular', ts FROM events
UNION ALL SELECT 'hourly', h FROM (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events WHERE ts < TIMESTAMP '2024-01-02 00:00:00')
UNION ALL SELECT 'short', CAST(ds AS TIMESTAMP) FROM events_daily WHERE ds < DATE '2024-01-03'
UNION ALL SELECT 'quarterly', CAST(q AS TIMESTAMP) FROM (SELECT DISTINCT date_trunc('quarter', o_orderdate) AS q FROM orders)
UNION ALL SELECT 'yearly', CAST(y AS TIMESTAMP) FROM (SELECT DISTINCT date_trunc('year', o_orderdate) AS y FROM orders)"""


@query("ts2_infer_freq", views=["events_daily"], sql=f"""
WITH s AS ({FREQ_INPUT}),
d AS (SELECT series, ds, epoch(ds) - epoch(lag(ds) OVER w) AS step,
             (year(ds) * 12 + month(ds)) - lag(year(ds) * 12 + month(ds)) OVER w AS months
      FROM s WINDOW w AS (PARTITION BY series ORDER BY ds)),
g AS (SELECT series, count(*) AS n, min(step) AS lo, max(step) AS hi, min(months) AS mlo, max(months) AS mhi,
             bool_and(day(ds) = 1) AS starts, bool_and(CAST(ds AS DATE) = last_day(ds)) AS ends,
             bool_and(dayofweek(ds) = 0) AS sundays, bool_and(month(ds) % 3 = 1) AS qs, bool_and(month(ds) % 3 = 0) AS qe,
             bool_and(month(ds) = 1) AS jan, bool_and(month(ds) = 12) AS dec
      FROM d GROUP BY series)
SELECT series, n AS points, CASE WHEN n < 3 THEN NULL
  WHEN lo = hi AND lo = 604800 AND sundays THEN 'W-SUN' WHEN lo = hi AND lo = 86400 THEN 'D'
  WHEN lo = hi AND lo = 3600 THEN 'h' WHEN lo = hi AND lo = 60 THEN 'min' WHEN lo = hi AND lo = 1 THEN 's'
  WHEN mlo = 1 AND mhi = 1 AND starts THEN 'MS' WHEN mlo = 1 AND mhi = 1 AND ends THEN 'M'
  WHEN mlo = 3 AND mhi = 3 AND starts AND qs THEN 'QS' WHEN mlo = 3 AND mhi = 3 AND ends AND qe THEN 'Q'
  WHEN mlo = 12 AND mhi = 12 AND starts AND jan THEN 'YS' WHEN mlo = 12 AND mhi = 12 AND ends AND dec THEN 'Y' END AS freq
FROM g""")
def ts2(spark, sf):
    df = spark.sql(FREQ_INPUT.replace("CAST(m AS TIMESTAMP)", "CAST(m AS TIMESTAMP_NTZ)")
                   .replace("CAST(ds AS TIMESTAMP)", "CAST(ds AS TIMESTAMP_NTZ)")
                   .replace("date_trunc('hour', ts)", "CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ)")
                   .replace("date_trunc('month', o_orderdate)", "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ)")
                   .replace("date_trunc('quarter', o_orderdate)", "CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP_NTZ)")
                   .replace("date_trunc('year', o_orderdate)", "CAST(date_trunc('year', o_orderdate) AS TIMESTAMP_NTZ)")
                   .replace("CAST(q AS TIMESTAMP)", "q").replace("CAST(y AS TIMESTAMP)", "y"))
    return ts.infer_freq(df, ["series"])


@query("ts3_asfreq_daily", views=["events_daily_gaps"], sql="""
WITH g AS (SELECT CAST(d AS DATE) AS ds FROM (SELECT min(ds) AS lo, max(ds) AS hi FROM events_daily_gaps),
           generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY) AS t(d))
SELECT g.ds, e.y FROM g LEFT JOIN events_daily_gaps e ON g.ds = e.ds""")
def ts3(spark, sf):
    return ts.asfreq(spark.table("events_daily_gaps").select("ds", "y"), "D")


@query("ts3_asfreq_irregular", rounds={"y": 6}, sql="""
WITH p AS (SELECT ts AS ds, avg(value) AS y FROM events GROUP BY ts),
g AS (SELECT d AS ds FROM (SELECT min(ds) AS lo, max(ds) AS hi FROM p), generate_series(lo, hi, INTERVAL 1 DAY) AS t(d))
SELECT g.ds, p.y FROM g LEFT JOIN p ON g.ds = p.ds""")
def ts3i(spark, sf):
    return ts.asfreq(ts.prepare(spark.table("events"), "ts", "value"), "D")


@query("ts3_asfreq_weekly", views=["events_daily"], rounds={"y": 6}, sql="""
WITH g AS (SELECT CAST(d AS DATE) AS ds FROM (SELECT min(ds) AS lo, max(ds) AS hi FROM events_daily),
           generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY) AS t(d) WHERE dayofweek(d) = 0)
SELECT g.ds, e.y FROM g LEFT JOIN events_daily e ON g.ds = e.ds""")
def ts3w(spark, sf):
    return ts.asfreq(spark.table("events_daily").select("ds", "y"), "W")


@query("ts3_asfreq_per_user", rounds={"y": 6}, sql=f"""
WITH u AS ({USER_DAILY}),
g AS (SELECT user_id, CAST(d AS DATE) AS ds FROM (SELECT user_id, min(ds) AS lo, max(ds) AS hi FROM u GROUP BY user_id),
      LATERAL generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY) AS t(d))
SELECT g.user_id, g.ds, u.y FROM g LEFT JOIN u ON g.user_id = u.user_id AND g.ds = u.ds""")
def ts3u(spark, sf):
    return ts.asfreq(spark.sql(USER_DAILY), "D", keys=["user_id"])


FILL_SQL = """
WITH g AS (SELECT CAST(d AS DATE) AS ds FROM (SELECT min(ds) AS lo, max(ds) AS hi FROM events_daily_gaps),
           generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY) AS t(d)),
a AS (SELECT g.ds, e.y FROM g LEFT JOIN events_daily_gaps e ON g.ds = e.ds)
SELECT ds, coalesce(last_value(y IGNORE NULLS) OVER (ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    first_value(y IGNORE NULLS) OVER (ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y
FROM a"""


@query("ts4_fill_gaps", views=["events_daily_gaps"], sql=FILL_SQL)
def ts4(spark, sf):
    return ts.fill_gaps(ts.asfreq(spark.table("events_daily_gaps").select("ds", "y"), "D"))


@query("wn3_ffill_bfill_per_user", rounds={"y": 6}, sql=f"""
WITH u AS ({USER_DAILY}),
g AS (SELECT user_id, CAST(d AS DATE) AS ds FROM (SELECT user_id, min(ds) AS lo, max(ds) AS hi FROM u GROUP BY user_id),
      LATERAL generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY) AS t(d)),
a AS (SELECT g.user_id, g.ds, u.y FROM g LEFT JOIN u ON g.user_id = u.user_id AND g.ds = u.ds)
SELECT user_id, ds, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(y IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y
FROM a""")
def wn3(spark, sf):
    return ts.fill_gaps(ts.asfreq(spark.sql(USER_DAILY), "D", keys=["user_id"]), keys=["user_id"])


@query("ts6_future_frame", sql=f"""
WITH u AS ({USER_DAILY}), l AS (SELECT user_id, max(ds) AS last FROM u GROUP BY user_id)
SELECT user_id, CAST(h AS INTEGER) AS h, CAST(last + INTERVAL (h) DAY AS DATE) AS ds FROM l, range(1, 8) AS r(h)""")
def ts6(spark, sf):
    return ts.future(spark.sql(USER_DAILY), 7, "D", keys=["user_id"])


def _trend_sql(series_sql, keys, periods):
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    part = f"PARTITION BY {k}" if keys else ""
    using = f"USING ({k})" if keys else "ON true"
    return f"""
WITH s AS ({series_sql}),
f AS (SELECT {kc}min(ds) AS first, max(ds) AS last FROM s {'GROUP BY ' + k if keys else ''}),
h AS (SELECT s.*, (epoch(CAST(s.ds AS TIMESTAMP)) - epoch(CAST(first AS TIMESTAMP))) / 86400.0 AS t
      FROM s JOIN f {using}),
fit AS (SELECT {kc}regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM h {'GROUP BY ' + k if keys else ''}),
r AS (SELECT h.*, isodow(ds) - 1 AS wd, y - (a + b * t) AS res FROM h JOIN fit {using}),
sea AS (SELECT {kc}wd, avg(res) AS se FROM r GROUP BY {kc}wd),
sig AS (SELECT {kc}stddev_samp(res - se) AS sigma FROM r JOIN sea USING ({kc}wd) {'GROUP BY ' + k if keys else ''}),
fut AS (SELECT {kc}CAST(last + INTERVAL (i) DAY AS DATE) AS ds, CAST(NULL AS DOUBLE) AS y,
               (epoch(CAST(last + INTERVAL (i) DAY AS TIMESTAMP)) - epoch(CAST(first AS TIMESTAMP))) / 86400.0 AS t
        FROM f, range(1, {periods + 1}) AS q(i)),
allrows AS (SELECT {kc}ds, y, t FROM h UNION ALL SELECT {kc}ds, y, t FROM fut),
x AS (SELECT allrows.*, a + b * t AS trend, a + b * t + coalesce(se, 0.0) AS yhat, 1.2816 * coalesce(sigma, 0.0) AS band
      FROM allrows JOIN fit {using} JOIN sig {using} LEFT JOIN sea ON {(on.replace('a.', 'allrows.').replace('b.', 'sea.') + ' AND ') if keys else ''}sea.wd = isodow(allrows.ds) - 1)
SELECT {kc}ds, y, trend, yhat, yhat - band AS yhat_lower, yhat + band AS yhat_upper FROM x"""


TREND_ROUNDS = {"y": 6, "trend": "f", "yhat": "f", "yhat_lower": "f", "yhat_upper": "f"}


@query("ts7_trend_weekly", views=["events_daily"], rounds=TREND_ROUNDS,
       sql=_trend_sql("SELECT ds, y FROM events_daily", [], 14))
def ts7(spark, sf):
    return ts.trend_weekly(spark.table("events_daily").select("ds", "y"), 14, "D")


@query("ts7_trend_weekly_per_user", rounds=TREND_ROUNDS, sql=_trend_sql(USER_DAILY, ["user_id"], 7))
def ts7u(spark, sf):
    return ts.trend_weekly(spark.sql(USER_DAILY), 7, "D", keys=["user_id"])


AR_SQL = """
WITH RECURSIVE s AS (SELECT ds, y FROM events_daily),
d AS (SELECT ds, y, y - lag(y) OVER (ORDER BY ds) AS d FROM s),
dl AS (SELECT ds, y, d, lag(d) OVER (ORDER BY ds) AS dl FROM d),
fit AS (SELECT regr_slope(d, dl) AS phi, regr_intercept(d, dl) AS c, arg_max(y, ds) AS yT, arg_max(d, ds) AS dT,
               max(ds) AS last FROM dl),
sig AS (SELECT stddev_samp(d - (c + phi * dl)) AS sigma FROM dl, fit),
rec(h, dd, yy) AS (SELECT 0, dT, yT FROM fit
                   UNION ALL SELECT h + 1, c + phi * dd, yy + (c + phi * dd) FROM rec, fit WHERE h < 10),
fut AS (SELECT CAST(last + INTERVAL (h) DAY AS DATE) AS ds, yy AS forecast, yy - 1.2816 * sigma * sqrt(h) AS lower,
               yy + 1.2816 * sigma * sqrt(h) AS upper FROM rec, fit, sig WHERE h >= 1)
SELECT coalesce(s.ds, fut.ds) AS ds, s.y AS history, forecast, lower, upper
FROM s FULL OUTER JOIN fut ON s.ds = fut.ds"""


@query("ts8_ar_forecast", views=["events_daily"], rounds={"history": 6, "forecast": "f", "lower": "f", "upper": "f"},
       sql=AR_SQL)
def ts8(spark, sf):
    out = ts.ar_diff(spark.table("events_daily").select("ds", "y"), 10, "D")
    return out.select("ds", "history", "forecast", "lower", "upper")


@query("jn6_history_forecast_join", views=["events_daily"], sql=f"""
SELECT ds, history IS NOT NULL AS has_history, forecast IS NOT NULL AS has_forecast FROM ({AR_SQL.replace('WITH RECURSIVE', 'WITH RECURSIVE', 1)})""")
def jn6(spark, sf):
    out = ts.ar_diff(spark.table("events_daily").select("ds", "y"), 10, "D")
    return out.select("ds", F.col("history").isNotNull().alias("has_history"),
                      F.col("forecast").isNotNull().alias("has_forecast"))


@query("ts9_simple_mean", rounds={"forecast": 6}, sql=f"""
WITH u AS ({USER_DAILY}), l AS (SELECT user_id, max(ds) AS last, avg(y) AS m FROM u GROUP BY user_id)
SELECT user_id, CAST(last + INTERVAL (h) DAY AS DATE) AS ds, m AS forecast FROM l, range(1, 6) AS r(h)""")
def ts9m(spark, sf):
    return ts.simple(spark.sql(USER_DAILY), 5, "D", keys=["user_id"], method="mean")


@query("ts9_simple_last", rounds={"forecast": 6}, sql=f"""
WITH u AS ({USER_DAILY}), l AS (SELECT user_id, max(ds) AS last, arg_max(y, ds) AS v FROM u GROUP BY user_id)
SELECT user_id, CAST(last + INTERVAL (h) DAY AS DATE) AS ds, v AS forecast FROM l, range(1, 6) AS r(h)""")
def ts9l(spark, sf):
    return ts.simple(spark.sql(USER_DAILY), 5, "D", keys=["user_id"], method="last")


@query("ts9_seasonal_naive", views=["events_daily"], rounds={"forecast": 6}, sql="""
WITH s AS (SELECT ds, y, row_number() OVER (ORDER BY ds DESC) AS k FROM events_daily),
l AS (SELECT max(ds) AS last FROM events_daily),
f AS (SELECT h, CAST(last + INTERVAL (h) DAY AS DATE) AS ds, 7 - ((h - 1) % 7) AS k FROM l, range(1, 16) AS r(h))
SELECT f.ds, s.y AS forecast FROM f LEFT JOIN s ON f.k = s.k""")
def ts9s(spark, sf):
    return ts.simple(spark.table("events_daily").select("ds", "y"), 15, "D", method="seasonal_naive", season=7)


def _linear_fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Example user model: least-squares line per series, 7 steps ahead."""
    pdf = pdf.sort_values("ds")
    t = (pd.to_datetime(pdf["ds"]) - pd.to_datetime(pdf["ds"]).min()).dt.days.to_numpy(dtype=float)
    y = pdf["y"].to_numpy(dtype=float)
    b, a = np.polyfit(t, y, 1) if len(t) > 1 else (0.0, float(y[0]))
    last = pd.to_datetime(pdf["ds"]).max()
    h = np.arange(1, 8)
    return pd.DataFrame({"user_id": pdf["user_id"].iloc[0], "ds": (last + pd.to_timedelta(h, "D")).date,
                         "forecast": a + b * (t.max() + h)})


TS10_SQL = f"""
WITH u AS ({USER_DAILY}),
t AS (SELECT u.*, datediff('day', min(ds) OVER (PARTITION BY user_id), ds) AS t FROM u),
fit AS (SELECT user_id, coalesce(regr_slope(y, t), 0.0) AS b, coalesce(regr_intercept(y, t), any_value(y)) AS a,
               max(t) AS tmax, max(ds) AS last FROM t GROUP BY user_id)
SELECT user_id, CAST(last + INTERVAL (h) DAY AS DATE) AS ds, a + b * (tmax + h) AS forecast
FROM fit, range(1, 8) AS r(h)"""


@query("ts10_per_series_model", sql=TS10_SQL, rounds={"forecast": "f"})
def ts10(spark, sf):
    return ts.per_series(spark.sql(USER_DAILY), ["user_id"], _linear_fit, "user_id long, ds date, forecast double")


@query("ts7_generate_forecast", rounds=TREND_ROUNDS, sql=_trend_sql(
    "SELECT ds, coalesce(last_value(y IGNORE NULLS) OVER (ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    "first_value(y IGNORE NULLS) OVER (ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM ("
    + FILL_SQL.replace("SELECT ds, coalesce(", "SELECT ds, y AS yy, coalesce(", 1) + ")", [], 7).replace(
    "events_daily_gaps", "events_daily_gaps"), views=["events_daily_gaps"])
def ts7g(spark, sf):
    return ts.generate_forecast(spark.table("events_daily_gaps"), "ds", "y", periods=7, model_name="prophet")


SEASONAL_SQL = """
WITH RECURSIVE s AS (SELECT ds, y FROM events_daily),
d AS (SELECT ds, y, y - lag(y, 7) OVER (ORDER BY ds) AS d FROM s),
dl AS (SELECT ds, y, d, lag(d) OVER (ORDER BY ds) AS dl FROM d),
tail AS (SELECT list(y ORDER BY ds) AS buf FROM (SELECT ds, y FROM s ORDER BY ds DESC LIMIT 7)),
fit AS (SELECT regr_slope(d, dl) AS phi, regr_intercept(d, dl) AS c, arg_max(d, ds) AS dT, max(ds) AS last FROM dl),
sig AS (SELECT stddev_samp(d - (c + phi * dl)) AS sigma FROM dl, fit),
rec(h, dd, buf) AS (SELECT 0, dT, (SELECT buf FROM tail) FROM fit
                    UNION ALL SELECT h + 1, c + phi * dd, list_append(buf[2:], buf[1] + (c + phi * dd)) FROM rec, fit WHERE h < 10),
fut AS (SELECT CAST(last + INTERVAL (h) DAY AS DATE) AS ds, buf[7] AS forecast,
               buf[7] - 1.2816 * sigma * sqrt(h) AS lower, buf[7] + 1.2816 * sigma * sqrt(h) AS upper
        FROM rec, fit, sig WHERE h >= 1)
SELECT coalesce(s.ds, fut.ds) AS ds, s.y AS history, forecast, lower, upper
FROM s FULL OUTER JOIN fut ON s.ds = fut.ds"""


@query("ts8_seasonal_ar_forecast", views=["events_daily"],
       rounds={"history": 6, "forecast": "f", "lower": "f", "upper": "f"}, sql=SEASONAL_SQL)
def ts8s(spark, sf):
    out = ts.seasonal_ar(spark.table("events_daily").select("ds", "y"), 10, season=7)
    return out.select("ds", "history", "forecast", "lower", "upper")


SEASONAL_USER_SQL = f"""
WITH RECURSIVE u AS ({USER_DAILY}),
g AS (SELECT user_id, CAST(d AS DATE) AS ds FROM (SELECT user_id, min(ds) AS lo, max(ds) AS hi FROM u GROUP BY user_id),
      LATERAL generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY) AS t(d)),
a AS (SELECT g.user_id, g.ds, u.y FROM g LEFT JOIN u ON g.user_id = u.user_id AND g.ds = u.ds),
s AS (SELECT user_id, ds, coalesce(
        last_value(y IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(y IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y
      FROM a),
d AS (SELECT user_id, ds, y, y - lag(y, 7) OVER (PARTITION BY user_id ORDER BY ds) AS d FROM s),
dl AS (SELECT user_id, ds, y, d, lag(d) OVER (PARTITION BY user_id ORDER BY ds) AS dl FROM d),
tail AS (SELECT user_id, list(y ORDER BY ds) AS buf FROM (
           SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ds DESC) AS k FROM s) WHERE k <= 7 GROUP BY user_id),
fit AS (SELECT user_id, regr_slope(d, dl) AS phi, regr_intercept(d, dl) AS c, arg_max(d, ds) AS dT, max(ds) AS last
        FROM dl GROUP BY user_id),
sig AS (SELECT dl.user_id, stddev_samp(d - (c + phi * dl)) AS sigma FROM dl JOIN fit ON dl.user_id = fit.user_id
        GROUP BY dl.user_id),
rec(user_id, h, dd, buf) AS (
  SELECT fit.user_id, 0, dT, buf FROM fit JOIN tail ON fit.user_id = tail.user_id
  UNION ALL SELECT rec.user_id, h + 1, c + phi * dd, list_append(buf[2:], buf[1] + (c + phi * dd))
  FROM rec JOIN fit ON rec.user_id = fit.user_id WHERE h < 7),
fut AS (SELECT rec.user_id, CAST(last + INTERVAL (h) DAY AS DATE) AS ds, buf[len(buf)] AS forecast,
               buf[len(buf)] - 1.2816 * sigma * sqrt(h) AS lower, buf[len(buf)] + 1.2816 * sigma * sqrt(h) AS upper
        FROM rec JOIN fit ON rec.user_id = fit.user_id JOIN sig ON rec.user_id = sig.user_id WHERE h >= 1)
SELECT coalesce(s.user_id, fut.user_id) AS user_id, coalesce(s.ds, fut.ds) AS ds, s.y AS history, forecast, lower, upper
FROM s FULL OUTER JOIN fut ON s.user_id = fut.user_id AND s.ds = fut.ds"""


@query("ts8_seasonal_ar_per_user", sql=SEASONAL_USER_SQL,
       rounds={"history": 6, "forecast": "f", "lower": "f", "upper": "f"})
def ts8u(spark, sf):
    series = ts.fill_gaps(ts.asfreq(spark.sql(USER_DAILY), "D", keys=["user_id"]), keys=["user_id"])
    return ts.seasonal_ar(series, 7, season=7, keys=["user_id"])


# Series by event type with one type as the null key; -1 stands for null in DuckDB's joins.
NULL_KEY = """SELECT CASE WHEN user_id % 3 > 0 THEN user_id % 3 END AS k, CAST(ts AS DATE) AS ds, avg(value) AS y
FROM events GROUP BY ALL"""


@query("ts7_trend_weekly_null_key", rounds=TREND_ROUNDS, sql="SELECT nullif(k, -1) AS k, * EXCLUDE (k) FROM (" + _trend_sql(
    f"SELECT coalesce(k, -1) AS k, ds, y FROM ({NULL_KEY})", ["k"], 7) + ")")
def ts7n(spark, sf):
    return ts.generate_forecast(spark.sql(NULL_KEY), "ds", "y", 7, "D", "prophet", ["k"])


@query("ts3_resample_null_key", rounds={"y": 6}, sql=f"""
WITH s AS ({NULL_KEY}), f AS (SELECT k, min(ds) AS lo, max(ds) AS hi FROM s GROUP BY k),
g AS (SELECT k, CAST(d AS DATE) AS ds FROM f, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS t(d))
SELECT g.k, g.ds, s.y FROM g LEFT JOIN s ON g.k IS NOT DISTINCT FROM s.k AND g.ds = s.ds""")
def ts3n(spark, sf):
    out = ts.resample(spark.sql(NULL_KEY), "D", "mean", ["k"])
    return out.select("k", F.col("ds").cast("date").alias("ds"), "y")


# Straight lines: their differences are constant, so every forecast goes on along the line.
LINES = """SELECT CASE WHEN u > 0 THEN u END AS k, ds, 3.0 * u + (1.0 + u) * datediff({days}) AS y
FROM (SELECT DISTINCT user_id % 2 AS u, CAST(ts AS DATE) AS ds FROM events) AS d"""


@query("ts8_ar_straight_lines", rounds={"history": 6, "forecast": 6, "lower": 6, "upper": 6}, sql=f"""
WITH s AS ({LINES.format(days="'day', DATE '2024-01-01', d.ds")}),
f AS (SELECT k, max(ds) AS last, arg_max(y, ds) AS y, (max(y) - min(y)) / (max(ds) - min(ds)) AS step FROM s GROUP BY k)
SELECT k, ds, y AS history, NULL::DOUBLE AS forecast, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper FROM s
UNION ALL
SELECT k, CAST(last + INTERVAL (h) DAY AS DATE), NULL, y + h * step, y + h * step, y + h * step FROM f, range(1, 6) AS r(h)""")
def ts8l(spark, sf):
    lines = spark.sql(LINES.format(days="d.ds, DATE '2024-01-01'"))
    return ts.generate_forecast(lines, "ds", "y", 5, "D", "arima", ["k"])


ARMA_SQL = """
WITH RECURSIVE s AS (SELECT ds, y FROM events_daily),
d AS (SELECT ds, y, y - lag(y) OVER w AS d, lag(y) OVER w - lag(y, 2) OVER w AS d1, lag(y, 2) OVER w - lag(y, 3) OVER w AS d2,
             lag(y, 3) OVER w - lag(y, 4) OVER w AS d3 FROM s WINDOW w AS (ORDER BY ds)),
m AS (SELECT avg(d) AS md, avg(d1) AS mu, avg(d2) AS mv, var_pop(d1) AS uu, var_pop(d2) AS vv, covar_pop(d1, d2) AS uv,
             covar_pop(d1, d) AS ud, covar_pop(d2, d) AS vd FROM d WHERE d2 IS NOT NULL),
a AS (SELECT (ud * vv - vd * uv) / (uu * vv - uv * uv) AS b1, (vd * uu - ud * uv) / (uu * vv - uv * uv) AS b2, * FROM m),
f AS (SELECT b1, b2, md - b1 * mu - b2 * mv AS b0 FROM a),
e AS (SELECT d.*, d - (b0 + b1 * d1 + b2 * coalesce(d2, 0)) AS e0, d1 - (b0 + b1 * d2 + b2 * coalesce(d3, 0)) AS e1 FROM d, f),
n AS (SELECT avg(d) AS md, avg(d1) AS mu, avg(e1) AS mv, var_pop(d1) AS uu, var_pop(e1) AS vv, covar_pop(d1, e1) AS uv,
             covar_pop(d1, d) AS ud, covar_pop(e1, d) AS vd FROM e WHERE e1 IS NOT NULL),
b AS (SELECT (ud * vv - vd * uv) / (uu * vv - uv * uv) AS p, (vd * uu - ud * uv) / (uu * vv - uv * uv) AS q, * FROM n),
g AS (SELECT p, q, md - p * mu - q * mv AS k FROM b),
t AS (SELECT stddev_samp(d - (k + p * d1 + q * coalesce(e1, 0))) AS sigma, arg_max(y, ds) AS yT, arg_max(d, ds) AS dT,
             arg_max(e0, ds) AS eT, max(ds) AS last FROM e, g),
r(h, dd, yy, w, s, v) AS (
  SELECT 0, dT, yT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM t
  UNION ALL
  SELECT h + 1, nd, yy + nd, nw, s + nw, v + (s + nw) * (s + nw)
  FROM (SELECT r.*, k + p * dd + CASE WHEN h = 0 THEN q * eT ELSE 0 END AS nd,
               CASE h WHEN 0 THEN 1.0 WHEN 1 THEN p + q ELSE p * w END AS nw FROM r, g, t) WHERE h < 10)
SELECT ds, y AS history, NULL::DOUBLE AS forecast, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper FROM s
UNION ALL
SELECT CAST(last + INTERVAL (h) DAY AS DATE), NULL, yy, yy - 1.2816 * sigma * sqrt(v), yy + 1.2816 * sigma * sqrt(v)
FROM r, t WHERE h >= 1"""


@query("ts8_arma_forecast", views=["events_daily"], rounds={"history": 6, "forecast": "f", "lower": "f", "upper": "f"}, sql=ARMA_SQL)
def ts8arma(spark, sf):
    return ts.generate_forecast(spark.table("events_daily"), "ds", "y", 10, "D", "arima").select(
        "ds", "history", "forecast", "lower", "upper")
