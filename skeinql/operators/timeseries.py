"""Time series over (series, ts, value) rows: buckets, gap filling, averages, trends, forecasts and anomalies.

All are windows or aggregates by series; a series is never collected on the driver. EMA carries its last
value along sorted rows; Holt-Winters and autoregression run as one grouped pandas function for each series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinql.operators.joins import small_side
from skeinql.operators.windows import in_pieces
from skeinql.session import scratch


def _w(by: Sequence[str], ts: str):
    return Window.partitionBy(*by).orderBy(ts)


def downsample(df: DataFrame, by: Sequence[str], ts: str, value: str, every: str, how: str = "mean", start: str | None = None) -> DataFrame:
    """(by, bucket, value): one row a bucket. how: mean sum min max first last count stddev median."""
    agg = {
        "mean": F.avg(value), "sum": F.sum(value), "min": F.min(value), "max": F.max(value), "count": F.count(value), "stddev": F.stddev_samp(value), "median": F.median(value),
        "first": F.min_by(value, ts), "last": F.max_by(value, ts),
    }[how]
    window = F.window(ts, every, startTime=start) if start else F.window(ts, every)
    return df.groupBy(*by, window.alias("_w")).agg(agg.alias(value)).select(*by, F.col("_w.start").alias("bucket"), value)


def fill_gaps(df: DataFrame, by: Sequence[str], ts: str, value: str, every: str, method: str = "linear", constant: float = 0.0) -> DataFrame:
    """A row for each step of a grid from a series' first time to its last; missing values by method.

    previous, next, linear, spline, average, constant, null; null at the ends. spline is a cubic through the known
    points whose slope at each is that of the line through its neighbours (at the ends, of the line to the only one).
    """
    if method == "spline":
        df = _with_slopes(df, by, ts, value)
    span = df.groupBy(*by).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    grid = span.select(*by, F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {every}"))).alias(ts))
    out = grid.join(df.select(*by, ts, value, *(["_slope"] if method == "spline" else [])), [*by, ts], "left")
    back = Window.partitionBy(*by).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(ts).rowsBetween(0, Window.unboundedFollowing)
    prev, nxt = F.last(value, ignorenulls=True).over(back), F.first(value, ignorenulls=True).over(ahead)
    if method == "spline":
        t = F.unix_micros(F.col(ts).cast("timestamp")).cast("double")
        knot = F.when(F.col(value).isNotNull(), F.struct(t.alias("t"), F.col(value).cast("double").alias("v"), F.col("_slope").alias("m")))
        a, b = F.last(knot, ignorenulls=True).over(back), F.first(knot, ignorenulls=True).over(ahead)
        h = b["t"] - a["t"]
        s = (t - a["t"]) / F.nullif(h, F.lit(0.0))
        cubic = (2 * s * s * s - 3 * s * s + 1) * a["v"] + (s * s * s - 2 * s * s + s) * h * a["m"] + (3 * s * s - 2 * s * s * s) * b["v"] + (s * s * s - s * s) * h * b["m"]
        return out.withColumn(value, F.when(h == 0, a["v"]).otherwise(cubic)).drop("_slope")
    if method == "linear":
        t = F.unix_micros(F.col(ts).cast("timestamp"))
        known = F.when(F.col(value).isNotNull(), t)
        t0, t1 = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
        filled = F.when(t0 == t1, prev).otherwise(prev + (nxt - prev) * (t - t0) / F.nullif(t1 - t0, F.lit(0)))
    else:
        filled = {"previous": prev, "next": nxt, "average": F.coalesce(F.col(value), (prev + nxt) / 2), "constant": F.coalesce(F.col(value), F.lit(constant)), "null": F.col(value)}[method]
    return out.withColumn(value, filled)


def _with_slopes(df: DataFrame, by: Sequence[str], ts: str, value: str) -> DataFrame:
    """The known points with _slope, the change of value in a microsecond at each."""
    known = df.where(F.col(value).isNotNull())
    t, v, w = F.unix_micros(F.col(ts).cast("timestamp")).cast("double"), F.col(value).cast("double"), _w(by, ts)
    t0, t1, v0, v1 = (F.coalesce(f(x).over(w), x) for f, x in ((F.lag, t), (F.lead, t), (F.lag, v), (F.lead, v)))
    return known.withColumn("_slope", F.coalesce((v1 - v0) / F.nullif(t1 - t0, F.lit(0.0)), F.lit(0.0)))


def moving_average(value: str, by: Sequence[str], ts: str, size: int) -> Column:
    """Simple average of the last size values (fewer at the start)."""
    return F.avg(value).over(_w(by, ts).rowsBetween(-(size - 1), 0))


def weighted_average(value: str, by: Sequence[str], ts: str, size: int) -> Column:
    """Linear weights, the newest value the greatest."""
    last = F.collect_list(value).over(_w(by, ts).rowsBetween(-(size - 1), 0))
    weighted = F.aggregate(F.transform(last, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return weighted / (F.size(last) * (F.size(last) + 1) / 2)


def cumulative_average(value: str, by: Sequence[str], ts: str) -> Column:
    return F.avg(value).over(_w(by, ts).rowsBetween(Window.unboundedPreceding, 0))


def exponential_average(df: DataFrame, by: Sequence[str], ts: str, value: str, alpha: float) -> DataFrame:
    """(by, ts, value, ema): each series' values in order of time, a batch of rows at a time; only the last average is carried on."""
    rows = df.select(*by, ts, F.col(value).cast("double").alias(value)).repartition(*by).sortWithinPartitions(*by, ts, value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, carried = None, None
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            pdf["ema"] = 0.0
            keys = pdf[list(by)]
            new = (keys != keys.shift()).any(axis=1) & ~(keys.isna() & keys.shift().isna()).all(axis=1)
            starts = [0, *[i for i in new[new].index if i]]
            for lo, hi in zip(starts, [*starts[1:], len(pdf)]):
                series = tuple(None if pd.isna(x) else x for x in keys.iloc[lo]) if hi > lo else held
                x = pdf[value].iloc[lo:hi]
                if series == held and carried is not None:
                    x = pd.concat([pd.Series([carried]), x])
                ema = x.ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()[-(hi - lo) :]
                pdf.loc[lo : hi - 1, "ema"] = ema
                if hi > lo:
                    held, carried = series, float(ema[-1])
            yield pdf

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, ema double")


def autocorrelation(df: DataFrame, by: Sequence[str], ts: str, value: str, lags: Sequence[int]) -> DataFrame:
    """(by, lag, r): biased autocorrelation, all of a series in the denominator."""
    whole = Window.partitionBy(*by)
    x = df.withColumn("_d", F.col(value) - F.avg(value).over(whole))
    both = x.withColumn("_l", F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("_d") * F.lag("_d", k).over(_w(by, ts))).alias("p")) for k in lags]))
    both = both.withColumn("_q", F.sum(F.col("_d") * F.col("_d")).over(whole)).select(*by, "_q", F.inline("_l"))
    return both.groupBy(*by, "lag").agg((F.sum("p") / F.nullif(F.max("_q"), F.lit(0.0))).alias("r"))


def seasonality(df: DataFrame, by: Sequence[str], ts: str, value: str, longest: int, least: float = 0.5) -> DataFrame:
    """(by, period, strength): the lag of highest autocorrelation from 2 on, if above the least."""
    r = autocorrelation(df, by, ts, value, range(2, longest + 1)).where(F.col("r") > least)
    return r.groupBy(*by).agg(F.max_by("lag", F.struct("r", -F.col("lag"))).alias("period"), F.max("r").alias("strength"))


def decompose(df: DataFrame, by: Sequence[str], ts: str, value: str, period: int) -> DataFrame:
    """value = trend (centred average over a period) + seasonal (mean of what is left, by place in the period) + residual."""
    half = max(period // 2, 1)
    n = F.row_number().over(_w(by, ts)) - 1
    out = df.withColumns({"_k": n % period, "trend": F.avg(value).over(_w(by, ts).rowsBetween(-half, half))})
    out = out.withColumn("seasonal", F.avg(F.col(value) - F.col("trend")).over(Window.partitionBy(*by, "_k")))
    return out.withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal")).drop("_k")


def change_points(value: str, by: Sequence[str], ts: str, threshold: float) -> Column:
    return F.coalesce(F.abs(F.col(value) - F.lag(value).over(_w(by, ts))) > threshold, F.lit(False))


def rate_of_change(value: str, by: Sequence[str], ts: str, period: int = 1) -> Column:
    before = F.lag(value, period).over(_w(by, ts))
    return (F.col(value) - before) / F.nullif(before, F.lit(0.0))


def trend(df: DataFrame, by: Sequence[str], ts: str, value: str) -> DataFrame:
    """(by, ups, downs, trend, strength): up or down if twice as many steps go that way, else flat; strength is r2 over the order."""
    x = df.withColumns({"_p": F.lag(value).over(_w(by, ts)), "_n": F.row_number().over(_w(by, ts)).cast("double")})
    out = x.groupBy(*by).agg(F.count_if(F.col(value) > F.col("_p")).alias("ups"), F.count_if(F.col(value) < F.col("_p")).alias("downs"), F.regr_r2(value, "_n").alias("strength"))
    return out.withColumn("trend", F.when(F.col("ups") > 2 * F.col("downs"), "up").when(F.col("downs") > 2 * F.col("ups"), "down").otherwise("flat"))


def linear_forecast(df: DataFrame, by: Sequence[str], ts: str, value: str, periods: int) -> DataFrame:
    """(by, step, forecast): least squares over the order, carried on."""
    x = df.withColumn("_n", (F.row_number().over(_w(by, ts)) - 1).cast("double"))
    fit = x.groupBy(*by).agg(F.regr_slope(value, "_n").alias("_m"), F.regr_intercept(value, "_n").alias("_c"), F.count(value).alias("_k"))
    return fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods)))).select(*by, "step", (F.col("_c") + F.col("_m") * (F.col("_k") + F.col("step") - 1)).alias("forecast"))


def outliers_z(df: DataFrame, by: Sequence[str], value: str, k: float = 3.0) -> DataFrame:
    """df with outlier: more than k standard deviations from the mean, which are aggregated before they meet the rows."""
    x = _beside(df, by, df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")))
    return x.withColumn("outlier", F.coalesce(F.abs(F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)) > k, F.lit(False))).drop("_m", "_s")


def _at_rank(df: DataFrame, by: Sequence[str], value: str, places: dict[str, float]) -> DataFrame:
    """For each group the values at 0-based places floor(share * n) of the order, exactly.

    Approximate percentiles bracket each place, values below a bracket are counted, and only the few inside
    are put in order (counted by value first), so no group is sorted or gathered in one task.
    """
    slack = 2e-3
    near = {n: (max(0.0, p - slack), min(1.0, p + slack)) for n, p in places.items()}
    spark, path = df.sparkSession, scratch(df.sparkSession, "brackets")
    x = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    ends = [F.percentile_approx("_v", e, round(4 / slack)).alias(f"_{n}_{k}") for n, pair in near.items() for k, e in enumerate(pair)]
    x.groupBy(*by).agg(F.count("*").alias("_n"), *ends).write.parquet(path)  # a row for each group
    brackets = small_side(spark.read.parquet(path))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    keys = [F.col(f"l.{c}").alias(c) for c in by]
    # of each place the values inside its bracket, and null for those below
    inside = F.array(*[F.when(F.col("_v") <= F.col(f"_{n}_1"), F.struct(F.lit(n).alias("_place"), F.floor(F.col("_n") * F.lit(p)).alias("_at"), F.when(F.col("_v") >= F.col(f"_{n}_0"), F.col("_v")).alias("_x"))) for (n, p) in places.items()])
    rows = x.alias("l").join(brackets.alias("r"), same).select(*keys, F.explode(F.filter(inside, lambda i: i.isNotNull())).alias("_i")).select(*by, "_i.*")
    counted = rows.groupBy(*by, "_place", "_at", "_x").agg(F.count("*").alias("_c"))
    up_to = Window.partitionBy(*by, "_place").orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = counted.withColumn("_end", F.sum("_c").over(up_to)).where((F.col("_end") > F.col("_at")) & (F.col("_end") - F.col("_c") <= F.col("_at")))
    out = scratch(spark, "ranks")
    found.groupBy(*by).agg(*[F.max(F.when(F.col("_place") == n, F.col("_x"))).alias(n) for n in places]).write.parquet(out)
    return spark.read.parquet(out)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], lower: Sequence[str] = ()) -> DataFrame:
    """(by, names of shares): a row for each group. A quantile lies between the values at places floor and ceil of share * (n - 1);
    those named in lower are the first value whose share of the rows up to it is reached. Null where a group has no value.

    Values are counted first and then added up in pieces of their order, so no group is sorted or gathered in one task.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "counted")
    df.select(*by, F.col(value).alias("_x")).groupBy(*by, "_x").agg(F.count("_x").alias("_c")).write.parquet(path)
    x, _ = in_pieces(spark.read.parquet(path), [*by, "_x"])
    sums = x.groupBy(*by, "_piece").agg(F.sum("_c").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*by, "_piece", F.coalesce(before, F.lit(0)).alias("_base"), F.sum("_s").over(Window.partitionBy(*by)).alias("_n"))
    up_to = Window.partitionBy(*by, "_piece").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = _beside(x, [*by, "_piece"], sums).withColumn("_end", F.col("_base") + F.sum("_c").over(up_to))
    at = lambda place: F.max(F.when((F.col("_end") > place) & (F.col("_end") - F.col("_c") <= place), F.col("_x")))
    found = []
    for name, p in shares.items():
        place = (F.col("_n") - 1) * F.lit(p)
        found += [at(F.greatest(F.ceil(F.col("_n") * F.lit(p)) - 1, F.lit(0))).alias(f"{name}_lo")] if name in lower else [at(F.floor(place)).alias(f"{name}_lo"), at(F.ceil(place)).alias(f"{name}_hi"), F.max(place - F.floor(place)).alias(f"{name}_part")]
    # equal ends give themselves, infinite ones too
    between = lambda c: F.when(F.col(f"{c}_lo") == F.col(f"{c}_hi"), F.col(f"{c}_lo")).otherwise((1 - F.col(f"{c}_part")) * F.col(f"{c}_lo") + F.col(f"{c}_part") * F.col(f"{c}_hi"))
    return x.groupBy(*by).agg(*found).select(*by, *[(F.col(f"{c}_lo") if c in lower else between(c)).alias(c) for c in shares])


def _beside(df: DataFrame, by: Sequence[str], one: DataFrame) -> DataFrame:
    """df with the columns of one row for each group."""
    new = [c for c in one.columns if c not in by]
    return df.alias("l").join(small_side(one).alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by], "left").select("l.*", *[f"r.{c}" for c in new])


def outliers_iqr(df: DataFrame, by: Sequence[str], value: str, factor: float = 1.5) -> DataFrame:
    """df with outlier: outside of 1.5 times the range between the values at places n/4 and 3n/4."""
    x = _beside(df, by, _at_rank(df, by, value, {"_q1": 0.25, "_q3": 0.75}))
    far = F.lit(factor) * (F.col("_q3") - F.col("_q1"))
    return x.withColumn("outlier", F.coalesce((F.col(value) < F.col("_q1") - far) | (F.col(value) > F.col("_q3") + far), F.lit(False))).drop("_q1", "_q3")


def outliers_mad(df: DataFrame, by: Sequence[str], value: str, k: float = 3.5) -> DataFrame:
    """df with outlier: 0.6745 * distance from the median / median distance is above k; medians are at place n/2."""
    x = _beside(df, by, _at_rank(df, by, value, {"_m": 0.5})).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    x = _beside(x, by, _at_rank(x, by, "_d", {"_mad": 0.5}))
    return x.withColumn("outlier", F.coalesce(F.lit(0.6745) * F.col("_d") / F.nullif(F.col("_mad"), F.lit(0.0)) > k, F.lit(False))).drop("_m", "_d", "_mad")


def outliers_ewma(df: DataFrame, by: Sequence[str], ts: str, value: str, alpha: float, threshold: float) -> DataFrame:
    """Rows of exponential_average with outlier: farther than the threshold from the average before it."""
    e = exponential_average(df, by, ts, value, alpha)
    return e.withColumn("outlier", F.coalesce(F.abs(F.col(value) - F.lag("ema").over(_w(by, ts))) > threshold, F.lit(False)))


def holt_winters(df: DataFrame, by: Sequence[str], ts: str, value: str, periods: int, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1, season: int = 0) -> DataFrame:
    """(by, step, forecast): exponential smoothing with trend, and with an additive season if its length is given."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(ts)[value].astype(float).tolist()
        level, slope, s = (x[0] if x else 0.0), (x[1] - x[0] if len(x) > 1 else 0.0), [0.0] * max(season, 1)
        if season and len(x) >= season:
            level = sum(x[:season]) / season
            s = [v - level for v in x[:season]]
            slope = (sum(x[season : 2 * season]) / season - level) / season if len(x) >= 2 * season else 0.0
        for i, v in enumerate(x):
            old = s[i % len(s)] if season else 0.0
            before = level
            level = alpha * (v - old) + (1 - alpha) * (level + slope)
            slope = beta * (level - before) + (1 - beta) * slope
            if season:
                s[i % len(s)] = gamma * (v - level) + (1 - gamma) * old
        out = pd.DataFrame({"step": range(1, periods + 1)})
        out["forecast"] = [level + h * slope + (s[(len(x) + h - 1) % len(s)] if season else 0.0) for h in range(1, periods + 1)]
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "step", "forecast"]]

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return df.select(*by, ts, value).groupBy(*by).applyInPandas(run, f"{kinds}, step int, forecast double")


def autoregression(df: DataFrame, by: Sequence[str], ts: str, value: str, periods: int, order: int = 2, difference: int = 0, moving: int = 0) -> DataFrame:
    """(by, step, forecast): ARIMA(order, difference, moving) fitted by least squares for each series.

    The moving-average part is fitted in two steps: a longer autoregression gives the shocks, on which and on
    past values the series is then regressed; shocks to come are zero.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        x = pdf.sort_values(ts)[value].to_numpy(float)
        heads = []
        for _ in range(difference):
            heads.append(x[-1])
            x = np.diff(x)

        def lagged(v: np.ndarray, n: int, first: int) -> list[np.ndarray]:
            return [v[first - k - 1 : len(v) - k - 1] for k in range(n)]

        shocks, first = np.zeros(len(x)), order
        if moving and len(x) > 2 * (order + moving) + moving:
            long = order + moving
            rows = np.column_stack([np.ones(len(x) - long), *lagged(x, long, long)])
            shocks[long:] = x[long:] - rows @ np.linalg.lstsq(rows, x[long:], rcond=None)[0]
            first = long + moving
        q = moving if first > order else 0
        if len(x) > 2 * first:
            rows = np.column_stack([np.ones(len(x) - first), *lagged(x, order, first), *lagged(shocks, q, first)])
            coef = np.linalg.lstsq(rows, x[first:], rcond=None)[0]
        else:
            coef = np.array([x.mean() if len(x) else 0.0, *[0.0] * (order + q)])
        past, past_shocks, found = list(x), list(shocks), []
        for _ in range(periods):
            past.append(float(coef[0] + sum(c * v for c, v in zip(coef[1 : order + 1], past[::-1])) + sum(c * v for c, v in zip(coef[order + 1 :], past_shocks[::-1]))))
            past_shocks.append(0.0)
            found.append(past[-1])
        out = np.array(found)
        for h in reversed(heads):
            out = h + np.cumsum(out)
        res = pd.DataFrame({"step": range(1, periods + 1), "forecast": out})
        for c in by:
            res[c] = pdf[c].iloc[0]
        return res[[*by, "step", "forecast"]]

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return df.select(*by, ts, value).groupBy(*by).applyInPandas(run, f"{kinds}, step int, forecast double")
