"""Time series and row versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinql.operators import temporal as V
from skeinql.operators import timeseries as T
from skeinql.queries._base import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("ts")).agg(F.sum("value").alias("value"))
    return e.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


HOURLY = "h AS (SELECT event_type, date_trunc('hour', ts) AS ts, sum(value) AS value FROM events GROUP BY ALL)"
RN = "n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i, count(*) OVER (PARTITION BY event_type) AS c FROM h)"

R.sql("time_bucket", "events", "SELECT event_type, window.start AS bucket, count(*) AS n, round(avg(value), 9) AS mean FROM events GROUP BY event_type, window(ts, '15 minutes')", "SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, count(*) AS n, round(avg(value), 9) AS mean FROM events GROUP BY ALL")


def _down(how: str, sql: str) -> None:
    @R.add(f"downsample_{how}", f"SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS bucket, round({sql}, 9) AS value FROM events GROUP BY ALL")
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = table(spark, d, "events").withColumn("ts", F.col("ts"))
        return T.downsample(e, ["event_type"], "ts", "value", "6 hours", how).withColumn("value", F.round("value", 9))


for _how, _sql in {"mean": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "count": "count(value)", "stddev": "stddev_samp(value)", "median": "median(value)"}.items():
    _down(_how, _sql)

_FILL = f"""WITH {HOURLY}, s AS (SELECT event_type, min(ts) AS a, max(ts) AS b FROM h GROUP BY event_type), g AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL 30 MINUTE)) AS ts FROM s),
j AS (SELECT g.event_type, g.ts, h.value, CASE WHEN h.value IS NOT NULL THEN g.ts END AS k FROM g LEFT JOIN h USING (event_type, ts)),
w AS (SELECT *, last_value(value IGNORE NULLS) OVER p AS pv, first_value(value IGNORE NULLS) OVER f AS nv, last_value(k IGNORE NULLS) OVER p AS pt, first_value(k IGNORE NULLS) OVER f AS nt FROM j
 WINDOW p AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, ts, round(%s, 9) AS value FROM w"""


_SPLINE = f"""WITH {HOURLY}, s AS (SELECT event_type, min(ts) AS a, max(ts) AS b FROM h GROUP BY event_type), g AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL 30 MINUTE)) AS ts FROM s),
k AS (SELECT event_type, ts, CAST(epoch_us(ts) AS DOUBLE) AS t, value AS v, (coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value)) / nullif(coalesce(lead(CAST(epoch_us(ts) AS DOUBLE)) OVER w, epoch_us(ts)) - coalesce(lag(CAST(epoch_us(ts) AS DOUBLE)) OVER w, epoch_us(ts)), 0) AS m FROM h WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
j AS (SELECT g.event_type, g.ts, CAST(epoch_us(g.ts) AS DOUBLE) AS x, a.t AS t0, a.v AS v0, a.m AS m0, b.t AS t1, b.v AS v1, b.m AS m1 FROM g ASOF JOIN k a ON g.event_type = a.event_type AND g.ts >= a.ts ASOF JOIN k b ON g.event_type = b.event_type AND g.ts <= b.ts),
u AS (SELECT *, t1 - t0 AS w, (x - t0) / nullif(t1 - t0, 0) AS s FROM j)
SELECT event_type, ts, round(CASE WHEN w = 0 THEN v0 ELSE (2 * s * s * s - 3 * s * s + 1) * v0 + (s * s * s - 2 * s * s + s) * w * m0 + (3 * s * s - 2 * s * s * s) * v1 + (s * s * s - s * s) * w * m1 END, 6) AS value FROM u"""


def _fill(method: str, sql: str | None) -> None:
    digits = 9 if sql else 6

    @R.add(f"gap_fill_{method}", _FILL % sql if sql else _SPLINE)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return T.fill_gaps(_hourly(spark, d), ["event_type"], "ts", "value", "30 minutes", method).select("event_type", "ts", F.round("value", digits).alias("value"))


for _m, _sql in {
    "spline": None, "previous": "pv", "next": "nv", "average": "coalesce(value, (pv + nv) / 2)", "constant": "coalesce(value, 0.0)", "null": "value",
    "linear": "CASE WHEN pt = nt THEN pv ELSE pv + (nv - pv) * (epoch_us(ts) - epoch_us(pt)) / (epoch_us(nt) - epoch_us(pt)) END",
}.items():
    _fill(_m, _sql)


@R.add("moving_averages", f"""WITH {HOURLY}, x AS (SELECT event_type, ts, value, avg(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sma, sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total, list(value) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS l FROM h WINDOW w AS (PARTITION BY event_type ORDER BY ts))
SELECT event_type, ts, round(sma, 9) AS sma, round(total, 2) AS running_total, round(list_sum(list_transform(l, lambda v, i: v * i)) / (len(l) * (len(l) + 1) / 2), 9) AS wma FROM x""")
def moving_averages(spark: SparkSession, d: str) -> DataFrame:
    by, h = ["event_type"], _hourly(spark, d)
    return h.select("event_type", "ts", F.round(T.moving_average("value", by, "ts", 5), 9).alias("sma"), F.round(T.cumulative_average("value", by, "ts") * F.row_number().over(Window.partitionBy(*by).orderBy("ts")), 2).alias("running_total"), F.round(T.weighted_average("value", by, "ts", 4), 9).alias("wma"))


@R.add("exponential_average", f"WITH RECURSIVE {HOURLY}, {RN}, e AS (SELECT event_type, ts, i, value AS ema FROM n WHERE i = 1 UNION ALL SELECT n.event_type, n.ts, n.i, 0.3 * n.value + 0.7 * e.ema FROM e JOIN n ON n.event_type = e.event_type AND n.i = e.i + 1) SELECT event_type, ts, round(ema, 9) AS ema FROM e")
def exponential_average(spark: SparkSession, d: str) -> DataFrame:
    return T.exponential_average(_hourly(spark, d), ["event_type"], "ts", "value", 0.3).select("event_type", "ts", F.round("ema", 9).alias("ema"))


@R.add("autocorrelation", f"""WITH {HOURLY}, m AS (SELECT event_type, ts, value - avg(value) OVER (PARTITION BY event_type) AS x FROM h), l AS (SELECT event_type, x, k, lag(x, k) OVER (PARTITION BY event_type, k ORDER BY ts) AS y FROM m, (SELECT unnest([1, 2, 3, 24]) AS k))
SELECT event_type, CAST(k AS INT) AS lag, round(sum(x * y) / sum(x * x), 6) AS r FROM l GROUP BY ALL""")
def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    return T.autocorrelation(_hourly(spark, d), ["event_type"], "ts", "value", [1, 2, 3, 24]).withColumn("r", F.round("r", 6))


@R.add("seasonality", """WITH w AS (SELECT range AS t, 10 * sin(range * 3.141592653589793 / 6) + (range * 7) % 3 AS v FROM range(240)), m AS (SELECT t, v - avg(v) OVER () AS x FROM w), r AS (SELECT k, sum(a.x * b.x) / (SELECT sum(x * x) FROM m) AS r FROM m a JOIN (SELECT unnest(generate_series(2, 30)) AS k) ON true JOIN m b ON b.t = a.t - k GROUP BY k)
SELECT 'wave' AS s, CAST(k AS INT) AS period, round(r, 9) AS strength FROM r WHERE r > 0.5 ORDER BY r DESC, k LIMIT 1""")
def seasonality(spark: SparkSession, d: str) -> DataFrame:
    wave = spark.range(240).select(F.lit("wave").alias("s"), F.col("id").alias("ts"), (10 * F.sin(F.col("id") * 3.141592653589793 / 6) + F.pmod(F.col("id") * 7, F.lit(3))).alias("value"))
    return T.seasonality(wave, ["s"], "ts", "value", 30).withColumn("strength", F.round("strength", 9))


@R.add("decompose", f"""WITH {HOURLY}, {RN}, t AS (SELECT *, (i - 1) % 24 AS k, avg(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS trend FROM n), s AS (SELECT *, avg(value - trend) OVER (PARTITION BY event_type, k) AS seasonal FROM t)
SELECT event_type, ts, round(trend, 9) AS trend, round(seasonal, 9) AS seasonal, round(value - trend - seasonal, 9) AS residual FROM s""")
def decompose(spark: SparkSession, d: str) -> DataFrame:
    out = T.decompose(_hourly(spark, d), ["event_type"], "ts", "value", 24)
    return out.select("event_type", "ts", *[F.round(c, 9).alias(c) for c in ("trend", "seasonal", "residual")])


@R.add("changes_and_rates", f"""WITH {HOURLY}, l AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM h) SELECT event_type, ts, coalesce(abs(value - p) > 100, false) AS jump, round((value - p) / nullif(p, 0), 9) AS roc FROM l""")
def changes_and_rates(spark: SparkSession, d: str) -> DataFrame:
    by = ["event_type"]
    return _hourly(spark, d).select("event_type", "ts", T.change_points("value", by, "ts", 100.0).alias("jump"), F.round(T.rate_of_change("value", by, "ts"), 9).alias("roc"))


@R.add("trend", f"""WITH {HOURLY}, l AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS p, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM h), a AS (SELECT event_type, count(*) FILTER (WHERE value > p) AS ups, count(*) FILTER (WHERE value < p) AS downs, round(regr_r2(value, i), 6) AS strength FROM l GROUP BY event_type)
SELECT *, CASE WHEN ups > 2 * downs THEN 'up' WHEN downs > 2 * ups THEN 'down' ELSE 'flat' END AS trend FROM a""")
def trend(spark: SparkSession, d: str) -> DataFrame:
    return T.trend(_hourly(spark, d), ["event_type"], "ts", "value").withColumn("strength", F.round("strength", 6))


@R.add("linear_forecast", f"WITH {HOURLY}, {RN}, f AS (SELECT event_type, regr_slope(value, i - 1) AS m, regr_intercept(value, i - 1) AS c, count(*) AS k FROM n GROUP BY event_type) SELECT event_type, CAST(s AS INT) AS step, round(c + m * (k + s - 1), 9) AS forecast FROM f, (SELECT unnest(generate_series(1, 5)) AS s)")
def linear_forecast(spark: SparkSession, d: str) -> DataFrame:
    return T.linear_forecast(_hourly(spark, d), ["event_type"], "ts", "value", 5).withColumn("forecast", F.round("forecast", 9))


@R.add("outliers_z", "SELECT event_id FROM (SELECT event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY event_type)) WHERE abs(value - m) / s > 3")
def outliers_z(spark: SparkSession, d: str) -> DataFrame:
    return T.outliers_z(table(spark, d, "events"), ["event_type"], "value").where("outlier").select("event_id")


_RANKED = "r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


@R.add("outliers_iqr", f"WITH {_RANKED}, q AS (SELECT event_type, max(value) FILTER (WHERE i = n // 4) AS q1, max(value) FILTER (WHERE i = 3 * n // 4) AS q3 FROM r GROUP BY event_type) SELECT event_id FROM events JOIN q USING (event_type) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)")
def outliers_iqr(spark: SparkSession, d: str) -> DataFrame:
    return T.outliers_iqr(table(spark, d, "events"), ["event_type"], "value").where("outlier").select("event_id")


@R.add("outliers_mad", f"WITH {_RANKED}, m AS (SELECT event_type, max(value) FILTER (WHERE i = n // 2) AS m FROM r GROUP BY event_type), x AS (SELECT e.event_id, e.event_type, abs(e.value - m.m) AS dist FROM events e JOIN m USING (event_type)), y AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY dist) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM x), z AS (SELECT event_type, max(dist) FILTER (WHERE i = n // 2) AS mad FROM y GROUP BY event_type) SELECT event_id FROM x JOIN z USING (event_type) WHERE 0.6745 * dist / mad > 3.5")
def outliers_mad(spark: SparkSession, d: str) -> DataFrame:
    return T.outliers_mad(table(spark, d, "events"), ["event_type"], "value").where("outlier").select("event_id")


@R.add("outliers_ewma", f"WITH RECURSIVE {HOURLY}, {RN}, e AS (SELECT event_type, ts, i, value, CAST(NULL AS DOUBLE) AS before, value AS ema FROM n WHERE i = 1 UNION ALL SELECT n.event_type, n.ts, n.i, n.value, e.ema, 0.3 * n.value + 0.7 * e.ema FROM e JOIN n ON n.event_type = e.event_type AND n.i = e.i + 1) SELECT event_type, ts FROM e WHERE abs(value - before) > 200")
def outliers_ewma(spark: SparkSession, d: str) -> DataFrame:
    return T.outliers_ewma(_hourly(spark, d), ["event_type"], "ts", "value", 0.3, 200.0).where("outlier").select("event_type", "ts")


_HW = f"""WITH RECURSIVE {HOURLY}, {RN}, b AS (SELECT event_type, list(value ORDER BY i) AS x FROM n GROUP BY event_type),
s0 AS (SELECT event_type, x, list_sum(x[1:24]) / 24 AS l, list_sum(x[25:48]) / 24 AS l2 FROM b),
z AS (SELECT event_type, 0 AS i, x, l AS level, (l2 - l) / 24 / 1.0 AS slope, list_transform(x[1:24], lambda v: v - l) AS s FROM s0
UNION ALL SELECT event_type, i + 1, x, 0.3 * (x[i + 1] - s[i % 24 + 1]) + 0.7 * (level + slope), 0.1 * (0.3 * (x[i + 1] - s[i % 24 + 1]) + 0.7 * (level + slope) - level) + 0.9 * slope,
 list_transform(s, lambda v, k: CASE WHEN k = i % 24 + 1 THEN 0.1 * (x[i + 1] - (0.3 * (x[i + 1] - s[i % 24 + 1]) + 0.7 * (level + slope))) + 0.9 * v ELSE v END) FROM z WHERE i < len(x))
SELECT event_type, CAST(h AS INT) AS step, round(level + h * slope + s[(len(x) + h - 1) % 24 + 1], 6) AS forecast FROM z, (SELECT unnest(generate_series(1, 12)) AS h) WHERE i = len(x)"""


@R.add("holt_winters", _HW)
def holt_winters(spark: SparkSession, d: str) -> DataFrame:
    return T.holt_winters(_hourly(spark, d), ["event_type"], "ts", "value", 12, season=24).withColumn("forecast", F.round("forecast", 6))


@R.add("autoregression")
def autoregression(spark: SparkSession, d: str) -> DataFrame:
    return T.autoregression(_hourly(spark, d), ["event_type"], "ts", "value", 12, 3, 1)


def _versions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderstatus").alias("status"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return V.versions_of(o, ["o_custkey"], "o_orderdate")


VERSIONS = "v AS (SELECT o_custkey, status, total, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS valid_to FROM (SELECT o_custkey, o_orderdate, max(o_orderstatus) AS status, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL))"
_t = lambda s: F.lit(s).cast("timestamp_ntz")


@R.add("as_of", f"WITH {VERSIONS} SELECT o_custkey, status, total FROM v WHERE valid_from <= TIMESTAMP '1997-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-06-01')")
def as_of(spark: SparkSession, d: str) -> DataFrame:
    return V.as_of(_versions(spark, d), _t("1997-06-01")).select("o_custkey", "status", "total")


@R.add("versions_between", f"WITH {VERSIONS} SELECT o_custkey, valid_from, valid_to FROM v WHERE valid_from < TIMESTAMP '1997-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01')")
def versions_between(spark: SparkSession, d: str) -> DataFrame:
    return V.versions_between(_versions(spark, d), _t("1997-01-01"), _t("1997-06-01")).select("o_custkey", "valid_from", "valid_to")


@R.add("bitemporal", f"WITH {VERSIONS} SELECT o_custkey, total FROM (SELECT *, valid_from + INTERVAL 10 DAY AS tx_from FROM v) WHERE tx_from <= TIMESTAMP '1998-01-01' AND valid_from <= TIMESTAMP '1997-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-06-01')")
def bitemporal(spark: SparkSession, d: str) -> DataFrame:
    v = _versions(spark, d).withColumns({"tx_from": F.col("valid_from") + F.expr("INTERVAL 10 DAYS"), "tx_to": F.lit(None).cast("timestamp_ntz")})
    return V.bitemporal(v, _t("1998-01-01"), _t("1997-06-01")).select("o_custkey", "total")


@R.add("version_changes", f"WITH {VERSIONS}, l AS (SELECT *, lag(status) OVER w AS ps, row_number() OVER w AS i FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY valid_from)) SELECT o_custkey, valid_from, 'status' AS \"column\", ps AS before, status AS after FROM l WHERE i > 1 AND ps IS DISTINCT FROM status")
def version_changes(spark: SparkSession, d: str) -> DataFrame:
    return V.version_changes(_versions(spark, d), ["o_custkey"], ["status"])


@R.add("versioned_join", f"WITH {VERSIONS} SELECT c_custkey, v.status FROM customer LEFT JOIN v ON c_custkey = o_custkey AND valid_from <= TIMESTAMP '1997-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01')")
def versioned_join(spark: SparkSession, d: str) -> DataFrame:
    from skeinql.operators.joins import versioned_join as join

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), _t("1997-01-01").alias("at"))
    return join(c, _versions(spark, d), "o_custkey", "at").select(F.col("o_custkey").alias("c_custkey"), "status")


@R.add("change_capture", """WITH a AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 0), b AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 11 <> 0)
SELECT op, count(*) AS n FROM (SELECT CASE WHEN a.c_custkey IS NULL THEN 'insert' WHEN b.c_custkey IS NULL THEN 'delete' WHEN a.c_acctbal <> b.c_acctbal THEN 'update' END AS op FROM a FULL JOIN b USING (c_custkey)) WHERE op IS NOT NULL GROUP BY op""")
def change_capture(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    after = c.where("c_custkey % 11 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return V.change_capture(c.where("c_custkey % 10 <> 0"), after, ["c_custkey"]).groupBy("op").agg(F.count("*").alias("n"))


def _scd(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return s, s.where("s_suppkey % 3 = 0").withColumn("s_nationkey", (F.col("s_nationkey") + F.col("s_suppkey") % 2).cast("int"))


_NEWS = "n AS (SELECT s_suppkey, s_nationkey + s_suppkey % 2 AS s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)"


@R.add("scd1", f"WITH {_NEWS} SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT * FROM n")
def scd1(spark: SparkSession, d: str) -> DataFrame:
    return V.scd1(*_scd(spark, d), ["s_suppkey"])


@R.add("scd2", f"WITH {_NEWS} SELECT s.s_suppkey, s.s_nationkey, CASE WHEN n.s_nationkey <> s.s_nationkey THEN 1 ELSE 0 END AS closed FROM supplier s LEFT JOIN n USING (s_suppkey) UNION ALL SELECT n.s_suppkey, n.s_nationkey, 0 FROM n JOIN supplier s USING (s_suppkey) WHERE n.s_nationkey <> s.s_nationkey")
def scd2(spark: SparkSession, d: str) -> DataFrame:
    old, news = _scd(spark, d)
    old = old.withColumns({"valid_from": _t("2020-01-01"), "valid_to": F.lit(None).cast("timestamp_ntz")})
    return V.scd2(old, news, ["s_suppkey"], _t("2024-01-01")).select("s_suppkey", "s_nationkey", F.col("valid_to").isNotNull().cast("int").alias("closed"))


@R.add("scd3", f"WITH {_NEWS} SELECT s.s_suppkey, coalesce(n.s_nationkey, s.s_nationkey) AS s_nationkey, CASE WHEN n.s_nationkey <> s.s_nationkey THEN s.s_nationkey END AS previous_s_nationkey FROM supplier s LEFT JOIN n USING (s_suppkey)")
def scd3(spark: SparkSession, d: str) -> DataFrame:
    return V.scd3(*_scd(spark, d), ["s_suppkey"], "s_nationkey")
