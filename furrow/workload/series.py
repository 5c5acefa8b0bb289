"""Series, buckets, trends and the crop index run."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import models, smoothing, stats, timeseries
from furrow.plans import crop_index
from furrow.session import scratch_path, shared_dir
from furrow.streaming import market
from furrow.workload.registry import YEARLY, query, table, yearly


@query(f"""WITH {YEARLY}
SELECT priority, year, round((total / nullif(lag(total) OVER w, 0) - 1) * 100, 4) AS pct_change
FROM yearly WINDOW w AS (PARTITION BY priority ORDER BY year)""")
def ts_pct_change(spark, sf_dir):
    # One row per year and priority: the calendar bounds a group.
    change = timeseries.pct_change(yearly(spark, sf_dir), ["priority"], ["year"], "total", bounded=True)
    return change.select("priority", "year", F.round("pct_change", 4).alias("pct_change"))


@query(f"""WITH {YEARLY}
SELECT priority, year, round(total / nullif(first_value(total) OVER w, 0) * 100, 4) AS base_index
FROM yearly WINDOW w AS (PARTITION BY priority ORDER BY year)""")
def ts_base_index(spark, sf_dir):
    growth = timeseries.base_index(yearly(spark, sf_dir), ["priority"], ["year"], "total", bounded=True)
    return growth.select("priority", "year", F.round("base_index", 4).alias("base_index"))


_CHANGES = """changes AS (
  SELECT event_id, user_id, event_type, value,
         (value / nullif(lag(value) OVER w, 0) - 1) * 100 AS change,
         value / nullif(first_value(value) OVER w, 0) * 100 AS growth
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _changes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return timeseries.series_metrics(events, ["user_id"], ["ts", "event_id"], "value", "change", "growth")


@query(f"""WITH {_CHANGES}
SELECT event_id, round(change, 8) AS change, round(growth, 8) AS growth FROM changes""")
def user_series(spark, sf_dir):
    return _changes(spark, sf_dir).select(
        "event_id", F.round("change", 8).alias("change"), F.round("growth", 8).alias("growth")
    )


@query(f"""WITH {_CHANGES}
SELECT event_type, round_even(avg(value), 2) AS "Mean_Index", round_even(min(value), 2) AS "Min_Index",
       round_even(max(value), 2) AS "Max_Index", round_even(stddev_samp(value), 2) AS "Std_Index",
       round_even(avg(change), 2) AS "Mean_YoY_Change", round_even(stddev_samp(change), 2) AS "Std_YoY_Change"
FROM changes GROUP BY 1""")
def group_summary(spark, sf_dir):
    return stats.group_summary(_changes(spark, sf_dir), "event_type", "value", "change")


_BUCKETS = """buckets AS (
  SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS bucket, min(value) AS min_price, max(value) AS max_price,
         avg(value) AS avg_price, count(value) AS n_prices
  FROM source GROUP BY 1, 2)
SELECT event_type, bucket, min_price, max_price, round(avg_price, 8) AS avg_price, n_prices,
       round((avg_price / nullif(lag(avg_price) OVER (PARTITION BY event_type ORDER BY bucket), 0) - 1) * 100, 8) AS change
FROM buckets"""


def _rounded(buckets):
    figures = {c: F.round(c, 8) for c in ("avg_price", "change")}
    return buckets.withColumns({**figures, "bucket": F.col("bucket").cast("timestamp_ntz")})


@query(f"WITH source AS (SELECT * FROM events), {_BUCKETS}")
def market_buckets(spark, sf_dir):
    return _rounded(timeseries.price_buckets(table(spark, sf_dir, "events"), ["event_type"], "ts", "value"))


@query(f"""WITH source AS (SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY), {_BUCKETS}""")
def market_last_days(spark, sf_dir):
    recent = timeseries.last_days(table(spark, sf_dir, "events"), "ts", 7)
    return _rounded(timeseries.price_buckets(recent, ["event_type"], "ts", "value"))


_AS_OF = "2024-01-31 00:00:00"
_PERIODS = {"day": 1, "week": 7, "fortnight": 14}


@query("SELECT event_type, " + ", ".join(
    f"""round((avg(value) FILTER (ts > TIMESTAMP '{_AS_OF}' - INTERVAL {d} DAY AND ts <= TIMESTAMP '{_AS_OF}')
        / nullif(avg(value) FILTER (ts > TIMESTAMP '{_AS_OF}' - INTERVAL {2 * d} DAY
                                    AND ts <= TIMESTAMP '{_AS_OF}' - INTERVAL {d} DAY), 0) - 1) * 100, 8) AS {name}_growth"""
    for name, d in _PERIODS.items()) + " FROM events GROUP BY 1")
def market_growth(spark, sf_dir):
    growth = timeseries.period_growth(
        table(spark, sf_dir, "events"), ["event_type"], "ts", "value", F.lit(_AS_OF).cast("timestamp"), _PERIODS
    )
    return growth.select("event_type", *[F.round(f"{p}_growth", 8).alias(f"{p}_growth") for p in _PERIODS])


@query("""WITH w AS (
  SELECT time_bucket(INTERVAL 1 DAY, ts) AS bucket, event_type, min(value) AS min_price, max(value) AS max_price,
         round(avg(value), 8) AS avg_price, count(value) AS n_prices
  FROM events GROUP BY 1, 2)
SELECT * FROM w WHERE bucket + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def market_stream(spark, sf_dir):
    # All events in several files, each with rows of every day, as feeds of several markets would write them.
    target = scratch_path(spark, "market-stream")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    events.repartition(4, "event_id").write.parquet(f"{target}/events")
    prices = market.read_stream(spark, f"{target}/events", events.schema)
    windows = market.price_windows(prices, ["event_type"], "ts", "value")
    market.finish(market.write_windows(windows, f"{target}/table", f"{target}/checkpoint"))
    closed = spark.read.schema(windows.schema).parquet(f"{target}/table")
    return closed.withColumns({"avg_price": F.round("avg_price", 8), "bucket": F.col("bucket").cast("timestamp_ntz")})


_CUT = "2024-01-12 09:30:00"


@query(f"""WITH w AS (
  SELECT time_bucket(INTERVAL 1 DAY, ts) AS bucket, event_type, min(value) AS min_price, max(value) AS max_price,
         round(avg(value), 8) AS avg_price, count(value) AS n_prices, count(value) FILTER (ts < TIMESTAMP '{_CUT}') AS n_late,
         CAST(bool_or(ts < TIMESTAMP '{_CUT}') AS BIGINT) AS n_corrections
  FROM events GROUP BY 1, 2)
SELECT * FROM w WHERE bucket + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def market_late_rows(spark, sf_dir):
    """The later rows arrive first; everything before the cut comes when its windows are closed already, but for the last ones."""
    target = scratch_path(spark, "market-late")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    cut = F.lit(_CUT).cast("timestamp")
    for feed in (F.col("ts") >= cut, F.col("ts") < cut):
        events.where(feed).write.mode("append").parquet(f"{target}/events")
        prices = market.read_stream(spark, f"{target}/events", events.schema)
        market.write_arrivals(prices, f"{target}/arrivals", f"{target}/checkpoint").awaitTermination()
    arrivals = spark.read.parquet(f"{target}/arrivals")
    revised = market.revisions(arrivals, ["event_type"], "ts", "value")
    windows = market.settled(revised, ["event_type"], arrivals.agg(F.max("ts")).scalar())
    return windows.withColumns({"avg_price": F.round("avg_price", 8), "bucket": F.col("bucket").cast("timestamp_ntz")})


@query(f"""WITH {YEARLY}, scaled AS (SELECT priority, (year - 1995)::DOUBLE AS t, total / 1000000 AS y FROM yearly)
SELECT priority, round(regr_slope(y, t), 4) AS slope, round(regr_intercept(y, t), 4) AS intercept, max(t) + 1 AS at,
       round(regr_intercept(y, t) + regr_slope(y, t) * (max(t) + 1), 4) AS forecast
FROM scaled GROUP BY 1""")
def index_forecast(spark, sf_dir):
    scaled = yearly(spark, sf_dir).select(
        "priority", (F.col("year") - 1995).alias("t"), (F.col("total") / 1000000).alias("y")
    )
    line = timeseries.linear_trend(scaled, ["priority"], "t", "y")
    return line.withColumns({c: F.round(c, 4) for c in ("slope", "intercept", "forecast")})


# The level of each series step by step, for every rate.
_SMOOTHED = """RECURSIVE s AS MATERIALIZED (
  SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS no FROM events),
r AS (
  SELECT event_type, rate / 10.0::DOUBLE AS rate, no, x AS level, 0::DOUBLE AS squares FROM s, generate_series(1, 9) AS g(rate) WHERE no = 1
  UNION ALL
  SELECT event_type, rate, s.no, level + rate * (x - level), squares + (x - level) * (x - level)
  FROM r JOIN s USING (event_type) WHERE s.no = r.no + 1),
f AS (
  SELECT event_type, rate, arg_max(level, no) AS forecast, max(no) AS n_values, sqrt(arg_max(squares, no) / nullif(max(no) - 1, 0)) AS rmse
  FROM r GROUP BY 1, 2)"""


@query(f"""WITH {_SMOOTHED} SELECT event_type, rate, n_values, round(forecast, 6) AS forecast, round(rmse, 6) AS rmse FROM f""")
def smoothing_errors(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    errors = smoothing.rolling_errors(events, ["event_type"], ["ts", "event_id"], "value")
    return errors.withColumns({c: F.round(c, 6) for c in ("forecast", "rmse")})


@query(f"""WITH {_SMOOTHED}, k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY rmse, rate) AS place FROM f)
SELECT event_type, rate, n_values, round(forecast, 6) AS forecast, round(rmse, 6) AS rmse FROM k WHERE place = 1""")
def smoothed_forecast(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    best = smoothing.smoothed(events, ["event_type"], ["ts", "event_id"], "value")
    return best.withColumns({c: F.round(c, 6) for c in ("forecast", "rmse")})


@query("""WITH line AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b
                        FROM lineitem)
SELECT DISTINCT l_quantity, round(b + a * l_quantity, 2) AS prediction FROM lineitem, line""")
def yield_model(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    model = models.yield_regression(rows, "l_extendedprice", numbers=["l_quantity"])
    fitted = models.predict(model, rows.select("l_quantity").distinct())
    return fitted.select("l_quantity", F.round("prediction", 2).alias("prediction"))


_YEARS = range(1995, 2002)

# Quantity shipped per supplier and year as loosely typed text: padded names, one row in eleven
# without values, one in seven with a bad cell.
_RAW = f"""raw AS (
  SELECT l_suppkey, CASE WHEN l_suppkey % 11 <> 5 THEN 'Supplier-' || l_suppkey END AS crop, {", ".join(
      f"CASE WHEN l_suppkey % 11 <> 5 {'AND l_suppkey % 7 <> 0' if y == 1997 else ''} "
      f"THEN sum(CASE WHEN year(l_shipdate) = {y} THEN l_quantity END) END AS y{y}"
      for y in _YEARS)}
  FROM lineitem GROUP BY 1),
wide AS (SELECT crop AS "Crop", {", ".join(f'coalesce(y{y}, avg(y{y}) OVER ()) AS "Year_{y}"' for y in _YEARS)}
         FROM raw WHERE crop IS NOT NULL)"""
_LONG = f"""{_RAW}, melted AS ({" UNION ALL ".join(
    f'''SELECT "Crop", '{y}' AS "Year", "Year_{y}" AS "Index_Value" FROM wide''' for y in _YEARS)}),
long AS (SELECT *, ("Index_Value" / nullif(lag("Index_Value") OVER w, 0) - 1) * 100 AS "YoY_Pct_Change",
                "Index_Value" / nullif(first_value("Index_Value") OVER w, 0) * 100 AS "Cumulative_Growth"
         FROM melted WINDOW w AS (PARTITION BY "Crop" ORDER BY "Year"))"""


def _raw(spark, sf_dir):
    """Stored once, as the file it stands for would be: several steps read it."""
    shared_dir(spark)
    known = F.col("l_suppkey") % 11 != 5
    shipped = table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    sums = shipped.groupBy("l_suppkey").pivot("year", list(_YEARS)).sum("l_quantity")
    cells = {str(y): F.col(str(y)).cast("long").cast("string") for y in _YEARS}
    cells["1997"] = F.when(F.col("l_suppkey") % 7 == 0, F.lit("unknown")).otherwise(cells["1997"])
    return sums.select(
        F.when(known, F.concat(F.lit(" Supplier-"), F.col("l_suppkey"), F.lit("\t"))).alias("Crop"),
        *[F.when(known, cell).alias(name) for name, cell in cells.items()],
        F.col("l_suppkey"),
    ).checkpoint()


def _tables(spark, sf_dir):
    # One raw row per supplier, so a series has seven rows.
    return crop_index.crop_index(_raw(spark, sf_dir), ["l_suppkey"], bounded=True)


@query(f"""WITH {_RAW} SELECT "Crop", {", ".join(f'round("Year_{y}", 8) AS "Year_{y}"' for y in _YEARS)} FROM wide""")
def crop_index_wide(spark, sf_dir):
    wide = _tables(spark, sf_dir)["wide"]
    return wide.withColumns({f"Year_{y}": F.round(f"Year_{y}", 8) for y in _YEARS})


@query(f"""WITH {_LONG} SELECT "Crop", "Year", {", ".join(
    f'round("{c}", 8) AS "{c}"' for c in ("Index_Value", "YoY_Pct_Change", "Cumulative_Growth"))} FROM long""")
def crop_index_long(spark, sf_dir):
    long = _tables(spark, sf_dir)["long"]
    return long.withColumns({c: F.round(c, 8) for c in ("Index_Value", "YoY_Pct_Change", "Cumulative_Growth")})


@query(f"""WITH {_LONG} SELECT "Crop", round_even(avg("Index_Value"), 2) AS "Mean_Index",
  round_even(min("Index_Value"), 2) AS "Min_Index", round_even(max("Index_Value"), 2) AS "Max_Index",
  round_even(stddev_samp("Index_Value"), 2) AS "Std_Index", round_even(avg("YoY_Pct_Change"), 2) AS "Mean_YoY_Change",
  round_even(stddev_samp("YoY_Pct_Change"), 2) AS "Std_YoY_Change" FROM long GROUP BY 1""")
def crop_index_summary(spark, sf_dir):
    return _tables(spark, sf_dir)["summary"]


@query(f"""WITH {_LONG} SELECT count(*) AS n_records, min("Year") AS first_year, max("Year") AS last_year,
  count(*) - count("YoY_Pct_Change") AS n_missing, count(DISTINCT "Crop") AS n_crops, CAST(0 AS BIGINT) AS n_duplicates FROM long""")
def crop_index_report(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    return crop_index.report(tables["wide"], tables["long"])


@query("""WITH g AS (SELECT l_returnflag, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem GROUP BY 1),
line AS (SELECT sum((l_quantity - mx) * (l_extendedprice - my)) / sum((l_quantity - mx) ** 2) AS b FROM lineitem JOIN g USING (l_returnflag))
SELECT DISTINCT l_returnflag, l_quantity, round(my + b * (l_quantity - mx), 1) AS prediction FROM lineitem JOIN g USING (l_returnflag), line""")
def yield_model_categories(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    model = models.yield_regression(rows, "l_extendedprice", ["l_returnflag"], ["l_quantity"])
    fitted = models.predict(model, rows.select("l_returnflag", "l_quantity").distinct())
    return fitted.select("l_returnflag", "l_quantity", F.round("prediction", 1).alias("prediction"))


# Five folds by order; levels of parts are means of the other folds, slopes come from what is left around them.
_FOLDS = """WITH d AS (SELECT l_partkey AS c, l_orderkey % 5 AS fold, l_quantity::DOUBLE AS x, l_extendedprice / 1000 AS y FROM lineitem),
f AS (SELECT DISTINCT fold FROM d),
means AS (SELECT f.fold, c, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM f JOIN d ON d.fold <> f.fold GROUP BY 1, 2),
line AS (SELECT m.fold, sum((x - mx) * (y - my)) / sum((x - mx) ** 2) AS b FROM means m JOIN d ON d.c = m.c AND d.fold <> m.fold GROUP BY 1)
SELECT d.fold, (SELECT count(*) FROM d) - count(*) AS n_train, count(*) AS n_test, count(*) FILTER (m.c IS NULL) AS n_unknown,
  round(sqrt(avg((y - my - b * (x - mx)) ** 2)), 6) AS rmse
FROM d JOIN line USING (fold) LEFT JOIN means m ON m.fold = d.fold AND m.c = d.c GROUP BY 1"""


@query(_FOLDS)
def yield_model_folds(spark, sf_dir):
    """Held-out errors of a regression with a level for every part."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"))
    errors = models.fold_errors(rows, "price", "l_partkey", ["l_quantity"], F.col("l_orderkey") % 5)
    return errors.withColumn("rmse", F.round("rmse", 6))


@query("""SELECT DISTINCT l_linenumber, l_returnflag, CASE WHEN l_linenumber > 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction
FROM lineitem""")
def crop_classifier(spark, sf_dir):
    # A label that one of the features decides, so that every sound classifier gives it back.
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag")
    labelled = rows.withColumn("label", F.when(F.col("l_linenumber") > 3, "late").otherwise("early"))
    model = models.crop_classifier(labelled, "label", ["l_returnflag"], ["l_linenumber"])
    return models.predict(model, rows.distinct().withColumn("label", F.lit("early"))).drop("label")


_FIGURES = ("Index_Value", "YoY_Pct_Change", "Cumulative_Growth")
_METRICS = dict(zip("abcdefgh", ("count", "mean", "std", "min", "25%", "50%", "75%", "max")))
_DESCRIBED = ", ".join(
    f"""d{i} AS (SELECT count("{c}")::DOUBLE AS a, avg("{c}") AS b, stddev_samp("{c}") AS c, min("{c}") AS d,
        quantile_cont("{c}", 0.25) AS e, quantile_cont("{c}", 0.5) AS f, quantile_cont("{c}", 0.75) AS g, max("{c}") AS h FROM long)"""
    for i, c in enumerate(_FIGURES)
)
_RECORDS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{m}' AS metric, round({k}, 4) AS value FROM d{i}"""
    for i, c in enumerate(_FIGURES) for k, m in _METRICS.items()
)


@query(f"WITH {_LONG}, {_DESCRIBED} {_RECORDS}")
def crop_index_describe(spark, sf_dir):
    found = crop_index.describe(_tables(spark, sf_dir)["long"])
    return found.withColumn("value", F.round("value", 4))


@query(f"""WITH {_LONG}, q AS (SELECT quantile_cont("YoY_Pct_Change", 0.25) AS a, quantile_cont("YoY_Pct_Change", 0.75) AS b FROM long)
SELECT "Crop", "Year", round("YoY_Pct_Change", 6) AS "YoY_Pct_Change" FROM long, q
WHERE "YoY_Pct_Change" < a - 1.5 * (b - a) OR "YoY_Pct_Change" > b + 1.5 * (b - a)""")
def crop_index_outliers(spark, sf_dir):
    found = crop_index.outliers(_tables(spark, sf_dir)["long"])
    return found.select("Crop", "Year", F.round("YoY_Pct_Change", 6).alias("YoY_Pct_Change"))


_TIED = f"""raw AS (
  SELECT l_suppkey, 'Supplier-' || (l_suppkey % 20) AS crop, {", ".join(
      f"sum(CASE WHEN year(l_shipdate) = {y} THEN l_quantity END)::DOUBLE AS y{y}" for y in _YEARS)}
  FROM lineitem GROUP BY 1),
wide AS (SELECT l_suppkey, crop AS "Crop", {", ".join(f'coalesce(y{y}, avg(y{y}) OVER ()) AS "Year_{y}"' for y in _YEARS)} FROM raw),
melted AS ({" UNION ALL ".join(
    f'''SELECT l_suppkey, "Crop", '{y}' AS "Year", "Year_{y}" AS "Index_Value" FROM wide''' for y in _YEARS)})"""


@query(f"""WITH {_TIED} SELECT "Crop", "Year", round("Index_Value", 8) AS "Index_Value",
       round(("Index_Value" / nullif(lag("Index_Value") OVER w, 0) - 1) * 100, 8) AS "YoY_Pct_Change",
       round("Index_Value" / nullif(first_value("Index_Value") OVER w, 0) * 100, 8) AS "Cumulative_Growth"
FROM melted WINDOW w AS (PARTITION BY "Crop" ORDER BY "Year", l_suppkey)""")
def crop_index_ties(spark, sf_dir):
    """Names that differ in padding alone become one name with several rows a year."""
    shared_dir(spark)
    shipped = table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    sums = shipped.groupBy("l_suppkey").pivot("year", list(_YEARS)).sum("l_quantity")
    padding = F.repeat(F.lit(" "), (F.col("l_suppkey") % 3).cast("int"))
    raw = sums.select(
        F.concat(F.lit("Supplier-"), F.col("l_suppkey") % 20, padding).alias("Crop"),
        *[F.col(str(y)).cast("long").cast("string").alias(str(y)) for y in _YEARS],
        "l_suppkey",
    ).checkpoint()
    long = crop_index.crop_index(raw, ["l_suppkey"])["long"]
    return long.withColumns({c: F.round(c, 8) for c in ("Index_Value", "YoY_Pct_Change", "Cumulative_Growth")})
