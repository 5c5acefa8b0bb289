"""Reports on tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import profile, sketches, stats
from furrow.session import scratch_path
from furrow.workload.registry import GAPS, gaps, query, table

_REPORT = " UNION ALL ".join(
    f"""SELECT '{name}' AS "column", '{kind}' AS data_type, count(*) AS n_rows,
        count(*) - count({name}) AS n_missing, count(DISTINCT {name}) AS n_distinct FROM gaps"""
    for name, kind in {
        "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "kind": "string", "v": "double"
    }.items()
)


@query(f"WITH {GAPS} {_REPORT}")
def profile_columns(spark, sf_dir):
    return profile.columns_report(gaps(spark, sf_dir))


@query("SELECT count(*) AS n_rows, 6 AS n_columns FROM events")
def profile_shape(spark, sf_dir):
    return profile.shape(table(spark, sf_dir, "events"))


@query(f"WITH {GAPS} SELECT 2 * count(*) - count(v) - count(kind) AS n_missing FROM gaps")
def missing_total(spark, sf_dir):
    return profile.missing_total(gaps(spark, sf_dir))


@query("""SELECT count(*) - count(DISTINCT (user_id, event_type)) AS n_duplicates FROM events""")
def duplicate_count(spark, sf_dir):
    return profile.duplicate_count(table(spark, sf_dir, "events").select("user_id", "event_type"))


@query(f"""WITH stats AS (
  SELECT 'l_quantity' AS "column", l_quantity AS x FROM lineitem
  UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem),
wide AS (
  SELECT "column", CAST(count(x) AS DOUBLE) AS "count", avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min,
         quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, max(x) AS max
  FROM stats GROUP BY 1)
{" UNION ALL ".join(
    f'''SELECT "column", '{metric}' AS metric, round({column}, 4) AS value FROM wide'''
    for metric, column in {
        "count": '"count"', "mean": "mean", "std": "std", "min": "min",
        "25%": "q25", "50%": "q50", "75%": "q75", "max": "max",
    }.items())}""")
def profile_describe(spark, sf_dir):
    report = profile.describe(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return report.withColumn("value", F.round("value", 4))


@query('SELECT min(o_orderpriority) AS "first", max(o_orderpriority) AS "last" FROM orders')
def value_range(spark, sf_dir):
    return profile.value_range(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("""SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
          ORDER BY o_orderdate, o_orderkey LIMIT 10""")
def preview_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return profile.preview(orders, ["o_orderdate", "o_orderkey"], 10)


@query("SELECT DISTINCT o_orderpriority FROM orders")
def distinct_values(spark, sf_dir):
    return profile.distinct_values(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("SELECT count(DISTINCT l_partkey) AS n_distinct FROM lineitem")
def distinct_count(spark, sf_dir):
    return profile.distinct_count(table(spark, sf_dir, "lineitem"), "l_partkey")


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
                 round(quantile_cont(l_extendedprice, 0.5), 4) AS q2, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3
          FROM lineitem GROUP BY 1""")
def quantiles_by_group(spark, sf_dir):
    cut = stats.quantiles(
        table(spark, sf_dir, "lineitem"), "l_extendedprice", (0.25, 0.5, 0.75), ["l_returnflag"], name="q"
    )
    return cut.select("l_returnflag", *[F.round(F.col("q")[i], 4).alias(f"q{i + 1}") for i in range(3)])


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value FROM events, q
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def outliers_iqr(spark, sf_dir):
    return stats.iqr_outliers(table(spark, sf_dir, "events").select("event_id", "value"), "value")


@query("""WITH q AS (SELECT lang, quantile_cont(n_chars::DOUBLE, 0.25) AS q1,
                            quantile_cont(n_chars::DOUBLE, 0.75) AS q3 FROM documents GROUP BY 1)
SELECT doc_id, lang, n_chars FROM documents JOIN q USING (lang)
WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)""")
def outliers_by_group(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return stats.iqr_outliers(documents, "n_chars", ["lang"])


@query("""SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean, min(l_extendedprice) AS min,
                 max(l_extendedprice) AS max, round(stddev_samp(l_extendedprice), 4) AS std
          FROM lineitem GROUP BY 1, 2""")
def group_stats(spark, sf_dir):
    figures = stats.group_stats(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return figures.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


# Exact figures next to the bounds that the estimates must keep.
_GROWN = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_missing, min({c})::DOUBLE AS least, max({c})::DOUBLE AS greatest,
        true AS distinct_is_near, true AS median_is_near FROM d"""
    for c in ("n_chars", "words")
)


@query(f"WITH d AS (SELECT n_chars, CASE WHEN doc_id % 7 > 0 THEN length(text) - length(replace(text, ' ', '')) END AS words FROM documents) {_GROWN}")
def profile_by_sketches(spark, sf_dir):
    """A profile kept up over parts that arrive one after another, one of them twice; estimates against exact figures."""
    documents = table(spark, sf_dir, "documents").select(
        "n_chars", (F.col("doc_id") % 4).alias("part"),
        F.when(F.col("doc_id") % 7 > 0, F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("words"),
    )
    path = scratch_path(spark, "sketches")
    for parts in ("part < 2", "part = 2", "part > 1"):
        sketches.keep(sketches.sketch(documents.where(parts), ["n_chars", "words"], "part"), path)
    found = sketches.profile(sketches.kept(spark, path), [0.5])
    exact = documents.agg(*[
        F.struct(
            F.count_distinct(c).alias("distinct"),
            F.percentile_approx(c, [0.45, 0.55], 10000).alias("middle"),
        ).alias(c) for c in ("n_chars", "words")
    ]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in ("n_chars", "words")])))
    median = F.col("quantiles")[0]
    return found.join(exact, "column").select(
        "column", "n_rows", "n_missing", "least", "greatest",
        # Five standard errors, and 5 % of the rows.
        (F.abs(F.col("n_distinct") - F.col("exact.distinct")) <= 5 * 0.016 * F.col("exact.distinct") + 1).alias("distinct_is_near"),
        median.between(F.col("exact.middle")[0], F.col("exact.middle")[1]).alias("median_is_near"),
    )
