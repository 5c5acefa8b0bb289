"""Labels and display tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import labels as L
from furrow.functions import text as X
from furrow.operators import text_index, timeseries
from furrow.plans import assistant, dashboard
from furrow.session import scratch_path
from furrow.workload.registry import YEARLY, query, table, yearly

_NOW = "1998-06-01 06:00:00"


@query(f"""WITH d AS (SELECT o_orderkey, o_orderdate,
  CAST(ceil((epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '{_NOW}')) / 86400000.0::DOUBLE) AS BIGINT) AS days_left FROM orders)
SELECT o_orderkey AS title, 'order' AS description, strftime(o_orderdate, '%Y-%m-%d') AS deadline, days_left,
       CASE WHEN days_left > 0 THEN days_left || ' days left' ELSE 'Expired' END AS label,
       CASE WHEN days_left < 7 THEN 'urgent' ELSE 'normal' END AS urgency FROM d""")
def deadline_status(spark, sf_dir):
    schemes = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("title"),
        F.lit("order").alias("description"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("deadline"),
    )
    return dashboard.scheme_table(schemes, F.lit(_NOW).cast("timestamp"))


@query(f"""WITH {YEARLY}, c AS (SELECT priority, year, total,
  (total / nullif(lag(total) OVER (PARTITION BY priority ORDER BY year), 0) - 1) * 100 AS change FROM yearly)
SELECT priority, year, format('{{:,}}', CAST(round(total) AS BIGINT)) AS total,
       CASE WHEN change > 5 THEN 'up' ELSE 'down' END AS direction,
       CASE WHEN change > 0 THEN 'up' ELSE 'down' END AS growth, round(abs(change), 4) AS size,
       CAST(CAST(change AS DECIMAL(18, 2)) AS VARCHAR) || '%' AS shown
FROM c""")
def trend_labels(spark, sf_dir):
    change = timeseries.pct_change(yearly(spark, sf_dir), ["priority"], ["year"], "total", "change", bounded=True)
    trend = F.when(F.col("change") > 5, "up").when(F.col("change") < -5, "down")
    return change.select(
        "priority",
        "year",
        L.thousands(F.round("total").cast("long")).alias("total"),
        L.trend_direction(trend).alias("direction"),
        L.growth_direction(F.col("change")).alias("growth"),
        F.round(F.abs("change"), 4).alias("size"),
        L.percent_text(F.col("change").cast("decimal(18,2)")).alias("shown"),
    )


@query("""SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'sun' WHEN 'LARGE' THEN 'cloud' WHEN 'ECONOMY' THEN 'sun'
                            ELSE 'drop' END AS icon FROM part""")
def condition_class(spark, sf_dir):
    kinds = {"PROMO": "Sunny", "LARGE": "Partly Cloudy", "SMALL": "Rainy", "MEDIUM": "sunny", "ECONOMY": "Sunny, later Cloudy"}
    condition = F.lit(None).cast("string")
    for kind, words in kinds.items():
        condition = F.when(F.col("p_type") == kind, words).otherwise(condition)
    return table(spark, sf_dir, "part").select("p_partkey", L.condition_class(condition).alias("icon"))


_RULES = [("fastener", ["bolt", "ring"]), ("bar", ["rod", "plate"]), ("colour", ["red", "blue"]), ("heat", ["hot", "old"])]


@query("""SELECT p_partkey, CASE WHEN contains(n, 'bolt') OR contains(n, 'ring') THEN 'fastener'
  WHEN contains(n, 'rod') OR contains(n, 'plate') THEN 'bar' WHEN contains(n, 'red') OR contains(n, 'blue') THEN 'colour'
  WHEN contains(n, 'hot') OR contains(n, 'old') THEN 'heat' ELSE 'other' END AS label
FROM (SELECT p_partkey, lower(p_name) AS n FROM part)""")
def keyword_labels(spark, sf_dir):
    name = F.upper("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", L.keyword_label(name, _RULES, "other").alias("label"))


_INTENTS = """intents AS (
  SELECT conv_id, turn, CASE WHEN contains(t, 'weather') THEN 'weather'
    WHEN contains(t, 'market') OR contains(t, 'price') THEN 'market'
    WHEN contains(t, 'crop') OR contains(t, 'advice') THEN 'crop'
    WHEN contains(t, 'government') OR contains(t, 'scheme') THEN 'scheme'
    WHEN contains(t, 'hello') OR contains(t, 'hi') THEN 'greeting' ELSE 'fallback' END AS intent
  FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user' AND length(trim(text)) > 0))"""


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'")


@query(f"WITH {_INTENTS} SELECT conv_id, turn, intent FROM intents")
def assistant_intents(spark, sf_dir):
    return assistant.label_messages(_questions(spark, sf_dir), "text").select("conv_id", "turn", "intent")


@query(f"WITH {_INTENTS} SELECT intent, count(*) AS n_messages FROM intents GROUP BY 1")
def assistant_counts(spark, sf_dir):
    return assistant.count_intents(_questions(spark, sf_dir), "text")


@query("""SELECT CASE event_type WHEN 'click' THEN 'You' WHEN 'error' THEN 'Error' ELSE 'Helper' END AS speaker,
                 strftime(ts, '%H:%M') AS "time", props AS message FROM events""")
def message_display(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "user").otherwise(F.col("event_type"))
    log = table(spark, sf_dir, "events").select(
        kind.alias("type"), F.col("props").alias("message"), F.col("ts").alias("timestamp")
    )
    return assistant.display(log, "Helper")


@query("""SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')""")
def text_search(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.where(X.search([F.col("text"), F.col("source")], "License")).select("doc_id")


# A part of a word, whole words, repeated spaces, the end and the start of words, and text that is nowhere.
_NEEDLES = ("License", " of the ", "e. th", "ing the a", "the  ", "no such text")


@query(" UNION ALL ".join(f"""SELECT '{n}' AS query, doc_id FROM documents
  WHERE contains(lower(text), lower('{n}')) OR contains(lower(source), lower('{n}'))""" for n in _NEEDLES))
def indexed_search(spark, sf_dir):
    path = scratch_path(spark, "words")
    text_index.build(table(spark, sf_dir, "documents"), "doc_id", ["text", "source"], path)
    index = text_index.opened(spark, path)
    found = [text_index.find(index, n).select(F.lit(n).alias("query"), F.col("id").alias("doc_id")) for n in _NEEDLES]
    return reduce(DataFrame.unionByName, found)


@query("""WITH d AS (
  SELECT p_name AS name, sum(l_quantity) AS demand,
         round((sum(l_quantity) FILTER (year(l_shipdate) = 2000)
                / nullif(sum(l_quantity) FILTER (year(l_shipdate) = 1999), 0) - 1) * 100, 4) AS growth
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT name, demand, CASE WHEN growth > 0 THEN 'up' ELSE 'down' END AS direction, abs(growth) AS growth
FROM d ORDER BY demand DESC, name LIMIT 5""")
def high_demand(spark, sf_dir):
    year = F.year("l_shipdate")
    per_part = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("all"),
        F.sum(F.when(year == 2000, F.col("l_quantity"))).alias("now"),
        F.sum(F.when(year == 1999, F.col("l_quantity"))).alias("before"),
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    demand = per_part.join(parts, "l_partkey").groupBy("name").agg(
        F.sum("all").alias("demand"),
        F.round((F.try_divide(F.sum("now"), F.sum("before")) - 1) * 100, 4).alias("growth"),
    )
    return dashboard.demand_table(demand, 5)


@query("""SELECT p_name AS crop, p_brand AS mandi, format('{:,}', p_partkey * 10) AS min_price,
                 format('{:,}', p_partkey * 10 + p_size) AS max_price, CASE WHEN p_size > 25 THEN 'up' ELSE 'down' END AS direction,
                 p_size || '%' AS "change" FROM part""")
def price_table(spark, sf_dir):
    trend = F.when(F.col("p_size") > 25, "up").when(F.col("p_size") > 10, "down")
    prices = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("crop"),
        F.col("p_brand").alias("mandi"),
        (F.col("p_partkey") * 10).alias("minPrice"),
        (F.col("p_partkey") * 10 + F.col("p_size")).alias("maxPrice"),
        trend.alias("trend"),
        F.col("p_size").alias("change"),
    )
    return dashboard.price_table(prices)
