"""Repair and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import clean, reshape
from furrow.workload.registry import GAPS, gaps, query, table


@query("""SELECT event_id AS "Key", user_id AS "Col_user_id", value AS "Col_value" FROM events
          WHERE event_type <> 'error'""")
def drop_blank_rows(spark, sf_dir):
    known = F.col("event_type") != "error"
    rows = table(spark, sf_dir, "events").select(
        *[F.when(known, F.col(c)).alias(c) for c in ("event_id", "user_id", "value")]
    )
    return clean.rename_by_position(clean.drop_blank_rows(rows), "Key", "Col_")


_CELLS = """cells AS (
  SELECT p_partkey, p_name,
         CASE p_size % 8 WHEN 0 THEN ' ' || p_size || chr(9) WHEN 1 THEN p_size || '.5e2' WHEN 2 THEN p_size || 'd'
                         WHEN 3 THEN '1,' || p_size WHEN 4 THEN 'NaN' WHEN 5 THEN '-' || p_size
                         WHEN 6 THEN p_brand ELSE '.' || p_size END AS cell
  FROM part)"""


def _cells(spark, sf_dir):
    size = F.col("p_size").cast("string")
    kinds = [
        F.concat(F.lit(" "), size, F.lit("\t")), F.concat(size, F.lit(".5e2")), F.concat(size, F.lit("d")),
        F.concat(F.lit("1,"), size), F.lit("NaN"), F.concat(F.lit("-"), size), F.col("p_brand"),
        F.concat(F.lit("."), size),
    ]
    cell = F.element_at(F.array(*kinds), F.col("p_size") % 8 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", cell.alias("cell"))


@query(f"""WITH {_CELLS}
SELECT p_partkey, CASE WHEN regexp_full_match(trim(cell, ' ' || chr(9)), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
                       THEN TRY_CAST(trim(cell, ' ' || chr(9)) AS DOUBLE) END AS number FROM cells""")
def coerce_numeric(spark, sf_dir):
    return clean.to_numeric(_cells(spark, sf_dir).select("p_partkey", F.col("cell").alias("number")), ["number"])


@query("""SELECT p_partkey, CASE WHEN p_size % 5 >= 3 THEN p_name END AS name FROM part""")
def blank_to_null(spark, sf_dir):
    words = F.array(F.lit("NA"), F.lit("n/a"), F.lit(""), F.col("p_name"), F.col("p_name"))
    name = F.element_at(words, F.col("p_size") % 5 + 1)
    return clean.blank_to_null(table(spark, sf_dir, "part").select("p_partkey", name.alias("name")))


@query(f"""WITH {GAPS}
SELECT event_id, user_id, last_value(v IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM gaps""")
def forward_fill(spark, sf_dir):
    filled = clean.forward_fill(gaps(spark, sf_dir).drop("kind"), ["v"], ["ts", "event_id"], ["user_id"])
    return filled.drop("ts")


@query(f"""WITH {GAPS}
SELECT event_id, ts, user_id, last_value(kind IGNORE NULLS) OVER w AS kind, last_value(v IGNORE NULLS) OVER w AS v
FROM gaps WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def forward_fill_all(spark, sf_dir):
    return clean.forward_fill(gaps(spark, sf_dir), "*", ["ts", "event_id"], ["user_id"])


@query(f"""WITH {GAPS}
SELECT event_id, last_value(v IGNORE NULLS) OVER (
  ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM gaps""")
def forward_fill_global(spark, sf_dir):
    events = gaps(spark, sf_dir).select("event_id", "v")
    return clean.forward_fill(events, ["v"], ["event_id"], width=500)


@query(f"WITH {GAPS} SELECT event_id, round(coalesce(v, avg(v) OVER ()), 4) AS v FROM gaps")
def mean_fill(spark, sf_dir):
    filled = clean.mean_fill(gaps(spark, sf_dir).select("event_id", "v"), ["v"])
    return filled.withColumn("v", F.round("v", 4))


@query(f"WITH {GAPS} SELECT DISTINCT user_id, kind FROM gaps")
def dedup_rows(spark, sf_dir):
    return clean.drop_duplicate_rows(gaps(spark, sf_dir).select("user_id", "kind"))


@query("""WITH texts AS (SELECT DISTINCT lang, text FROM documents)
SELECT lang, count(*) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM texts GROUP BY 1""")
def dedup_texts(spark, sf_dir):
    texts = clean.drop_duplicate_rows(table(spark, sf_dir, "documents").select("lang", "text"))
    return texts.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("text")).alias("n_chars")
    )


@query("SELECT p_partkey, p_name AS name FROM part WHERE p_size % 10 <> 0")
def trim_text(spark, sf_dir):
    padded = F.concat(F.lit("\t "), F.col("p_name"), F.lit("  \n"))
    name = F.when(F.col("p_size") % 10 == 0, F.lit(" \t ")).otherwise(padded)
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return clean.strip_text(clean.keep_with_text(rows, "name"))


_STATES = ("F", "O", "P")


@query(f"""WITH wide AS (
  SELECT year(o_orderdate) AS y, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT CAST(y.y AS INTEGER) AS year, s.s AS status, w.n FROM (SELECT DISTINCT y FROM wide) y
CROSS JOIN (VALUES {", ".join(f"('{s}')" for s in _STATES)}) s(s) LEFT JOIN wide w ON w.y = y.y AND w.s = s.s""")
def wide_to_long(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).pivot(
        "o_orderstatus", list(_STATES)
    ).count()
    wide = counts.select("year", *[F.col(s).alias(f"Status_{s}") for s in _STATES])
    return reshape.remove_text(reshape.melt(wide, ["year"], None, "status", "n"), "status", "Status_")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS "index" FROM orders""")
def row_index(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return reshape.row_index(orders, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n,
  row_number() OVER (ORDER BY o_orderpriority, o_orderstatus) - 1 AS position FROM orders GROUP BY 1, 2""")
def sort_rows(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n")
    )
    ordered = reshape.sort_rows(counts, ["o_orderpriority", "o_orderstatus"])
    # Ids ascend with the sorted partitions and inside them, so numbering by id gives each row its place in the sort.
    placed = ordered.withColumn("__id", F.monotonically_increasing_id())
    return reshape.row_index(placed, ["__id"], "position").drop("__id")


@query(r"""WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, l[pos] AS line, CAST(length(l[pos]) AS INTEGER) AS n_chars
FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS pos FROM lines)""")
def explode_nested(spark, sf_dir):
    lines = F.transform(
        F.split("text", "\n"), lambda line: F.struct(line.alias("line"), F.length(line).alias("n_chars"))
    )
    documents = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    return reshape.explode_records(documents, ["doc_id"], "lines")


_YEARS = range(1995, 2002)


@query(f"""WITH wide AS (
  SELECT l_suppkey, {", ".join(
      f"sum(CASE WHEN year(l_shipdate) = {y} THEN l_quantity END) AS q{y}, "
      f"sum(CASE WHEN year(l_shipdate) = {y} THEN CAST(round(l_extendedprice * 100) AS BIGINT) END) / 100.0::DOUBLE AS p{y}"
      for y in _YEARS)}
  FROM lineitem GROUP BY 1)
{" UNION ALL ".join(
    f"SELECT CAST(l_suppkey AS VARCHAR) AS crop, '{y}' AS year, round(q{y}, 2) AS quantity, round(p{y}, 2) AS price FROM wide"
    for y in _YEARS)}""")
def standardise_measures(spark, sf_dir):
    from furrow.sources.datasets import standardise_measures as standardise

    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    sums = (
        table(spark, sf_dir, "lineitem")
        .withColumn("year", F.year("l_shipdate"))
        .groupBy(F.col("l_suppkey").cast("string").alias("crop"))
        .pivot("year", list(_YEARS))
        .agg(F.sum("l_quantity").alias("q"), F.sum(cents).alias("p"))
    )
    wide = sums.select(
        "crop",
        *[F.col(f"{y}_q").alias(f"Quantity {y}") for y in _YEARS],
        *[(F.col(f"{y}_p") / F.lit(100.0)).alias(f"Price {y}") for y in _YEARS],
    )
    return standardise(wide)
