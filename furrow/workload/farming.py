"""Scores, rankings, joins, checks and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions.values import SEASONS, WATER_LEVELS
from furrow.operators import farming, intervals, keys, recommend as R
from furrow.operators.timeseries import start_year
from furrow.plans import unify
from furrow.sources.datasets import parse_varieties
from furrow.workload.registry import query, table

# Nutrient percentages of an event, some of them missing.
_SOIL = """soil AS (
  SELECT event_id, CASE WHEN event_type <> 'error' THEN value / 5 END AS zn,
         CASE WHEN event_type NOT IN ('error', 'click') THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS fe,
         CASE WHEN event_type <> 'error' OR user_id % 2 = 0 THEN (minute(ts) * 1.5)::DOUBLE END AS s
  FROM events),
scored AS (
  SELECT *, (zn IS NOT NULL)::INT + (fe IS NOT NULL)::INT + (s IS NOT NULL)::INT AS n_known FROM soil),
health AS (
  SELECT *, (coalesce(zn, 0) + coalesce(fe, 0) + coalesce(s, 0)) / nullif(n_known, 0) AS soil_score FROM scored)"""
_NUTRIENTS = ("zn", "fe", "s")


def _soil(spark, sf_dir):
    kind = F.col("event_type")
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind != "error", F.col("value") / 5).alias("zn"),
        F.when(~kind.isin("error", "click"), F.get_json_object("props", "$.k").cast("double")).alias("fe"),
        F.when((kind != "error") | (F.col("user_id") % 2 == 0), F.minute("ts") * F.lit(1.5)).alias("s"),
    )
    return farming.soil_score(events, _NUTRIENTS, 30.0)


@query(f"""WITH {_SOIL} SELECT event_id, n_known, round(soil_score, 4) AS soil_score,
  concat_ws(',', CASE WHEN zn < 30 THEN 'zn' END, CASE WHEN fe < 30 THEN 'fe' END, CASE WHEN s < 30 THEN 's' END) AS deficient
FROM health""")
def soil_score(spark, sf_dir):
    return _soil(spark, sf_dir).select(
        "event_id", "n_known", F.round("soil_score", 4).alias("soil_score"),
        F.array_join("deficient", ",").alias("deficient"),
    )


@query(f"""WITH {_SOIL}, ranked AS (
  SELECT event_id, round(percent_rank() OVER (ORDER BY soil_score), 6) AS percentile FROM health WHERE soil_score IS NOT NULL)
SELECT event_id, percentile FROM health LEFT JOIN ranked USING (event_id)""")
def soil_rank(spark, sf_dir):
    ranked = farming.soil_rank(_soil(spark, sf_dir).select("event_id", "soil_score"))
    return ranked.select("event_id", F.round("percentile", 6).alias("percentile"))


# Yield and two costs per crop and region, in whole cents.
_COSTS = """costs AS (
  SELECT p_type AS crop, n_name AS state, r_name AS region, sum(l_quantity) AS yield_quintal,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS cost_a2fl,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 + l_tax) * 100) AS BIGINT)) AS DOUBLE) / 100 AS cost_c2
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)"""


def _costs(spark, sf_dir):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    taxed = cents * F.round((1 + F.col("l_tax")) * 100).cast("long")
    # Adding up per part and supplier first keeps a frequent part out of the joins.
    sums = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.sum("l_quantity").alias("q"), F.sum(cents).alias("a"), F.sum(taxed).alias("c")
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")
    )
    regions = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    placed = (
        sums.join(parts, "l_partkey")
        .join(suppliers, "l_suppkey")
        .join(table(spark, sf_dir, "nation"), "n_nationkey")
        .join(regions, "n_regionkey")
    )
    return placed.groupBy(
        F.col("p_type").alias("crop"), F.col("n_name").alias("state"), F.col("r_name").alias("region")
    ).agg(
        F.sum("q").alias("yield_quintal"),
        F.sum("a").cast("double").alias("cost_a2fl"),
        (F.sum("c").cast("double") / 100).alias("cost_c2"),
    )


@query(f"""WITH {_COSTS} SELECT crop, state, yield_quintal,
  CAST(dense_rank() OVER (PARTITION BY crop ORDER BY yield_quintal DESC) AS INTEGER) AS region_rank FROM costs""")
def regional_ranking(spark, sf_dir):
    # One row per state: the list of states bounds a group.
    ranked = farming.regional_ranking(_costs(spark, sf_dir), "crop", "yield_quintal", bounded=True)
    return ranked.select("crop", "state", "yield_quintal", "region_rank")


@query(f"""WITH {_COSTS}, r AS (
  SELECT crop, state, yield_quintal, row_number() OVER (PARTITION BY crop ORDER BY yield_quintal DESC, state) AS hi,
         row_number() OVER (PARTITION BY crop ORDER BY yield_quintal, state) AS lo FROM costs)
SELECT crop, state, yield_quintal, CAST(hi AS INTEGER) AS place, 'high' AS side FROM r WHERE hi <= 3
UNION ALL SELECT crop, state, yield_quintal, CAST(lo AS INTEGER), 'low' FROM r WHERE lo <= 3""")
def best_and_worst_regions(spark, sf_dir):
    costs = _costs(spark, sf_dir).select("crop", "state", "yield_quintal")
    return farming.best_and_worst(costs, "crop", "state", "yield_quintal", 3)


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice, CAST(place AS INTEGER) AS place FROM o WHERE place <= 2""")
def best_per_group(spark, sf_dir):
    from furrow.operators.ranking import best_per_group as best

    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return best(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)


@query(f"""WITH {_COSTS}, e AS (SELECT crop, state, yield_quintal / nullif(cost_a2fl, 0) * 1000 AS a,
                                       yield_quintal / nullif(cost_c2, 0) * 1000 AS c FROM costs)
SELECT crop, state, round(a, 8) AS efficiency_a2fl, round(c, 8) AS efficiency_c2,
       CAST(dense_rank() OVER (PARTITION BY crop ORDER BY a DESC) AS INTEGER) AS efficiency_rank FROM e""")
def yield_efficiency(spark, sf_dir):
    ranked = farming.yield_efficiency(_costs(spark, sf_dir), bounded=True)
    ratios = ("efficiency_a2fl", "efficiency_c2")
    return ranked.select("crop", "state", *[F.round(c, 8).alias(c) for c in ratios], "efficiency_rank")


# Varieties: duration and zone text of each part.
_ZONES = {"AFRICA": (2, 0), "AMERICA": (3, 0), "ASIA": (5, 0), "EUROPE": (7, 0), "MIDDLE EAST": (4, 1)}
_VARIETIES = f"""varieties AS (
  SELECT p_type AS crop, p_partkey, CASE p_size % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN NULL ELSE p_size END AS min_days,
         CASE p_size % 4 WHEN 0 THEN p_size + 5 WHEN 1 THEN p_size WHEN 2 THEN NULL ELSE p_size + 10 END AS max_days,
         list_filter([{", ".join(f"CASE WHEN p_partkey % {m} = {r} THEN '{z}' END" for z, (m, r) in _ZONES.items())}],
                     lambda z: z IS NOT NULL) AS states
  FROM part),
by_state AS (
  SELECT crop, state, count(*) AS n_varieties, min(min_days) AS min_days, max(max_days) AS max_days
  FROM (SELECT crop, min_days, max_days, unnest(states) AS state FROM varieties) GROUP BY 1, 2)"""


def _varieties(spark, sf_dir):
    size = F.col("p_size")
    duration = (
        F.when(size % 4 == 0, F.concat(size, F.lit("-"), size + 5))
        .when(size % 4 == 1, size.cast("string"))
        .when(size % 4 == 2, F.lit("NA"))
        .otherwise(F.concat(size, F.lit(" irrigated & "), size + 10, F.lit(" rainfed")))
    )
    names = [F.when(F.col("p_partkey") % m == r, F.lit(z)) for z, (m, r) in _ZONES.items()]
    zone = F.concat(F.concat_ws(", ", *names), F.lit(" under irrigated conditions."))
    texts = table(spark, sf_dir, "part").select(
        F.col("p_type").alias("crop"), "p_partkey", duration.alias("duration"), zone.alias("zone")
    )
    return parse_varieties(texts, patterns={z: z for z in _ZONES})


@query(f"""WITH {_VARIETIES} SELECT p_partkey, min_days, max_days, array_to_string(states, ',') AS states FROM varieties""")
def variety_texts(spark, sf_dir):
    return _varieties(spark, sf_dir).select("p_partkey", "min_days", "max_days", F.array_join("states", ",").alias("states"))


@query(f"WITH {_VARIETIES} SELECT * FROM by_state")
def variety_zones(spark, sf_dir):
    return farming.variety_by_state(_varieties(spark, sf_dir))


_REGIONAL = f"""{_COSTS}, regional AS (
  SELECT crop, region AS state, sum(yield_quintal) AS yield_quintal FROM costs GROUP BY 1, 2)"""


def _regional(spark, sf_dir):
    return _costs(spark, sf_dir).groupBy("crop", F.col("region").alias("state")).agg(
        F.sum("yield_quintal").alias("yield_quintal")
    )


@query(f"""WITH {_REGIONAL}, {_VARIETIES}
SELECT lower(crop) AS crop_key, state, crop, yield_quintal, n_varieties, min_days, max_days
FROM regional LEFT JOIN by_state USING (crop, state)""")
def yield_geography(spark, sf_dir):
    return farming.yield_by_geography(_regional(spark, sf_dir), _varieties(spark, sf_dir))


# Part names in another spelling on each side; bolts are screws on the right, rods are missing.
_NAMES = """sales AS (
  SELECT CASE WHEN p_name LIKE '% bolt' THEN replace(p_name, 'bolt', 'screw') ELSE p_name END AS crop_key,
         count(*) AS n_parts, max(p_retailprice) AS top_price
  FROM part WHERE p_name NOT LIKE '% rod' GROUP BY 1),
lots AS (SELECT p_partkey, CASE WHEN p_name LIKE '% bolt' THEN replace(p_name, 'bolt', 'screw') ELSE p_name END AS crop_key FROM part)"""


def _sides(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    left = part.select("p_partkey", F.concat(F.lit("\t"), F.upper(F.replace("p_name", F.lit(" "), F.lit("   ")))).alias("crop"))
    right = (
        part.where("p_name NOT LIKE '% rod'")
        .groupBy(F.initcap(F.replace("p_name", F.lit("bolt"), F.lit("screw"))).alias("crop"))
        .agg(F.count(F.lit(1)).alias("n_parts"), F.max("p_retailprice").alias("top_price"))
    )
    bolts = part.where("p_name LIKE '% bolt'").select(
        F.col("p_name").alias("alias"), F.replace("p_name", F.lit("bolt"), F.lit("Screw")).alias("key")
    ).distinct()
    return left, right, bolts


@query(f"WITH {_NAMES} SELECT p_partkey, crop_key, n_parts, top_price FROM lots LEFT JOIN sales USING (crop_key)")
def crop_performance(spark, sf_dir):
    left, right, aliases = _sides(spark, sf_dir)
    return farming.crop_performance(left, right, aliases=aliases).drop("crop")


@query(f"""WITH {_NAMES} SELECT crop_key, count(*) AS n_rows FROM lots
           WHERE crop_key NOT IN (SELECT crop_key FROM sales) GROUP BY 1""")
def unmatched_keys(spark, sf_dir):
    left, right, aliases = _sides(spark, sf_dir)
    return keys.unmatched_keys(
        keys.with_key(left, "crop", aliases=aliases), keys.with_key(right, "crop", aliases=aliases), ["crop_key"]
    )


# Customers as districts: one in fifty has a name that stands for two states.
@query(f"""WITH {_COSTS}, soil AS (
  SELECT n_name AS state, CASE WHEN c_acctbal >= 0 THEN c_acctbal / 100 END AS zn, (c_custkey * 7 % 101)::DOUBLE AS fe
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 50 <> 0),
health AS (
  SELECT state, round(avg((coalesce(zn, 0) + fe) / ((zn IS NOT NULL)::INT + 1)), 8) AS soil_score, count(*) AS n_districts
  FROM soil GROUP BY 1)
SELECT state, crop, lower(crop) AS crop_key, yield_quintal, soil_score, n_districts
FROM costs LEFT JOIN health USING (state)""")
def soil_crop_join(spark, sf_dir):
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    none = F.lit(None).cast("double")
    soil = customer.select(
        F.concat(F.lit(" "), F.upper("c_name")).alias("district"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 100).alias("zn"),
        (F.col("c_custkey") * 7 % 101).cast("double").alias("fe"),
        *[none.alias(c) for c in ("cu", "mn", "b", "s")],
    )
    key = F.col("c_nationkey")
    homes = F.when(F.col("c_custkey") % 50 == 0, F.array(key, (key + 1) % 25)).otherwise(F.array(key))
    districts = (
        customer.select("c_name", F.explode(homes).alias("n_nationkey"))
        .join(nation, "n_nationkey")
        .select(F.col("c_name").alias("district"), F.col("n_name").alias("state"))
    )
    costs = _costs(spark, sf_dir).select("crop", "state", "yield_quintal")
    return farming.soil_by_crop(soil, districts, costs).withColumn("soil_score", F.round("soil_score", 8))


@query(f"""WITH {_REGIONAL}, {_VARIETIES},
shipped AS (
  SELECT p_type AS crop, year(l_shipdate) AS y, sum(l_quantity) AS q, count(*) AS n, max(l_quantity) AS top
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
means AS (SELECT crop, avg(q) AS mean_index, avg(n) AS area_index, avg(top) AS yield_index FROM shipped GROUP BY 1)
SELECT lower(crop) AS crop_key, state, crop, yield_quintal, round(mean_index, 4) AS mean_index, round(mean_index, 4) AS production_index,
       round(area_index, 4) AS area_index, round(yield_index, 4) AS yield_index, n_varieties, min_days, max_days
FROM regional LEFT JOIN means USING (crop) LEFT JOIN by_state USING (crop, state)""")
def unified_table(spark, sf_dir):
    per_part = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.year("l_shipdate").alias("y")).agg(
        F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("top")
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    shipped = per_part.join(parts, "l_partkey").groupBy("p_type", "y").agg(
        F.sum("q").alias("q"), F.sum("n").alias("n"), F.max("top").alias("top")
    )
    index = shipped.select(F.concat("p_type", F.lit(" ")).alias("Crop"), F.col("q").alias("Index_Value"))
    measures = shipped.select(
        F.lower("p_type").alias("crop"), F.col("q").alias("production"), F.col("n").alias("area"), F.col("top").alias("yield")
    )
    table_ = unify.unified(_regional(spark, sf_dir), index, measures, _varieties(spark, sf_dir))
    rounded = ("mean_index", "production_index", "area_index", "yield_index")
    return table_.withColumns({c: F.round(c, 4) for c in rounded})


@query("""WITH j AS (SELECT *, l_extendedprice / l_quantity AS unit FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, 'unit_price_at_most_twice_retail' AS "check", unit AS actual, 2 * p_retailprice AS expected
FROM j WHERE unit - 2 * p_retailprice > 100
UNION ALL
SELECT l_orderkey, l_linenumber, 'discount_is_tax', l_discount, l_tax FROM j WHERE abs(l_discount - l_tax) > 0.075""")
def consistency_checks(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = table(spark, sf_dir, "lineitem").join(parts, "l_partkey")
    checks = [
        farming.Check("unit_price_at_most_twice_retail", F.col("l_extendedprice") / F.col("l_quantity"),
                      2 * F.col("p_retailprice"), 100.0, upper_bound=True),
        farming.Check("discount_is_tax", F.col("l_discount"), F.col("l_tax"), 0.075),
    ]
    return farming.violations(rows, checks, ["l_orderkey", "l_linenumber"])


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity AS production, l_discount * 100 AS area,
                    l_quantity / nullif(l_discount * 100, 0) * 100 + l_tax * 6 AS yield FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS cost_c2, l_quantity AS yield_quintal,
             l_extendedprice / l_quantity + l_tax / 7 AS cost_per_quintal FROM lineitem)
SELECT l_orderkey, l_linenumber, 'yield_is_production_over_area' AS "check", round(yield, 8) AS actual,
       round(production / nullif(area, 0) * 100, 8) AS expected FROM m WHERE abs(yield - production / nullif(area, 0) * 100) > 0.2
UNION ALL
SELECT l_orderkey, l_linenumber, 'cost_per_quintal_at_most_cost_over_yield', round(cost_per_quintal, 8), round(cost_c2 / yield_quintal, 8)
FROM c WHERE cost_per_quintal - cost_c2 / yield_quintal > 0.005""")
def named_checks(spark, sf_dir):
    """Order lines as areas and costs: the tax is by how much a figure is off."""
    rows = table(spark, sf_dir, "lineitem")
    area = F.col("l_discount") * 100
    measures = rows.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("production"), area.alias("area"),
        (F.try_divide(F.col("l_quantity"), area) * 100 + F.col("l_tax") * 6).alias("yield"),
    )
    costs = rows.select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("cost_c2"), F.col("l_quantity").alias("yield_quintal"),
        (F.col("l_extendedprice") / F.col("l_quantity") + F.col("l_tax") / 7).alias("cost_per_quintal"),
    )
    keys_ = ["l_orderkey", "l_linenumber"]
    found = farming.violations(measures, farming.measure_checks(), keys_).unionByName(
        farming.violations(costs, farming.cost_checks(), keys_)
    )
    return found.withColumns({c: F.round(c, 8) for c in ("actual", "expected")})


@query("""WITH orders_ AS (SELECT o_orderkey, CAST(year(o_orderdate - INTERVAL 6 MONTH) AS INTEGER) AS season, o_totalprice / 1000 AS total FROM orders),
lines AS (SELECT l_orderkey, CAST(year(l_shipdate - INTERVAL 6 MONTH) AS INTEGER) AS season, sum(l_extendedprice) / 1000 AS value, sum(l_quantity) * 2.0::DOUBLE AS most
          FROM lineitem GROUP BY 1, 2),
j AS (SELECT * FROM orders_ o JOIN lines l ON o_orderkey = l_orderkey AND o.season = l.season)
SELECT o_orderkey, 'total_is_sum_of_lines' AS "check", round(total, 6) AS actual, round(value, 6) AS expected FROM j WHERE abs(total - value) > 100
UNION ALL SELECT o_orderkey, 'total_at_most_two_per_unit', round(total, 6), round(most, 6) FROM j WHERE total - most > 1""")
def checks_across_tables(spark, sf_dir):
    """Orders, in thousands and with the label of their season, against the lines shipped in that season, with plain prices and dates."""
    year = farming.crop_year(F.col("o_orderdate"))
    label = F.concat(year, F.lit("-"), F.lpad((year + 1) % 100, 2, "0"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", label.alias("season"), (F.col("o_totalprice") / 1000).alias("total"))
    checks = [
        farming.CrossCheck("total_is_sum_of_lines", F.col("total"), F.sum("l_extendedprice"), 100.0, factor=0.001),
        farming.CrossCheck("total_at_most_two_per_unit", F.col("total"), F.sum("l_quantity"), 1.0, factor=2.0, upper_bound=True),
    ]
    found = farming.cross_violations(
        orders, table(spark, sf_dir, "lineitem"), {"o_orderkey": "l_orderkey"},
        (start_year(F.col("season")), farming.crop_year(F.col("l_shipdate"))), checks, ["o_orderkey"],
    )
    return found.withColumns({c: F.round(c, 6) for c in ("actual", "expected")})


_WATERS = ", ".join(f"('{w}', {i})" for i, w in enumerate(WATER_LEVELS))


@query(f"""WITH crops AS (
  SELECT p_name || ' ' || p_partkey AS name, CASE p_type WHEN 'PROMO' THEN 'both' WHEN 'LARGE' THEN 'rabi' WHEN 'SMALL' THEN 'zaid'
           ELSE 'kharif' END AS season, p_size % 3 AS water,
         CASE WHEN p_size * 1500 <= 20000 THEN 0 WHEN p_size * 1500 <= 50000 THEN 1 ELSE 2 END AS investment,
         floor(p_retailprice) * 50 AS low, floor(p_retailprice) * 50 + p_size * 100 AS high,
         CASE p_partkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS weight,
         CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'north' WHEN 2 THEN 'south' ELSE 'east' END AS region
  FROM part),
cases AS (
  SELECT * FROM (VALUES {", ".join(f"('{s}')" for s in SEASONS)}) s(season), (VALUES {_WATERS}) w(water, water_no),
                (VALUES {_WATERS}) i(investment, investment_no),
                (VALUES ('north'), ('south'), ('west')) r(region)),
ranked AS (
  SELECT k.season, k.water, k.investment, k.region, c.name, c.low, c.high, (c.low + c.high) / 2 * c.weight AS score,
         row_number() OVER (PARTITION BY k.season, k.water, k.investment, k.region ORDER BY (c.low + c.high) / 2 * c.weight DESC, c.name) AS place
  FROM cases k JOIN crops c ON (c.season = 'both' OR c.season = k.season) AND c.water <= k.water_no AND c.investment <= k.investment_no
    AND (c.region IS NULL OR c.region = k.region)),
requests AS (
  SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'kharif' WHEN 1 THEN 'rabi' ELSE 'zaid' END AS season,
         CASE c_nationkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS water,
         CASE WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 5000 THEN 'medium' ELSE 'high' END AS investment,
         CASE c_nationkey % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE 'west' END AS region
  FROM customer)
SELECT c_custkey, name, low AS profit_low, high AS profit_high, round(score, 4) AS score, CAST(place AS INTEGER) AS place
FROM requests JOIN ranked USING (season, water, investment, region) WHERE place <= 3""")
def recommend(spark, sf_dir):
    low = F.floor("p_retailprice") * 50
    profit = F.concat(
        F.lit("₹"), F.format_number(low, 0), F.lit(" - ₹"), F.format_number(low + F.col("p_size") * 100, 0)
    )
    season = F.when(F.col("p_type") == "PROMO", "Both").when(F.col("p_type") == "LARGE", "Rabi").when(
        F.col("p_type") == "SMALL", "Zaid").otherwise("Kharif")
    pick = lambda values, number: F.element_at(F.array(*[F.lit(v) for v in values]), (number % 3 + 1).cast("int"))
    crops = table(spark, sf_dir, "part").select(
        F.concat("p_name", F.lit(" "), "p_partkey").alias("name"),
        profit.alias("profit"),
        season.alias("season"),
        pick(("Low", "Medium", "High"), F.col("p_size")).alias("water"),
        pick(("Low", "Medium", "High"), F.col("p_partkey")).alias("risk"),
        (F.col("p_size") * 1500).alias("cost"),
        F.element_at(F.array(F.lit(None).cast("string"), F.lit("North"), F.lit("South"), F.lit("East")), (F.col("p_size") % 4 + 1).cast("int")).alias("region"),
    )
    balance = F.col("c_acctbal")
    requests = table(spark, sf_dir, "customer").select(
        "c_custkey",
        pick(SEASONS, F.col("c_custkey")).alias("season"),
        pick(WATER_LEVELS, F.col("c_nationkey")).alias("waterAvailability"),
        F.when(balance < 1000, "low").when(balance < 5000, "medium").otherwise("high").alias("investmentCapacity"),
        pick(("north", "south", "west"), F.col("c_nationkey")).alias("region"),
    )
    answers = R.recommend(requests, crops, 3, "cost")
    return answers.select("c_custkey", "name", "profit_low", "profit_high", F.round("score", 4).alias("score"), "place")


_NEAR = """WITH r AS (SELECT DISTINCT p_name || ' ' || lower(p_type) || ' ' || right(p_brand, 2) AS name FROM part),
l AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN left(name, 2) || substr(name, 4) WHEN 1 THEN 'x' || name ELSE left(name, 4) || 'oo' || substr(name, 6) END AS name
      FROM (SELECT p_partkey, p_name || ' ' || lower(p_type) || ' ' || right(p_brand, 2) AS name FROM part) WHERE p_partkey % 4 = 0)
SELECT l.name, r.name AS match, levenshtein(l.name, r.name) AS distance FROM l JOIN r ON levenshtein(l.name, r.name) <= 2
WHERE NOT EXISTS (SELECT 1 FROM r AS same WHERE same.name = l.name)"""


@query(_NEAR)
def near_keys(spark, sf_dir):
    """Partners for misspelt names that have none."""
    name = F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" "), F.right(F.col("p_brand"), F.lit(2)))
    parts = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    tail = F.substr(F.col("name"), F.lit(4))
    misspelt = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.left(F.col("name"), F.lit(2)), tail))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("x"), "name"))
        .otherwise(F.concat(F.left(F.col("name"), F.lit(4)), F.lit("oo"), F.substr(F.col("name"), F.lit(6))))
    )
    asked = parts.where(F.col("p_partkey") % 4 == 0).select(misspelt.alias("name"))
    return keys.near_keys(keys.unmatched_keys(asked, parts, ["name"]), parts, "name", 2)


@query("""WITH crops AS (
  SELECT p_name || ' ' || p_partkey AS name, p_partkey % 3 AS season, CASE WHEN p_size % 10 > 0 THEN p_size * 20 END AS cost_low,
         CASE WHEN p_size % 7 > 0 THEN p_size * 20 + p_retailprice END AS cost_high,
         floor(p_retailprice) * 50 AS low, floor(p_retailprice) * 50 + p_size * 100 AS high FROM part),
asked AS (SELECT doc_id, doc_id % 3 AS season, n_chars / 4.0::DOUBLE AS budget, CASE WHEN doc_id % 4 > 0 THEN doc_id % 100 * 1100 END AS least FROM documents),
cases AS (SELECT DISTINCT season, budget FROM asked),
placed AS (
  SELECT s.*, name, low, high, row_number() OVER (PARTITION BY s.season, budget ORDER BY low DESC, name) AS place
  FROM cases s JOIN crops c ON s.season = c.season AND round(coalesce(cost_low, 0) * 100) <= round(budget * 100)
    AND (cost_high IS NULL OR round(budget * 100) <= round(cost_high * 100))
  QUALIFY place <= 3)
SELECT doc_id, name, low AS profit_low, high AS profit_high, CAST(place AS INTEGER) AS place
FROM asked a LEFT JOIN placed p ON a.season = p.season AND a.budget = p.budget AND (least IS NULL OR low >= least)""")
def recommend_by_amount(spark, sf_dir):
    """Documents as requests with an amount to spend and a least profit, parts as crops with cost limits, some of them open."""
    low, size = F.floor("p_retailprice") * 50, F.col("p_size")
    crops = table(spark, sf_dir, "part").select(
        F.concat("p_name", F.lit(" "), "p_partkey").alias("name"),
        (F.col("p_partkey") % 3).alias("season"),
        F.concat(F.lit("₹"), F.format_number(low, 0), F.lit(" - ₹"), F.format_number(low + size * 100, 0)).alias("profit"),
        F.when(size % 10 > 0, size * 20).alias("cost_low"),
        F.when(size % 7 > 0, size * 20 + F.col("p_retailprice")).alias("cost_high"),
    )
    asked = table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("doc_id") % 3).alias("season"), (F.col("n_chars") / 4).alias("budget"),
        F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 100 * 1100).alias("least"),
    )
    found = R.within_budget(asked, crops, 3, least="least", same=["season"])
    return found.select("doc_id", "name", "profit_low", "profit_high", "place")


@query("""SELECT c_custkey, count(*) AS n_parts, min(p_retailprice) AS cheapest FROM customer
JOIN part ON 900 + c_custkey % 1200 BETWEEN p_retailprice AND p_retailprice + p_size / 4.0::DOUBLE GROUP BY 1""")
def amounts_in_ranges(spark, sf_dir):
    """For each customer's amount the parts whose range of prices holds it."""
    parts = table(spark, sf_dir, "part").select("p_retailprice", (F.col("p_retailprice") + F.col("p_size") / 4).alias("upto"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", (900 + F.col("c_custkey") % 1200).alias("amount"))
    figures = {"n_parts": ("count", F.lit(1)), "cheapest": ("min", F.col("p_retailprice"))}
    met = intervals.containing(asked, parts, "amount", "p_retailprice", "upto", figures=figures)
    return met.groupBy("c_custkey").agg(F.sum("n_parts").alias("n_parts"), F.min("cheapest").alias("cheapest"))


@query(f"""WITH d AS (
  SELECT doc_id, doc_id % 6 AS kind,
         list_filter([{", ".join(f"CASE WHEN doc_id % {m} = {r} THEN '{z}' END" for z, (m, r) in _ZONES.items())}], lambda z: z IS NOT NULL) AS named
  FROM documents)
SELECT doc_id, array_to_string(CASE kind WHEN 0 THEN list_filter(named, lambda z: z NOT IN ('ASIA', 'EUROPE'))
         WHEN 3 THEN list_sort(list_distinct(list_append(list_filter(named, lambda z: z <> 'AMERICA'), 'ASIA'))) ELSE named END, ',') AS states,
       coalesce(CASE WHEN kind = 1 THEN named[-1] || ':hills,' || named[-1] || ':ASIA valleys'
         WHEN kind = 3 AND named[-1] <> 'AMERICA' THEN named[-1] || ':AFRICA (dry)' END, '') AS excepted
FROM d""")
def variety_exceptions(spark, sf_dir):
    """Zones with brackets, in which exceptions name whole zones, parts of zones, or nothing."""
    names = [F.when(F.col("doc_id") % m == r, F.lit(z)) for z, (m, r) in _ZONES.items()]
    kind = F.col("doc_id") % 6
    tail = (
        F.when(kind == 0, " (except ASIA and EUROPE) in late rains")
        .when(kind == 1, " (Except hills, ASIA valleys).")
        .when(kind == 2, " (irrigated)")
        .when(kind == 3, " [excluding AFRICA (dry), AMERICA], and ASIA")
        .otherwise("")
    )
    texts = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("10-20").alias("duration"), F.concat(F.concat_ws(", ", *names), tail).alias("zone")
    )
    found = parse_varieties(texts, patterns={z: z for z in _ZONES})
    excepted = F.transform("excepted", lambda e: F.concat(e["state"], F.lit(":"), e["part"]))
    return found.select("doc_id", F.array_join("states", ",").alias("states"), F.array_join(excepted, ",").alias("excepted"))
