"""Farming scores, joins and recommendations on small rows, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from furrow.operators import farming, keys, models, recommend
from furrow.operators.timeseries import start_year
from furrow.plans import unify
from furrow.sources import datasets
from tests.data import COST_ROWS, SOIL_ROWS, VARIETY_ROWS

COSTS = "crop string, state string, cost_a2fl double, cost_c2 double, cost_per_quintal double, yield_quintal double"


@pytest.fixture(scope="module")
def costs(spark):
    return spark.createDataFrame(COST_ROWS, COSTS)


@pytest.fixture(scope="module")
def varieties(spark):
    return datasets.parse_varieties(
        spark.createDataFrame(VARIETY_ROWS, "crop string, variety string, duration string, zone string")
    )


def test_soil_score(spark):
    soil = spark.createDataFrame(
        [(r[0].strip(), *[float(c) if c else None for c in r[1:]]) for r in SOIL_ROWS],
        "district string, zn double, fe double, cu double, mn double, b double, s double",
    )
    scored = farming.soil_rank(farming.soil_score(soil))
    got = {r.district: r for r in scored.collect()}
    assert got["Partly"].soil_score == 30.0 and got["Partly"].n_known == 3 and got["Partly"].deficient == ["zn", "mn", "s"]
    assert got["Nowhere"].soil_score is None and got["Nowhere"].percentile is None
    assert got["Marsh"].deficient == ["zn"] and got["Marsh"].soil_score == 65.0
    assert [got[d].percentile for d in ("Partly", "Marsh", "Ridge")] == [0.0, 0.5, 1.0]


def test_ranking_and_efficiency(costs):
    ranked = {(r.crop, r.state): r.region_rank for r in farming.regional_ranking(costs, "crop", "yield_quintal").collect()}
    assert ranked["PADDY", "Kerala"] == 1 and ranked["PADDY", "Tripura"] == 2
    ratios = {(r.crop, r.state): r for r in farming.yield_efficiency(costs).collect()}
    assert ratios["BARLEY", "Rajasthan"].efficiency_a2fl == pytest.approx(4.0)
    assert ratios["BARLEY", "Rajasthan"].efficiency_rank == 1
    sides = farming.best_and_worst(costs, "crop", "state", "yield_quintal", 1).where("crop = 'PADDY'")
    assert sorted((r.side, r.state) for r in sides.collect()) == [("high", "Kerala"), ("low", "Tripura")]


def test_varieties_by_state(varieties):
    got = {(r.state, r.crop): (r.n_varieties, r.min_days, r.max_days) for r in farming.variety_by_state(varieties).collect()}
    assert got["Tripura", "Paddy"] == (2, 100, 110)
    assert got["Kerala", "Millet"] == (1, 95, 95)
    assert ("Goa", "Paddy") not in got


def test_keys(spark):
    df = spark.createDataFrame([("PADDY ",), (" Cotton(lint)",), ("Oat\t  x",), (None,)], "crop string")
    assert [r.crop_key for r in keys.with_key(df, "crop").collect()] == ["rice", "cotton", "oat x", None]
    aliases = spark.createDataFrame([("Paddy", "Rice"), ("paddy", "Rice")], "alias string, key string")
    assert [r.crop_key for r in keys.with_key(df.limit(1), "crop", aliases=aliases).collect()] == ["rice"]


def test_joins_keep_rows(spark, costs, varieties):
    index = spark.createDataFrame([("Rice", 100.0), ("Rice", 110.0), ("Wheat", 1.0)], "Crop string, Index_Value double")
    measures = spark.createDataFrame(
        [("Barley", 10.0, 20.0, 50.0), ("Barley", 20.0, 20.0, 100.0)], "crop string, production double, area double, yield double"
    )
    table = unify.unified(costs, index, measures, varieties)
    assert table.count() == len(COST_ROWS)
    got = {(r.crop, r.state): r for r in table.collect()}
    assert got["PADDY", "Tripura"].mean_index == 105.0 and got["PADDY", "Tripura"].n_varieties == 2
    assert got["BARLEY", "Haryana"].yield_index == 75.0 and got["BARLEY", "Haryana"].n_varieties is None
    assert farming.yield_by_geography(costs, varieties).count() == len(COST_ROWS)
    assert farming.crop_performance(costs, measures.limit(1)).where("production IS NOT NULL").count() == 2
    missing = keys.unmatched_keys(keys.with_key(costs, "crop"), keys.with_key(measures, "crop"), ["crop_key"])
    assert sorted(map(tuple, missing.collect())) == [("lentil", 1), ("onion", 1), ("rice", 2)]


def test_soil_by_crop_leaves_ambiguous_names_out(spark, costs):
    soil = spark.createDataFrame(
        [("Twinford", 10.0), ("Lakeside ", 40.0), ("Hilltop", 60.0)], "district string, zn double"
    ).select("*", *[F.lit(None).cast("double").alias(c) for c in ("fe", "cu", "mn", "b", "s")])
    districts = spark.createDataFrame(
        [("twinford", "Kerala"), ("Twinford", "Goa"), ("LAKESIDE", "Kerala"), ("Lakeside", "Kerala"), ("Hilltop", "Kerala")],
        "district string, state string",
    )
    got = {(r.crop, r.state): (r.soil_score, r.n_districts) for r in farming.soil_by_crop(soil, districts, costs).collect()}
    assert len(got) == len(COST_ROWS)
    assert got["PADDY", "Kerala"] == (50.0, 2) and got["ONION", "Goa"] == (None, None)


def test_checks(spark, costs):
    measures = spark.createDataFrame(
        [("Rice", "2006-07", 200.8, 168.5, 119.2), ("Bad", "2006-07", 100.0, 50.0, 150.0), ("Gap", "x", None, 1.0, 1.0)],
        "crop string, year string, production double, area double, yield double",
    )
    broken = farming.violations(measures, farming.measure_checks(), ["crop", "year"]).collect()
    assert [(r.crop, r.check, r.actual, r.expected) for r in broken] == [("Bad", "yield_is_production_over_area", 150.0, 200.0)]
    assert farming.violations(costs, farming.cost_checks(), ["crop"]).count() == 0
    twice = costs.withColumn("cost_per_quintal", F.col("cost_per_quintal") * 2)
    assert farming.violations(twice, farming.cost_checks(), ["crop"]).count() == len(COST_ROWS)


CROPS = "name string, profit string, season string, water string, risk string"


def test_recommend_rows_in_the_form_of_cards(spark):
    crops = spark.createDataFrame([
        ("Long Rice", "₹41,000 - ₹49,000", "Kharif", "High", "Medium"),
        ("Root Spice", "₹60,000 - ₹70,000", "Both", "Medium", "Low"),
        ("Oil Bean", "₹30,000 - ₹36,000", "Kharif", "Medium", "Low"),
    ], CROPS)
    requests = spark.createDataFrame(
        [(1, "kharif", "high", "low"), (2, "rabi", "medium", "low"), (3, "kharif", "low", "high")],
        "id int, season string, waterAvailability string, investmentCapacity string",
    )
    got = sorted((r.id, r.place or 0, r.name) for r in recommend.recommend(requests, crops, 3).collect())
    assert got == [
        (1, 1, "Root Spice"), (1, 2, "Long Rice"), (1, 3, "Oil Bean"), (2, 1, "Root Spice"), (3, 0, None)
    ]


def test_recommend_against_brute_force(spark):
    rng = random.Random(2)
    levels = ["low", "medium", "high"]
    crops, facts = [], []
    for i in range(120):
        low = rng.randrange(10, 90) * 1000
        season, water, risk = rng.choice(["Kharif", "Rabi", "Zaid", "Both"]), rng.choice(levels), rng.choice(levels)
        cost = rng.choice([5000.0, 20000.0, 20000.5, 50000.0, 80000.0])
        crops.append((f"crop{i:03}", f"₹{low:,} - ₹{low + 500:,}", season, water.title(), risk.title(), cost))
        need = 0 if cost <= 20000 else 1 if cost <= 50000 else 2
        facts.append((f"crop{i:03}", season.lower(), levels.index(water), need, (low + 250) * {"low": 1.0, "medium": 0.9, "high": 0.8}[risk]))
    asked = [(i, rng.choice(["kharif", "rabi", "zaid"]), rng.choice(levels), rng.choice(levels)) for i in range(60)]
    expected = set()
    for i, season, water, money in asked:
        fit = [f for f in facts if f[1] in (season, "both") and f[2] <= levels.index(water) and f[3] <= levels.index(money)]
        for place, fact in enumerate(sorted(fit, key=lambda f: (-f[4], f[0]))[:4], 1):
            expected.add((i, place, fact[0]))
    result = recommend.recommend(
        spark.createDataFrame(asked, "id int, season string, waterAvailability string, investmentCapacity string"),
        spark.createDataFrame(crops, CROPS + ", cost double"), 4, "cost",
    )
    assert {(r.id, r.place, r.name) for r in result.collect() if r.name} == expected


def test_models(spark):
    rows = [(c, float(x), 10.0 * x + {"a": 1.0, "b": 5.0}[c], "big" if x > 6 else "small") for c in "ab" for x in range(12)]
    df = spark.createDataFrame(rows, "crop string, cost double, y double, size string")
    train, test = models.split_rows(df, ["crop", "cost"], 0.3)
    assert train.count() + test.count() == len(rows) and train.join(test, ["crop", "cost"]).count() == 0
    model = models.yield_regression(df, "y", ["crop"], ["cost"])
    assert all(r.prediction == pytest.approx(r.y, abs=1e-3) for r in models.predict(model, df).collect())
    forest = models.crop_classifier(df, "size", numbers=["cost"])
    assert set(models.predict(forest, df).columns) == {*df.columns, "prediction"}


def test_values_that_training_lacked_have_no_prediction(spark):
    rows = [(c, float(x), 3.0 * x + k) for k, c in enumerate("abc") for x in range(5)]
    df = spark.createDataFrame(rows, "crop string, cost double, y double")
    model = models.yield_regression(df, "y", ["crop"], ["cost"])
    asked = spark.createDataFrame([("b", 7.0), ("z", 7.0), (None, 7.0)], "crop string, cost double")
    assert [r.prediction if r.prediction is None else round(r.prediction, 6) for r in models.predict(model, asked).collect()] == [22.0, None, None]
    alone = models.yield_regression(df.where("crop = 'a'"), "y", ["crop"], ["cost"])  # one value: nothing to tell apart
    assert round(models.predict(alone, asked.withColumn("crop", F.lit("a"))).first().prediction, 6) == 21.0


def test_folds_as_by_fitting_each(spark):
    rng = random.Random(6)
    rows = [(rng.choice("abcdefgh"), float(rng.randrange(9)), rng.random(), rng.randrange(3)) for _ in range(90)]
    rows = [(c, x, z, 2 * x - z + ord(c) + rng.random(), f) for c, x, z, f in rows] + [("lone", 1.0, 1.0, 5.0, 1), (None, 1.0, 1.0, 1.0, 0), ("a", None, 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "crop string, x double, z double, y double, fold int")
    got = {r.fold: r for r in models.fold_errors(df, "y", "crop", ["x", "z"], F.col("fold")).collect()}
    assert sorted(got) == [0, 1, 2]
    for fold, r in got.items():
        known = df.dropna()
        train, test = known.where(F.col("fold") != fold), known.where(F.col("fold") == fold)
        fitted = models.predict(models.yield_regression(train, "y", ["crop"], ["x", "z"]), test).collect()
        errors = [(p.prediction - p.y) ** 2 for p in fitted if p.prediction is not None]
        assert (r.n_train, r.n_test, r.n_unknown) == (train.count(), len(fitted), len(fitted) - len(errors))
        assert r.rmse == pytest.approx((sum(errors) / len(errors)) ** 0.5, rel=1e-6)
    assert got[1].n_unknown == 1
    one = spark.createDataFrame([("a", 1.0, 2.0, 0)], "crop string, x double, y double, fold int")
    assert tuple(models.fold_errors(one, "y", "crop", ["x"], F.col("fold")).first())[:4] == (0, 0, 1, 1)
    assert models.fold_errors(one.where("false"), "y", "crop", ["x"], F.col("fold")).count() == 0


def test_performance_keeps_the_rows_of_the_left(spark):
    left = spark.createDataFrame([(1, "Rice"), (2, " PADDY"), (3, "oat"), (4, None)], "yield int, crop string")
    right = spark.createDataFrame([("rice", 2.0, "x"), ("Paddy ", 4.0, "y"), ("RICE", None, "z")], "crop string, yield double, note string")
    got = sorted(tuple(r) for r in farming.crop_performance(left, right).select("yield", "other_yield").collect())
    assert got == [(1, 3.0), (2, 3.0), (3, None), (4, None)]
    top = farming.crop_performance(left, right, figures={"most": F.max("yield"), "rows": F.count(F.lit(1))})
    assert sorted(str(tuple(r)) for r in top.select("yield", "most", "rows").collect()) == [
        "(1, 4.0, 3)", "(2, 4.0, 3)", "(3, None, None)", "(4, None, None)"
    ]


def test_recommend_keeps_seasons_of_its_own(spark):
    crops = spark.createDataFrame([("Winter Oat", "₹10,000 - ₹20,000", "Winter", "Low", "Low")], CROPS)
    asked = spark.createDataFrame(
        [(1, "winter", "high", "low"), (2, "rabi", "high", "low")],
        "id int, season string, waterAvailability string, investmentCapacity string",
    )
    assert sorted((r.id, r.name or "") for r in recommend.recommend(asked, crops, 3).collect()) == [(1, "Winter Oat"), (2, "")]


def test_too_many_categories_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(models, "MOST_CATEGORIES", 20)
    rows = spark.range(200).select(F.col("id").cast("double").alias("y"), F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="categories"):
        models.yield_regression(rows, "y", categories=["c"])


def test_split_does_not_depend_on_partitions(spark):
    rows = spark.range(1000)
    one, two = (models.split_rows(rows.repartition(n), ["id"]) for n in (1, 7))
    assert [sorted(r.id for r in x.collect()) for x in one] == [sorted(r.id for r in x.collect()) for x in two]


def test_recommend_by_region_and_soil(spark):
    crops = [("A", "₹90,000 - ₹90,000", "Both", "Low", "Low", "North, East", "clay"), ("B", "₹50,000 - ₹50,000", "Both", "Low", "Low", None, " "),
             ("C", "₹70,000 - ₹70,000", "Both", "Low", "Low", "south", None)]
    asked = [(1, "north", "clay"), (2, "South ", "red"), (3, "north", "red"), (4, None, None), (5, "west", None)]
    result = recommend.recommend(
        spark.createDataFrame([(i, "kharif", "low", "low", *x) for i, *x in asked],
                              "id int, season string, waterAvailability string, investmentCapacity string, region string, soilType string"),
        spark.createDataFrame(crops, CROPS + ", region string, soil string"), 2,
    )
    got = {}
    for r in sorted(result.collect(), key=lambda r: (r.id, r.place)):
        got.setdefault(r.id, []).append(r.name)
    assert got == {1: ["A", "B"], 2: ["C", "B"], 3: ["B"], 4: ["A", "C"], 5: ["B"]}


def test_near_keys_as_by_all_pairs(spark):
    rng = random.Random(12)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    names = ["".join(rng.choice("abc ") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 9, 14]))) for _ in range(160)] + ["aaaaaaa", "aaaaaaaaa"]
    left, right = (spark.createDataFrame([(n,) for n in some] + [(None,)], "name string") for some in (names[::2], names[1::2] + names[:9]))
    for distance in (1, 2, 3):
        want = {(a, b, edits(a, b)) for a in names[::2] for b in names[1::2] + names[:9] if edits(a, b) <= distance}
        assert {tuple(r) for r in keys.near_keys(left, right, "name", distance).collect()} == want


def test_checks_across_tables_align_units_and_periods(spark):
    yields = spark.createDataFrame(
        [("Oat", "2006-07", 2.0), ("Oat", "2007-08", 2.0), ("Rye", "2006-07", 9.0), (None, "2006-07", 9.0), ("Oat", None, 9.0), ("Flax", "2006-07", 1.0)],
        "crop string, year string, tonnes double",
    )
    # In quintals by date; the crop year turns on the first of July.
    lots = spark.createDataFrame(
        [("Oat", "2006-07-01", 12.0), ("Oat", "2007-06-30", 8.0), ("Oat", "2007-07-01", 30.0), ("Rye", "2006-12-01", None), (None, "2006-12-01", 1.0)],
        "name string, day string, quintals double",
    ).withColumn("day", F.to_date("day"))
    rules = [
        farming.CrossCheck("sum", F.col("tonnes"), F.sum("quintals"), 0.01, factor=0.1),
        farming.CrossCheck("most", F.col("tonnes"), F.max("quintals"), 0.0, factor=0.1, upper_bound=True),
    ]
    periods = (start_year(F.col("year")), farming.crop_year(F.col("day")))
    found = farming.cross_violations(yields, lots, {"crop": "name"}, periods, rules, ["crop", "year"])
    assert sorted((r.crop, r.year, r.check, r.actual, round(r.expected, 6)) for r in found.collect()) == [
        ("Oat", "2006-07", "most", 2.0, 1.2), ("Oat", "2007-08", "sum", 2.0, 3.0)
    ]
    assert farming.cross_violations(yields, lots.where("false"), {"crop": "name"}, periods, rules, ["crop"]).count() == 0
