"""Exceptions in brackets."""

from pyspark.sql import functions as F

from furrow.functions import text as X
from furrow.functions.zones import scopes, zones_but
from furrow.sources import datasets

NORTH_EAST = ["Arunachal Pradesh", "Assam", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Sikkim", "Tripura"]

CASES = {
    "West Bengal (except Hills), Orissa": (["Orissa", "West Bengal"], [("West Bengal", "Hills")]),
    "South India (except Kerala and Tamil Nadu), Goa": (["Andhra Pradesh", "Goa", "Karnataka"], []),
    "Bihar (except Gaya and Patna divisions) Jammu and Kashmir (wet)": (
        ["Bihar", "Jammu and Kashmir"], [("Bihar", "Gaya"), ("Bihar", "Patna divisions")]),
    "North East States and J & K (Excluding Jammu and Kashmir)": (NORTH_EAST, []),
    # Nested: the exception ends with its own bracket, what is inside it stays with it.
    "The hills (North Eastern States (except Assam, Sikkim (coast)) and Bihar) Goa": (
        sorted([*NORTH_EAST[:1], *NORTH_EAST[2:], "Bihar", "Goa"]), [("Sikkim", "Sikkim (coast)")]),
    # In order: named again after its exception, and a part of a name that goes later.
    "(except Kerala) Kerala": (["Kerala"], []),
    "Goa (except coast), Punjab [but not Goa]": (["Punjab"], []),
    # Brackets that do not match.
    "Punjab (except": (["Punjab"], []),
    "Bihar) and (Goa": (["Bihar", "Goa"], []),
    "UP (exceptional soils)": (["Uttar Pradesh"], []),
    "": ([], []),
    None: ([], []),
}


def test_exceptions(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "t string")
    got = {r.t: (sorted(r.z.states), [tuple(p) for p in r.z.parts]) for r in df.select("t", zones_but(F.col("t")).alias("z")).collect()}
    assert got == {t: (sorted(states), parts) for t, (states, parts) in CASES.items()}


def test_scopes(spark):
    df = spark.createDataFrame([("a (b) (except c (d) e) f",)], "t string").select(scopes(F.col("t")).alias("s"))
    assert [tuple(s) for s in df.first().s] == [(False, "a "), (False, "b"), (False, " "), (True, "except c (d) e"), (False, " f")]


def test_texts_without_brackets_are_as_before(spark):
    texts = ["Punjab, MP and Tamilnadu", "All parts of South India.", "", "nowhere", "Goan"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.a == r.b for r in df.select(zones_but(F.col("t"))["states"].alias("a"), X.zones(F.col("t")).alias("b")).collect())


def test_varieties_leave_excepted_states_out(spark):
    df = spark.createDataFrame([("Oat", "Goa and South India (except Karnataka)", "90")], "crop string, zone string, duration string")
    row = datasets.parse_varieties(df).first()
    assert row.states == ["Andhra Pradesh", "Goa", "Kerala", "Tamil Nadu"] and row.excepted == []
