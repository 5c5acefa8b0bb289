"""Search by the index of words against a scan of the texts."""

import random
import re
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from furrow.functions import text as X
from furrow.operators import text_index

TEXTS = ["", " ", "  ", "   ", "Rice of the North", "rice of  the north", " rice", "rice ", "price\tof the", "the of the of the", "a" * 5000, None, "Ärger im Öl"]
QUERIES = ["", " ", "  ", "   ", "rice", "Rice Of", "of the", "e of t", " rice", "rice ", "of  the", "the of the", " the ", "\tof", "ärger", "a" * 40, "zzz", "of zzz the", "%", "_"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    made = [(100 + i, "".join(rng.choice("ab ") for _ in range(rng.randrange(12))), rng.choice(["b a", None, "x"])) for i in range(150)]
    given = [(i, t, "Of The" if i % 5 == 0 else None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*made, *given], "key long, text string, note string")


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "words")
    text_index.build(rows, "key", ["text", "note"], path, folders=16)
    return text_index.opened(spark, path)


@pytest.mark.parametrize("query", [*QUERIES, "a b", "a  b", "b a b", " a", "ab ", "a  ", "  b "])
def test_equals_the_scan(spark, rows, index, query):
    scan = {r.key for r in rows.where(X.search([F.col("text"), F.col("note")], query)).collect()}
    found = [r.id for r in text_index.find(index, query).collect()]
    assert len(found) == len(set(found)) and set(found) == scan


def test_reads_only_the_folders_of_the_words(spark, rows, tmp_path):
    path = str(tmp_path / "words")
    text_index.build(rows, "key", ["text", "note"], path, folders=16)
    words = spark.read.parquet(f"{path}/words")
    asked = {r.folder for r in words.where("word = 'of' or endswith(word, 'rice') or startswith(word, 'the')").collect()}
    others = [f for f in Path(path, "places").glob("folder=*/*.parquet") if int(f.parent.name.split("=")[1]) not in asked]
    assert others and asked
    stray = pa.table({
        "id": pa.array([999] * 3, pa.int64()), "column": pa.array([0] * 3, pa.int32()), "last": pa.array([2] * 3, pa.int32()),
        "position": pa.array([0, 1, 2], pa.int32()), "word": ["rice", "of", "the"],
    })
    for file in others:  # a reader of these would find a row that does not exist
        pq.write_table(stray, file)
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    found = text_index.find(text_index.opened(spark, path), "rice of the")
    assert {r.id for r in found.collect()} == {4}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*folder", plan)) >= 3 and "EqualTo(word,of)" in plan


def test_empty_tables_repeated_and_missing_ids(spark, tmp_path):
    schema = "word string, folder string"
    rows = spark.createDataFrame([("k", "red beet"), ("k", "red"), (None, "red")], schema)
    text_index.build(rows, "word", ["folder"], str(tmp_path / "a"))
    assert [r.id for r in text_index.find(text_index.opened(spark, str(tmp_path / "a")), "RED").collect()] == ["k"]
    text_index.build(rows.where("false"), "word", ["folder"], str(tmp_path / "b"))
    assert text_index.find(text_index.opened(spark, str(tmp_path / "b")), "red").count() == 0


def test_few_rows_are_dealt_for_many_places(spark, tmp_path, monkeypatch):
    texts = [f"the rice of row {k % 3} the" for k in range(400)]
    rows = spark.createDataFrame([(k, t, "the") for k, t in enumerate(texts)], "key long, text string, note string").coalesce(1)
    for cut, block in ((text_index.CUT_BYTES, text_index.BLOCK_WORDS), (100, 7)):  # the second in runs that end inside texts
        monkeypatch.setattr(text_index, "CUT_BYTES", cut)
        monkeypatch.setattr(text_index, "BLOCK_WORDS", block)
        path = str(tmp_path / f"words{block}")
        text_index.build(rows, "key", ["text", "note"], path, folders=4)
        index = text_index.opened(spark, path)
        assert {r.word: r.n for r in index.words.collect()} == {"the": 1200, "rice": 400, "of": 400, "row": 400, "0": 134, "1": 133, "2": 133}
        want = sorted((k, c, p, w) for k, t in enumerate(texts) for c, x in enumerate((t, "the")) for p, w in enumerate(x.split(" ")))
        assert sorted((r.id, r.column, r.position, r.word) for r in index.places.collect()) == want
        for query in ("the", "row 2 the", "the ", " the", "2 the "):
            scan = {r.key for r in rows.where(X.search([F.col("text"), F.col("note")], query)).collect()}
            assert {r.id for r in text_index.find(index, query).collect()} == scan
        stored = spark.read.parquet(f"{path}/places").count()
        # A row per word and column of a run, not per place: of these there are 2800.
        assert stored == 8 if block > 7 else 8 < stored < 2800
