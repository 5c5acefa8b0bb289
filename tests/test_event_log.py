"""A log that takes every event once, and its files."""

import datetime
from pathlib import Path

from furrow.sources import files

SCHEMA = "day date, id int, note string"


def batch(spark, rows):
    return spark.createDataFrame([(day and datetime.date(2024, 1, day), i, note) for day, i, note in rows], SCHEMA)


def content(spark, path):
    schema = batch(spark, []).schema
    return sorted((r.day.day if r.day else 0, r.id or 0, r.note or "") for r in files.read_events(spark, path, schema).collect())


def parts(path):
    return {d.name: len(list(d.glob("*.parquet"))) for d in Path(path).iterdir() if d.is_dir()}


def test_a_batch_twice_is_one_copy(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(1, 1, "a"), (1, 2, None), (2, 1, "other day"), (None, 3, "no day"), (1, None, "no id"), (1, 1, "z, repeated in its batch")]
    want = [(0, 3, "no day"), (1, 0, "no id"), (1, 1, "a"), (1, 2, ""), (2, 1, "other day")]
    for _ in range(2):
        files.append_events(batch(spark, rows), path, ["id"])
        assert content(spark, path) == want
    files.append_events(batch(spark, [(1, 1, "changed"), (3, 9, "new")]), path, ["id"])
    assert content(spark, path) == [*want, (3, 9, "new")]
    files.append_events(batch(spark, []), path, ["id"])
    assert content(spark, path) == [*want, (3, 9, "new")]


def test_compaction_bounds_the_files(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in range(6):
        files.append_events(batch(spark, [(1 + i % 2, 100 * k + i, "x") for i in range(20)]), path, ["id"])
    before = content(spark, path)
    assert len(before) == 120 and min(parts(path).values()) >= 6
    files.compact_events(spark, path, batch(spark, []).schema, ["id"], rows_per_file=25)
    assert content(spark, path) == before and max(parts(path).values()) <= 3
    stamp = {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}
    files.compact_events(spark, path, batch(spark, []).schema, ["id"], rows_per_file=25)  # nothing to do
    assert {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")} == stamp
