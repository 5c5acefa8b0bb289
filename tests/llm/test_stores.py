"""Archives and nearest neighbours."""

import base64
import gzip
import hashlib
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import ann, warc
from furrow.session import scratch_path


def pages(spark):
    rows = [(5, "http://a/ b\r\n", "<p>x</p>"), (3, None, "<p>x</p>"), (4, "http://é/", "<p>x</p>"), (7, "u", None), (6, "u", ""), (8, "u", "é" * 50_000),
            (None, "u", "<p>x</p>"), (None, "u", "only without id"), (9, "u", "twice"), (9, "u", "twice"), (10, "u", "\r\n\r\nWARC/1.1\r\n")]
    return spark.createDataFrame([(*r, 1, "c") for r in rows], "page_id long, url string, html string, same int, first string").repartition(3)


def test_archives_come_back(spark, tmp_path):
    df = pages(spark)
    path = scratch_path(spark, "test-warc")
    warc.write(df, path)
    got = warc.read(spark, path).collect()
    first = {}
    for r in df.collect():
        raw = (r["html"] or "").encode()
        if r["page_id"] is not None:
            first[raw] = min(first.get(raw, r["page_id"]), r["page_id"])
    want = []
    for r in df.collect():
        raw = (r["html"] or "").encode()
        f = first.get(raw)
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        is_first = r["page_id"] == f
        want.append((r["page_id"], len(raw), sha, "response" if is_first else "revisit", None if is_first else f, raw if is_first else None))
    have = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"])) for r in got]
    key = lambda r: str((*r[:5], hashlib.md5(r[5] or b"").hexdigest()))
    assert sorted(map(key, have)) == sorted(map(key, want))
    files = [p for p in Path(path.removeprefix("file:")).iterdir() if p.name.startswith("part-")]
    text = b"".join(gzip.decompress(p.read_bytes()) for p in files)  # plain gzip files throughout
    assert text.count(b"WARC-Record-ID") == df.count()
    assert warc.round_trip(df.where("false")).count() == 0


def test_members_of_any_size_end_in_zero():
    for size in (0, 1, 255, 1 << 16, (1 << 24) + 5):
        data = warc.member(b"a" * size)
        assert data[-1] == 0 and b"".join(warc.members([data])) == b"a" * size


def test_members_across_chunks_and_damage():
    records = [warc.record(i, "u", b"payload %d" % i, None) for i in range(20)]
    data = b"".join(map(warc.member, records))
    for step in (1, 7, 1000, len(data)):
        assert list(warc.members(data[i : i + step] for i in range(0, len(data), step))) == records
    with pytest.raises(ValueError):
        list(warc.members([data[:-40]]))
    with pytest.raises(ValueError):
        warc.parsed(records[3].replace(b"payload 3", b"payload 4"))
    with pytest.raises(ValueError):
        warc.parsed(records[3][:-1])
    with pytest.raises(zlib.error):
        list(warc.members([b"not gzip"]))


def exact(rows, every, k):
    out = {}
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    for q, x in good:
        if q % every == 0:
            scored = sorted((-float(y @ x / np.linalg.norm(y) / np.linalg.norm(x)), i) for i, y in good if i != q and len(y) == len(x))
            out[q] = scored[:k]
    return out


@pytest.mark.parametrize("n, dim", [(30, 4), (900, 16)])
def test_neighbours(spark, monkeypatch, n, dim):
    monkeypatch.setattr(ann, "SHARD", 300)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=dim).astype(np.float32).tolist()) for i in range(n)]
    same = rng.normal(size=dim).astype(np.float32).tolist()
    rows += [(1000 + i, same) for i in range(40)]
    rows += [(5000, None), (5050, [0.0] * dim), (5100, [float("nan")] * dim), (5150, [None, *same[1:]]), (None, same), (5200, [float("inf")] * dim), (5250, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, key string, shard int").repartition(3)
    got = {}
    for r in ann.nearest(df, 10, 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = exact(rows, 10, 5)
    assert got.keys() == want.keys()
    hits = total = 0
    for q, answer in want.items():
        assert sorted(got[q]) == list(range(1, 6))
        assert [v for _, v in sorted(got[q].items())] == sorted(got[q].values(), key=lambda v: (-v[1], v[0]))
        hits += len({i for _, i in answer} & {i for i, _ in got[q].values()})
        total += 5
    assert hits >= 0.95 * total
    for q in range(1000, 1040, 10):  # copies tie, and the least ids come first
        assert [got[q][r][0] for r in range(1, 6)] == [i for i in range(1000, 1007) if i != q][:5]


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0, 0.0])], schema)).count() == 0
    two = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], schema)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in two] == [(0, 1, 1, 0.707107)]


@pytest.mark.parametrize("most", [10_000, 4])
def test_shards_are_dealt_without_a_sample_on_the_driver(spark, monkeypatch, most):
    monkeypatch.setattr(ann, "SHARD", 20)
    monkeypatch.setattr(ann, "TASKS", most)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=3 if i % 5 else 2).tolist()) for i in range(300)]
    shards = ann.index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 6)
    assert "rangepartitioning" not in shards._jdf.queryExecution().toString()
    found = shards.select("dim", "shard", "ids", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.dim, r.shard) for r in found) == [(2, s) for s in range(3)] + [(3, s) for s in range(12)]
    assert sorted(x for r in found for x in np.frombuffer(r.ids, np.int64).tolist()) == list(range(300))
    tasks = [r.task for r in found]
    assert len(set(tasks)) == min(15, most) and max(map(tasks.count, tasks)) == -(-15 // most)


def test_graph_survives_packing():
    base = np.random.default_rng(1).normal(size=(500, 8)).astype(np.float32)
    graph = ann.Graph(base).build()
    again = ann.Graph.unpacked(base, *graph.packed())
    q = ann.unit(base[:20])
    assert [graph.search(x, 30) for x in q] == [again.search(x, 30) for x in q]
    assert [graph.search(x, 30)[0] for x in q] == list(range(20))


def test_vectors_that_differ_past_single_precision(spark):
    off = {i: (i * 37 % 59 + 1) * 2e-8 for i in range(1, 60)}
    rows = [(0, [1.0, 0.0])] + [(i, [1.0 + d, 1.0]) for i, d in off.items()]
    found = sorted(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 100, 5).collect(), key=lambda r: r.rank)
    best = sorted(off, key=lambda i: -off[i])[:5]
    assert [r.vec_id for r in found] == best
    for r in found:
        x = np.array(rows[r.vec_id][1])
        assert abs(r.score - x[0] / np.sqrt(x @ x)) < 1e-15


def test_very_large_and_very_small_components(spark):
    rows = [(0, [1.0, 1.0]), (1, [1e300, 1e300]), (2, [1e-300, 2e-300]), (3, [-1e308, 1e308]), (4, [5e-324, 0.0])]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 100, 5).collect()
    assert [(r.rank, r.vec_id, round(r.score, 9)) for r in sorted(found, key=lambda r: r.rank)] == [
        (1, 1, 1.0), (2, 2, 0.948683298), (3, 4, 0.707106781), (4, 3, 0.0)
    ]
