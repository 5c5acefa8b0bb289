"""Repeated passages: a De Bruijn graph of word windows, compacted along paths, joined by Spark.

The edges of the graph are windows of ``width`` words. Each text is cut into paths of consecutive edges that have the same
anchor, the place of the least hash of the shorter runs of words inside a window, so that equal edges have equal anchors wherever they
occur, and one row stands for about fourteen edges. Joins on the anchor find the paths that occur again as they are: they
do not branch, and all their edges are repeated. Only where paths of one anchor differ, one of each is taken apart into
edges, found by its text and place, and these are counted one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import BASES, mix, powers, slices, stored, texts, window_hashes, with_text, word_hashes

WIDTH = 35
#: Words of the runs that anchors are chosen from.
RUN = 8


def split(text: str) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return text.encode().split()


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` consecutive values."""
    out, reach = values, 1
    while 2 * reach <= n:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(out) - (n - reach)], out[n - reach :]) if n > reach else out


def paths(hashes: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor, digest of all words) of each path of consecutive texts."""
    run = min(RUN, width)
    ends = np.cumsum(sizes)
    at = np.arange(len(hashes) - width + 1)
    if len(at) <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    valid = at + width <= ends[owner]
    runs = window_hashes(hashes, run)
    # The least upper half of a hash, and of equal ones the leftmost: a choice that only the window's words decide.
    low = np.uint64(0xFFFFFFFF)
    least = (sliding_min((runs & ~low) | np.arange(len(runs), dtype=np.uint64), width - run + 1) & low).astype(np.int64)
    new = np.r_[True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])] & valid
    first = np.flatnonzero(new)
    # A path ends with the next one or with the last whole window of its text.
    last = np.minimum(np.r_[first[1:], len(at)], ends[owner[first]] - width + 1)
    total = np.empty(len(hashes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(hashes * powers(len(hashes), BASES[1]), out=total[1:])
    back = powers(len(hashes), np.uint64(pow(int(BASES[1]), -1, 1 << 64)))
    digest = mix((total[last + width - 1] - total[first]) * back[first] + (last - first).astype(np.uint64))
    return owner[first], first - (ends - sizes)[owner[first]], last - first, runs[least[first]], digest


def _hashed(batch: pa.RecordBatch) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    pieces = [split(t) for t in texts(batch)]
    return pieces, word_hashes([w for p in pieces for w in p]), np.array([len(p) for p in pieces], np.int64)


def _cut(rows: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, hashes, sizes = _hashed(batch)
            owner, start, n, anchor, path = paths(hashes, sizes, width)
            if len(owner):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(owner)), pa.array(start, pa.int32()), pa.array(n, pa.int32()),
                     pa.array(anchor.view(np.int64)), pa.array(path.view(np.int64))],
                    ["key", "start", "n", "anchor", "path"],
                )

    return rows.select("key", "text").mapInArrow(run, "key long, start int, n int, anchor long, path long")


def _again(pieces: DataFrame) -> DataFrame:
    """(anchor, branches): anchors that occur more than once, and whether their paths differ.

    Stored, so that the join with them reads both sides from a shuffle and can split a frequent anchor.
    """
    anchors = pieces.groupBy("anchor").agg(F.count("*").alias("times"), F.min("path").alias("low"), F.max("path").alias("high"))
    again = anchors.where("times > 1").select("anchor", (F.col("low") != F.col("high")).alias("branches"))
    return stored(pieces.sparkSession, again, "passages-anchors")


def _kept(words: list[bytes], spans: Iterable[tuple[int, int]]) -> tuple[list[bytes], int]:
    """The words outside the spans, and the number of words inside."""
    edges = np.zeros(len(words) + 1, np.int64)
    for a, b in spans:
        edges[a] += 1
        edges[b] -= 1
    out = np.cumsum(edges[:-1]) == 0
    kept = [w for w, k in zip(words, out.tolist()) if k] if not out.all() else words
    return kept, len(words) - len(kept)


def deduplicate(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row doc_id, n_words, n_removed and kept, the words that are left with one space between them.

    A word goes if a window of ``width`` words over it occurs anywhere else, in its own or any other row; all windows are
    judged on the input, so of a repeated passage no copy stays. Null and empty texts have no words. A repeated row is a
    repeat of itself. Windows count as equal by hashes of 128 bits, and rows are told apart by 64 bits of id and text.
    """
    spark = docs.sparkSession
    rows = with_text(docs, "text", "doc_id").withColumn("key", F.xxhash64("doc_id", "text"))
    pieces = _cut(rows, width)
    hits = stored(spark, pieces.join(_again(pieces), "anchor"), "passages-hits")
    plain = hits.where(~F.col("branches")).select("key", "start", "n", F.lit(True).alias("whole"), F.lit(False).alias("apart"))
    mixed = hits.where("branches")
    known = mixed.groupBy("anchor", "path").agg(F.count("*").alias("times"), F.min(F.struct("key", "start")).alias("one"))
    shared = mixed.join(known, ["anchor", "path"]).select(
        "key", "start", "n", (F.col("times") > 1).alias("whole"), (F.struct("key", "start") == F.col("one")).alias("apart")
    )
    marks = plain.union(shared).groupBy("key").agg(F.collect_set(F.struct("start", "n", "whole", "apart")).alias("marks"))
    first = stored(spark, _first(rows.join(marks, "key", "left"), width, docs.schema["doc_id"].dataType.simpleString()), "passages-first")
    done = first.where(~F.col("waits")).select("doc_id", "n_words", "n_removed", "kept")
    edges = first.where(F.size("at") > 0).select("key", F.explode(F.arrays_zip("at", "one", "two")).alias("e")).select("key", "e.*")
    edges = edges.distinct()  # a repeated row has its edges once
    twice = edges.groupBy("one", "two").agg(F.count("*").alias("times")).where("times > 1").select("one", "two")
    found = edges.join(twice, ["one", "two"]).groupBy("key").agg(F.collect_set("at").alias("found"))
    waiting = first.where("waits").select("doc_id", "key", "kept", "spans").join(found, "key", "left")
    return done.unionByName(_second(waiting, width, docs.schema["doc_id"].dataType.simpleString()))


def _first(rows: DataFrame, width: int, kind: str) -> DataFrame:
    """Rows whose marks decide everything are finished; the others wait with their text and the spans so far.

    ``at``, ``one``, ``two``: places and 128-bit hashes of the edges of the paths to be taken apart.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            pieces, hashes, sizes = _hashed(batch)
            ends = np.cumsum(sizes)
            columns: list[list] = [[] for _ in range(8)]
            for words, end, text, marks in zip(pieces, ends.tolist(), texts(batch), batch.column("marks").to_pylist()):
                marks = marks or []
                spans = [(m["start"], m["start"] + m["n"] + width - 1) for m in marks if m["whole"]]
                apart = [m for m in marks if m["apart"]]
                waits = any(not m["whole"] for m in apart)
                at = np.array([m["start"] + i for m in apart for i in range(m["n"])], np.int64)
                one = two = np.empty(0, np.uint64)
                if len(at):
                    mine = hashes[end - len(words) : end]
                    one, two = window_hashes(mine, width, BASES[0])[at], window_hashes(mine, width, BASES[1])[at]
                if waits:
                    values = (len(words), 0, text, True, [x for s in spans for x in s])
                else:
                    kept, gone = _kept(words, spans)
                    values = (len(words), gone, b" ".join(kept).decode(), False, [])
                for column, value in zip(columns, (*values, at.tolist(), one.view(np.int64).tolist(), two.view(np.int64).tolist())):
                    column.append(value)
            ints = pa.list_(pa.int32())
            longs = pa.list_(pa.int64())
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), ints, ints, longs, longs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "key", "n_words", "n_removed", "kept", "waits", "spans", "at", "one", "two"],
            )

    schema = f"doc_id {kind}, key long, n_words long, n_removed long, kept string, waits boolean, spans array<int>, at array<int>, one array<bigint>, two array<bigint>"
    return rows.select("doc_id", "key", "text", "marks").mapInArrow(run, schema)


def _second(rows: DataFrame, width: int, kind: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "kept"):
            columns: list[list] = [[], [], []]
            for text, spans, found in zip(batch.column("kept").to_pylist(), batch.column("spans").to_pylist(), batch.column("found").to_pylist()):
                words = split(text)
                kept, gone = _kept(words, [*zip(spans[::2], spans[1::2]), *((s, s + width) for s in found or ())])
                for column, value in zip(columns, (len(words), gone, b" ".join(kept).decode())):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_words", "n_removed", "kept"]
            )

    return rows.select("doc_id", "kept", "spans", "found").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")
