"""Language model scores: log-frequency Bloom filters of quantised bigram counts, and exact add-one word probabilities.

Counts come from the whole training part, all words and all pairs. Texts are dealt into slices of bounded size. The pairs
of all slices are added up by range of their hash, in packed arrays, and each range has a filter of its own: with a fixed
number of bits per level of a pair, so that filters grow with the corpus and errors do not. A pair's count is the number
of its levels that the filter of its range holds, each found by a membership probe; the task that has built a filter
probes it for all slices and sends the levels back. Exact counts of frequent words are held by every task; all other
words meet their counts in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BASES, mix, remainder, slices, stored, texts, with_text

FOLDS, HELD_OUT = 7, 2
#: Stands for the end of a text; no byte of UTF-8.
END = b"\xff"
#: Most words whose counts every task holds, most bits of one range's filter, hash functions, and share of bits set in it.
VOCABULARY, BITS, PROBES, LOAD = 200_000, 1 << 28, 3, 0.25
#: Pairs are counted by range of their hash, and each range has its own filter. There are as many ranges, a
#: power of two between these, as leave each about so many tokens of the corpus.
LEAST_RANGES, MOST_RANGES, RANGE_TOKENS = 1 << 8, 1 << 20, 2_000_000
#: Least count of a pair; weight of the pair's share of its first word, against the word probability.
LEAST, SHARE = 1, 0.15
MOST_LEVELS = 48
#: Bits of a pair's hash beyond those of its range. Two of some million pairs of a range share them once in 10^4 times, much
#: less often than a probe of the filter errs.
HASH_BITS = 36


def tokens(texts_: list[str]) -> list[bytes]:
    """The tokens of several texts: words between ASCII white space, A to Z in lower case, and after each text the end."""
    return b" ".join(chain.from_iterable((t.encode(), END) for t in texts_)).lower().split()


def is_held_out(doc_id: str = "doc_id") -> Column:
    """A row without an id belongs to the training part."""
    return F.coalesce(remainder(doc_id, FOLDS) == HELD_OUT, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over all rows of ``docs``; each task adds up its own tokens first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["token", "n"])

        for batch in slices(batches, "text"):
            total.update(tokens(texts(batch)))
            if len(total) > 300_000:
                yield packed()
                total.clear()
        if total:
            yield packed()

    return docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Frequent:
    """Exact counts of the frequent words, and what is needed for the probability of any word."""

    index: pd.Index
    counts: np.ndarray
    total: int
    types: int

    @property
    def room(self) -> int:
        return self.total + self.types + 1

    def places(self, distinct: np.ndarray) -> np.ndarray:
        """The place of each token in the table, or -1."""
        return self.index.get_indexer(distinct)


def frequent(counts: DataFrame, most: int = VOCABULARY) -> Frequent:
    """The words from the least count on at which they are no more than ``most``; found by a histogram of log counts."""
    step = F.floor(F.log2("n") * 8)
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rows = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    held, least = 0, None
    for row in rows:
        held += row["count"]
        if held > most:
            break
        least = row["step"]
    some = counts.where(step >= least).toPandas().sort_values("token") if least is not None else pd.DataFrame({"token": [], "n": []})
    return Frequent(pd.Index(some["token"].astype(object)), some["n"].to_numpy(np.int64), total, types)


@dataclass
class Sequence:
    """The tokens of some texts with an end in front, as numbers of the distinct ones, and the number of tokens of each text."""

    codes: np.ndarray
    distinct: np.ndarray
    sizes: np.ndarray

    def pair_hashes(self, shift: int) -> np.ndarray:
        """A hash, never 0, for each token but the first and the one before it; its last ``shift`` bits are 0."""
        h = pd.util.hash_array(self.distinct, categorize=False)[self.codes]
        return (mix(h[:-1] * BASES[0] + h[1:]) >> np.uint64(shift) | np.uint64(1)) << np.uint64(shift)


def sequence(batch: pa.RecordBatch | pa.Table) -> Sequence:
    codes, distinct = pd.factorize(np.array([END, *tokens(texts(batch))], dtype=object))
    return Sequence(codes, distinct, np.diff(np.flatnonzero(codes == 0)))


def levels(n: np.ndarray) -> np.ndarray:
    """Counts in powers of two: 1 for LEAST to 2 * LEAST - 1, and so on."""
    return (np.floor(np.log2(n / LEAST) + 1e-9) + 1).astype(np.int64)


def middle(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that have a level; 0 for level 0."""
    return np.where(level > 0, LEAST * 2.0 ** (level - 1) * 1.5 - 0.5, 0.0)


def ranges(tokens_: int) -> int:
    """Number of ranges for a corpus of so many tokens."""
    return min(max(LEAST_RANGES, 1 << max(0, -(-tokens_ // RANGE_TOKENS) - 1).bit_length()), MOST_RANGES)


def shift_of(n: int) -> int:
    """Bits of a hash that are left out with ``n`` ranges."""
    return max(0, 65 - n.bit_length() - HASH_BITS)


def range_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The range, out of ``n``, from the upper bits of a hash."""
    return (hashes >> np.uint64(65 - n.bit_length())).astype(np.int64)


def bits_of(hashes: np.ndarray, level: int, probe: int, size: int) -> np.ndarray:
    """Bit of a hash at a level, inside the ``size`` bits of its range."""
    salt = np.uint64((level * 64 + probe + 1) * int(BASES[1]) % 2**64)
    return ((mix(hashes + salt) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def fill(part: np.ndarray, hashes: np.ndarray, level: np.ndarray) -> None:
    """Sets the bits of all levels up to each hash's own."""
    flags = np.unpackbits(part, bitorder="little")
    for step in range(1, int(level.max(initial=0)) + 1):
        hashes, level = hashes[level >= step], level[level >= step]
        for probe in range(PROBES):
            flags[bits_of(hashes, step, probe, len(flags))] = 1
    part[:] = np.packbits(flags, bitorder="little")


@dataclass
class Filter:
    bits: np.ndarray
    ranges: int = 1
    first: int = 1  # the level that probing begins with

    def level(self, hashes: np.ndarray, top: int = MOST_LEVELS) -> np.ndarray:
        """The last level up to which every probe finds the hash; 0 for a hash of 0."""
        out = np.zeros(len(hashes), np.int64)
        at = np.flatnonzero(hashes)
        h = hashes[at]
        size = 8 * len(self.bits) // self.ranges
        start = range_of(h, self.ranges) * size
        for step in range(self.first, top):
            for probe in range(PROBES):
                bit = start + bits_of(h, step, probe, size)
                found = (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
                at, h, start = at[found], h[found], start[found]
            if not len(at):
                break
            out[at] = step
        return out


def build(values: np.ndarray, counts: np.ndarray, load: float = LOAD) -> Filter:
    """The filter of one range from the counts of its pairs; a pair may come several times, which is added up."""
    order = np.argsort(values)
    values, n = values[order], counts[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    n = np.add.reduceat(n, starts) if len(values) else n
    keep = n >= LEAST
    level = levels(n[keep])
    size = int(np.ceil(level.sum() * PROBES / -np.log(1 - load) / 8)) + 8
    if 8 * size > BITS:
        raise ValueError(f"a range of pairs needs {8 * size} bits of filter; at most {BITS} are held")
    part = np.zeros(size, np.uint8)
    fill(part, values[starts][keep], level)
    return Filter(part)


ROW = "slice long, place int, doc_id {kind}, held_out boolean, text string"
#: A part is ``size`` rows of a slice from ``place`` on, as one task has read them together.
PART = "slice long, place int, size int"
LEVELS = f"{PART}, segment int, levels binary"


def sliced(rows: DataFrame, kind: str) -> DataFrame:
    """The rows, each with the number of a slice and its place there; a slice has bounded bytes, or one text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, number)), pa.array(np.arange(batch.num_rows, dtype=np.int32)), *(batch.column(c) for c in ("doc_id", "held_out", "text"))],
                ["slice", "place", "doc_id", "held_out", "text"],
            )
            number += 1

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, ROW.format(kind=kind))


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of each slice that a batch holds, which may be a part of the slice."""
    numbers = batch.column("slice").to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def packed(values: np.ndarray, shift: int) -> bytes:
    """Ascending hashes as differences, byte by byte, so that the leading zeros compress."""
    return np.diff(values >> np.uint64(shift), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes, shift: int) -> np.ndarray:
    each = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(each, dtype=np.uint64) << np.uint64(shift)


def pair_levels(slices_: DataFrame, n_ranges: int) -> DataFrame:
    """(slice, place, size, segment, levels): per part and range the levels of its distinct pairs, in the order of their hashes."""
    load, shift = LOAD, shift_of(n_ranges)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts_of(batch)):
            found = sequence(part)
            values, place = np.unique(found.pair_hashes(shift), return_inverse=True)
            trains = np.repeat(~np.array(part.column("held_out").to_pylist(), bool), found.sizes)
            n = np.bincount(place[trains], minlength=len(values)).astype(np.uint32)
            cuts = np.searchsorted(range_of(values, n_ranges), np.arange(n_ranges + 1))
            rows = [(s, packed(values[a:b], shift), n[a:b].tobytes()) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            whose = [(part.column("slice")[0].as_py(), pa.int64()), (part.column("place")[0].as_py(), pa.int32()), (part.num_rows, pa.int32())]
            columns = [pa.array([v] * len(rows), k) for v, k in whose]
            columns += [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "place", "size", "segment", "hashes", "counts"])

    def probe(group: pa.Table) -> pa.Table:
        each = [unpacked(x, shift) for x in group.column("hashes").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in group.column("counts").to_pylist()])
        values = np.concatenate(each)
        filter_ = build(values[counts > 0], counts[counts > 0], load)
        found = [filter_.level(x).astype(np.uint8).tobytes() for x in each]
        return group.select(["slice", "place", "size", "segment"]).append_column("levels", pa.array(found, pa.binary()))

    pairs = slices_.mapInArrow(gather, f"{PART}, segment int, hashes binary, counts binary")
    return pairs.groupBy("segment").applyInArrow(probe, LEVELS)


def rare_counts(parts: DataFrame, table, counts: DataFrame) -> DataFrame:
    """(slice, token, n): the counts of the words of each slice that ``table`` does not hold; none for unknown ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts_of(batch)):
            distinct = sequence(part).distinct
            rare = distinct[table.value.places(distinct) < 0].tolist()
            if rare:
                yield pa.RecordBatch.from_arrays([pa.array([part.column("slice")[0].as_py()] * len(rare), pa.int64()), pa.array(rare, pa.binary())], ["slice", "token"])

    # A word comes again where a slice is read in several parts, which is harmless.
    asked = parts.select("slice", "text").mapInArrow(run, "slice long, token binary")
    return asked.join(counts, "token").select("slice", "token", "n")


def score(docs: DataFrame) -> DataFrame:
    """Per row doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Null and empty texts are one token, the end. Repeated rows count as often as they occur and get equal scores.
    The model's probability of a word after a known one is SHARE * pair count / count of the first word + (1 - SHARE)
    * add-one probability of the word, the pair count from the filter; after any other word it is the latter alone.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_text(docs, "text", "doc_id").select("doc_id", "text", is_held_out().alias("held_out"))
    parts = stored(spark, sliced(rows, kind), "lm-slices")
    counts = stored(spark, word_counts(rows.where(~F.col("held_out"))), "lm-words")
    words = frequent(counts)
    table = spark.sparkContext.broadcast(words)
    n_ranges = ranges(words.total)
    shift = shift_of(n_ranges)
    pairs = pair_levels(parts, n_ranges)
    rare = rare_counts(parts, table, counts)
    facts = pairs.unionByName(rare, allowMissingColumns=True)

    def run(group: pa.Table, facts: pa.Table) -> pa.Table:
        known = table.value
        group = group.sort_by("place")
        tokens_ = sequence(group)
        codes, distinct, sizes = tokens_.codes, tokens_.distinct, tokens_.sizes
        hashes = tokens_.pair_hashes(shift)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        found = facts.filter(facts.column("levels").is_valid()).sort_by([("place", "ascending"), ("segment", "ascending")])
        firsts, counted = found.column("place").to_numpy(), found.column("size").to_numpy()
        level = np.empty(len(hashes), np.int64)
        for first in np.unique(firsts):
            mine = np.flatnonzero(firsts == first)
            where = slice(ends[first], ends[first + counted[mine[0]]])
            data = b"".join(found.column("levels").slice(mine[0], len(mine)).to_pylist())
            level[where] = np.frombuffer(data, np.uint8)[np.unique(hashes[where], return_inverse=True)[1]]
        others = facts.filter(facts.column("token").is_valid())
        n_of = dict(zip(others.column("token").to_pylist(), others.column("n").to_pylist()))
        place = known.places(distinct)
        n = np.zeros(len(distinct), np.int64)
        n[place >= 0] = known.counts[place[place >= 0]]
        for c in np.flatnonzero(place < 0):
            n[c] = n_of.get(distinct[c], 0)
        n = n[codes]
        before, n = n[:-1], n[1:]
        own = (n + 1) / known.room
        value = np.log10(np.where(before > 0, (1 - SHARE) * own + SHARE * np.minimum(middle(level) / np.maximum(before, 1), 1), own))
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        return pa.table(
            [group.column("doc_id"), group.column("held_out"), pa.array(sizes), pa.array(np.add.reduceat((n > 0).astype(np.int64), starts)),
             pa.array(np.add.reduceat(np.log10(own), starts)), pa.array(np.add.reduceat(value, starts))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = parts.groupBy("slice").cogroup(facts.groupBy("slice")).applyInArrow(run, schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score")
