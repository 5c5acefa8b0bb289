"""Benchmark decontamination: SimHash fingerprints of item-sized windows, a multi-index over Hamming blocks, exact check.

A window of as many words as an item matches it if the weighted Jaccard similarity of their shingles of five words (an
item of fewer words is one shingle; weights count repeats) is at least 0.8. A document of fewer words than an item is one
window, all of it. Windows too poor in shingles of any item of
their size to reach that are not fingerprinted, which loses nothing. The others get a 64-bit fingerprint, in which a
shingle that repeats inside the window counts as another one each time; items that agree with it in one of RADIUS + 1
blocks of bits include all within RADIUS, and these are compared exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .text import BASES, mix, slices, stored, texts, window_hashes, with_text, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 fingerprints differ in 10 of 64 bits on average, with a deviation of 3.
RADIUS, BITS = 24, 64
#: Items looked for in one pass over the documents, all of which every task holds.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 64 << 20
#: Windows summed up together, and shingles of windows with repeats that are labelled together.
WINDOW_SHINGLES = 20_000

WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    return window_hashes(words, width)


def labelled(rows: np.ndarray) -> np.ndarray:
    """Each row's shingles, a repeated one changed by how often it came before in the row."""
    order = np.argsort(rows, axis=1, kind="stable")
    values = np.take_along_axis(rows, order, axis=1)
    place = np.arange(rows.shape[1])
    new = np.concatenate([np.ones((len(rows), 1), bool), values[:, 1:] != values[:, :-1]], axis=1)
    times = (place - np.maximum.accumulate(np.where(new, place, 0), axis=1)).astype(np.uint64)
    out = np.empty_like(rows)
    np.put_along_axis(out, order, np.where(times > 0, mix(values + times * BASES[1]), values), axis=1)
    return out


def signs(values: np.ndarray) -> np.ndarray:
    """Per shingle its 64 bits as -1 and 1."""
    bits = np.unpackbits(mix(values).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def last_before(values: np.ndarray) -> np.ndarray:
    """Place of the same value before, or -1."""
    order = np.argsort(values, kind="stable")
    out = np.full(len(values), -1)
    same = values[order[1:]] == values[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(place[: len(a)], minlength=len(values))
    y = np.bincount(place[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


@dataclass
class Items:
    """The items of one size: shingles, fingerprints, and tables from the value of a block of bits to items."""

    width: int
    ids: list = field(default_factory=list)
    grams: list[np.ndarray] = field(default_factory=list)

    def finish(self) -> Items:
        self.prints = np.array([fingerprint(signs(labelled(g[None])[0]).sum(axis=0, keepdims=True))[0] for g in self.grams], np.uint64)
        cuts = [BITS * k // (RADIUS + 1) for k in range(RADIUS + 2)]
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
        self.tables = []
        for shift, mask in self.blocks:
            table: dict[int, list[int]] = {}
            for i, value in enumerate(((self.prints >> shift) & mask).tolist()):
                table.setdefault(value, []).append(i)
            self.tables.append({v: np.array(i) for v, i in table.items()})
        self.every = np.unique(np.concatenate(self.grams))
        return self

    def near(self, print_: np.uint64) -> np.ndarray:
        """All items whose fingerprint differs in at most RADIUS bits."""
        found = [t.get(int((print_ >> shift) & mask)) for t, (shift, mask) in zip(self.tables, self.blocks)]
        found = [f for f in found if f is not None]
        if not found:
            return np.empty(0, np.int64)
        some = np.unique(np.concatenate(found))
        return some[np.bitwise_count(self.prints[some] ^ print_) <= RADIUS]


class Index:
    """Items by number of words."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.sizes: dict[int, Items] = {}
        for item_id, text in rows:
            words = words_of(text or "")
            if words:
                width = min(SHINGLE, len(words))
                items = self.sizes.setdefault(len(words), Items(width))
                items.ids.append(item_id)
                items.grams.append(shingles(word_hashes(words), width))
        for items in self.sizes.values():
            items.finish()
        of = {w: [i.every for i in self.sizes.values() if i.width == w] for w in range(1, SHINGLE + 1)}
        self.every = {w: np.unique(np.concatenate(v)) for w, v in of.items() if v}

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, first word, number of words, similarity) of the best window for each item found."""
        best: dict[int, tuple[int, int, int, float]] = {}
        grams, places = {}, {}
        for width, every in self.every.items():
            g = grams[width] = shingles(words, width)
            at = np.minimum(np.searchsorted(every, g), len(every) - 1)
            places[width] = np.flatnonzero(every[at] == g)
        for size, items in self.sizes.items():
            g, at = grams[items.width], places[items.width]
            # Shingles of a window: as many as the items', or all of a shorter document.
            n = min(size - items.width + 1, len(g))
            # common / (item + window - common) >= SIMILARITY needs so many shingles of items in the window
            need = int(np.ceil((size - items.width + 1 + n) * SIMILARITY / (1 + SIMILARITY) - 1e-9))
            if len(at) < need:
                continue
            mine = at[np.isin(g[at], items.every)]
            if len(mine) < need:
                continue
            # Windows with enough of them begin in reach of both ends of a run of `need`.
            lo, hi = np.maximum(0, mine[need - 1 :] - n + 1), np.minimum(mine[: len(mine) - need + 1], len(g) - n)
            starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)] or [lo]))
            if not len(starts):
                continue
            runs = np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1)
            for part in (run[k : k + WINDOW_SHINGLES] for run in runs for k in range(0, len(run), WINDOW_SHINGLES)):
                first = part[0]
                total = np.zeros((part[-1] + n - first + 1, BITS), np.int32)
                np.cumsum(signs(g[first : part[-1] + n]), axis=0, out=total[1:])
                prints = fingerprint(total[part - first + n] - total[part - first])
                # The sums hold a shingle as often as it occurs; windows with repeats are added up anew, labelled.
                before = last_before(g[first : part[-1] + n])
                again = np.concatenate([[0], np.cumsum(before >= 0)])
                mixed = np.flatnonzero(again[part - first + n] > again[part - first])
                step = max(1, WINDOW_SHINGLES // n)
                for some in (mixed[k : k + step] for k in range(0, len(mixed), step)):
                    rows = labelled(g[part[some, None] + np.arange(n)])
                    prints[some] = fingerprint(signs(rows.ravel()).reshape(len(some), n, BITS).sum(axis=1))
                for start, print_ in zip(part.tolist(), prints):
                    for i in items.near(print_):
                        alike = weighted_jaccard(g[start : start + n], items.grams[i])
                        item = items.ids[i]
                        if alike >= SIMILARITY and (item not in best or alike > best[item][3]):
                            best[item] = (item, start, min(size, len(words)), alike)
        return sorted(best.values(), key=lambda m: (m[1], str(m[0])))


def blocks(items: DataFrame) -> list[DataFrame]:
    """The items in blocks of bounded number and bytes; one for a benchmark of usual size."""
    items = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    n, size, longest = items.agg(F.count("*"), F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
    if not n:
        return []
    if longest > BLOCK_BYTES:
        raise ValueError(f"an item of {longest} bytes; at most {BLOCK_BYTES} are broadcast")
    parts = int(max(-(-n // BLOCK_ITEMS), -(-(2 * size) // BLOCK_BYTES)))
    return [items] if n == 1 or parts == 1 else [
        items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * parts)) == k) for k in range(2 * parts)
    ]


def _index(spark, block: DataFrame):
    return spark.sparkContext.broadcast(Index([tuple(r) for r in block.orderBy("item_id", "text").collect()]))


def _hashed(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    pieces = [words_of(t) for t in texts(batch)]
    hashes = word_hashes([w for p in pieces for w in p])
    end = 0
    for p in pieces:
        end += len(p)
        yield hashes[end - len(p) : end]


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): the best window per row of ``docs`` and item.

    Whole texts are searched. Null and empty texts and items match nothing; a repeated row gives its matches again;
    items with one text are all reported; other columns of either table may have any name.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, start_word int, n_words int, similarity double"
    narrow = with_text(docs, "text", "doc_id")
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(items):
        index = _index(docs.sparkSession, block)

        def run(batches: Iterable[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                rows = [(r, m) for r, words in enumerate(_hashed(batch)) for m in index.value.matches(words)]
                columns = list(zip(*(m for _, m in rows))) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([r for r, _ in rows], pa.int64())), pa.array(columns[0], kind),
                     pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.float64())],
                    ["doc_id", "item_id", "start_word", "n_words", "similarity"],
                )

        kind = to_arrow_type(items.schema["item_id"].dataType)
        out = out.unionByName(narrow.mapInArrow(run, schema))
    return out


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found.

    With more items than one block holds, what a block leaves is written before the next, so that tasks hold one block.
    """
    parts = blocks(items)
    for k, block in enumerate(parts):
        index = _index(docs.sparkSession, block)

        def run(batches: Iterable[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                yield batch.filter(pa.array([not index.value.matches(words) for words in _hashed(batch)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if k < len(parts) - 1:
            docs = stored(docs.sparkSession, docs, "clean-so-far")
    return docs
