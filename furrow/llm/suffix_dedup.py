"""Repeated byte strings: suffix arrays by two-stage sorting, over the places of the corpus that can be equal at all.

A window is ``width`` bytes that start somewhere in a text. Each window has an anchor, the place of the least hash of the
shorter runs inside it, so equal windows have equal anchors at equal distances. Consecutive windows whose anchor is the
same and whose distance lies in the same cell of distances make a piece; all of them hold the same core of bytes, and the
hash of the core is the key of the piece. Only windows of pieces with one key can be equal. So keys are counted first; equal
pieces of a key that occurs again are one piece with a number of times, and these meet, a bounded number of bytes together, in a
suffix array: suffixes that are smaller than their successors are sorted directly, all others are induced by scans over the
buckets of first bytes. Common prefixes of neighbours that reach ``width`` show the repeated windows.

A key with more than KINDS different pieces (a passage in very many texts, with other text on either side of each) would
be too much for one task. Its pieces are texts of the same search again, with smaller cells and so with longer cores.
At the last level a cell is one distance, a core is a window, and a key has one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .substring_dedup import sliding_min
from .text import BASES, mix, powers, slices, stored, with_text

WIDTH = 400
#: Bytes of the runs that anchors are chosen from.
RUN = 32
#: Most different pieces of one key in a suffix array, and bytes of pieces that make one.
KINDS, BUCKET_BYTES = 256, 1 << 20
#: Bytes of text hashed together; longer texts are hashed in parts that overlap by a window.
PART_BYTES = 1 << 20
#: Between pieces in a suffix array; no byte of UTF-8.
BETWEEN = 0xFF
#: Distances in a cell beyond the first level, where it is half of all.
CELLS = (16, 1)

BYTE_HASHES = mix(np.arange(1, 257, dtype=np.uint64))


def first_cell(width: int) -> int:
    """Half of the distances that an anchor can have from its window."""
    return -(-(width - min(RUN, width) + 1) // 2)


class Sums:
    """Sums of byte hashes times powers of a base, from which the hash of any stretch follows."""

    def __init__(self, data: np.ndarray, base: np.uint64) -> None:
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_HASHES[data] * powers(len(data), base), out=self.total[1:])
        self.back = powers(len(data) + 1, np.uint64(pow(int(base), -1, 1 << 64)))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.back[start])


def pieces(data: np.ndarray, ends: np.ndarray, width: int, cell: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, key, digest) of the pieces of consecutive texts; places count within ``data``."""
    run, core = min(RUN, width), width - cell + 1
    n = len(data) - width + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:n]
    at = np.arange(n)
    one = Sums(data, BASES[0])
    runs = one.hashes(np.arange(len(data) - run + 1), np.arange(run, len(data) + 1))
    # The least upper half of a hash, and of equal ones the leftmost: a choice that only the window's bytes decide.
    low = np.uint64(0xFFFFFFFF)
    anchor = (sliding_min((runs & ~low) | np.arange(len(runs), dtype=np.uint64), width - run + 1) & low).astype(np.int64)
    number = (anchor - at) // cell
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])]
    first = np.flatnonzero(new & (at + width <= ends[owner]))
    last = np.minimum(np.append(np.flatnonzero(new), n)[np.searchsorted(np.flatnonzero(new), first) + 1], ends[owner[first]] - width + 1)
    begin = anchor[first] - cell * number[first]
    key = mix(one.hashes(begin, begin + core) + number[first].astype(np.uint64))
    shape = ((last - first) * width + anchor[first] - first).astype(np.uint64)
    digest = mix(Sums(data, BASES[1]).hashes(first, last + width - 1) + mix(shape))
    return owner[first], first, last - first, key, digest


def _parts(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, bytes before, bytes, ends of rows) for the rows of a batch, or for one part of a long text at a time."""
    raw = batch.column("text").to_pylist()
    ends = np.cumsum([len(r) for r in raw])
    if len(raw) == 1 and len(raw[0]) > 2 * PART_BYTES:
        for at in range(0, max(1, len(raw[0]) - width + 1), PART_BYTES):
            part = raw[0][at : at + PART_BYTES + width - 1]
            yield 0, at, np.frombuffer(part, np.uint8), np.array([len(part)])
    elif len(raw):
        yield 0, 0, np.frombuffer(b"".join(raw), np.uint8), ends


def _cut(rows: DataFrame, width: int, cell: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PART_BYTES):
            for row, before, data, ends in _parts(batch, width):
                owner, first, n, key, digest = pieces(data, ends, width, cell)
                start = first + before - (ends - np.diff(ends, prepend=0))[owner]
                if len(owner):
                    of = pa.array(owner + row)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("row").take(of), batch.column("times").take(of), pa.array(start), pa.array(n, pa.int32()),
                         pa.array(key.view(np.int64)), pa.array(digest.view(np.int64))],
                        ["row", "times", "start", "n", "key", "digest"],
                    )

    return rows.select("row", "times", "text").mapInArrow(run, "row long, times long, start long, n int, key long, digest long")


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        out |= padded[k : k + len(out)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def sort_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the suffixes there, by ``depth`` bytes at least; what is equal so far keeps its order.

    Groups of equal ones look at eight bytes more in each round; only groups that differ there are sorted.
    """
    words = np.append(words, np.zeros(depth, np.uint64))
    places = places[np.argsort(words[places], kind="stable")]
    word = words[places]
    active, at = np.arange(len(places)), places
    new = np.append(True, word[1:] != word[:-1])[: len(places)]
    first = np.flatnonzero(new)
    for step in range(8, depth, 8):
        sizes = np.diff(first, append=len(active))
        if (sizes == 1).any():  # these are in place
            tied = np.repeat(sizes > 1, sizes)
            active, new = active[tied], new[tied]
            at = places[active]
            first = np.flatnonzero(new)
            sizes = np.diff(first, append=len(active))
        if not len(active):
            break
        word = words[at + step]
        breaks = np.flatnonzero((word[1:] != word[:-1]) & ~new[1:])
        if not len(breaks):
            continue
        differs = np.zeros(len(first), bool)
        differs[np.searchsorted(first, breaks, "right") - 1] = True
        some = np.flatnonzero(np.repeat(differs, sizes))
        group = np.repeat(np.arange(len(first)), sizes)[some]
        order = np.lexsort((word[some], group))
        places[active[some]] = at[some[order]]
        at = places[active]
        group, word = group[order], word[some[order]]
        new[some] = np.append(True, (group[1:] != group[:-1]) | (word[1:] != word[:-1]))
        first = np.flatnonzero(new)
    return places


def suffix_array(data: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """Places of all suffixes in their order, right by ``depth`` bytes at least: two-stage sorting.

    A suffix that is smaller than its successor is sorted directly. Any other one follows from its successor: the
    buckets of first bytes are scanned in ascending order, and each suffix met puts the one before it, if that is greater, at
    the end of what its bucket has so far. In a bucket induced suffixes come before directly sorted ones.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    words = words_at(data) if words is None else words
    # A run of equal bytes is as its last byte is; the end of the data is smaller than any byte.
    differs = np.append(data[:-1] != data[1:], True)
    turn = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    follows = np.append(data, 0)
    smaller = (turn < n - 1) & (data[turn] < follows[turn + 1])
    direct = sort_directly(np.flatnonzero(smaller), words, depth)
    cuts = np.searchsorted(data[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[data[-1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        bucket, some = [], np.concatenate(induced[byte]) if induced[byte] else np.empty(0, np.int64)
        while len(some):
            bucket.append(some)
            some = some[some > 0] - 1
            some = some[data[some] == byte]
        bucket.append(direct[cuts[byte] : cuts[byte + 1]])
        met = np.concatenate(bucket)
        out.append(met)
        before = met[met > 0] - 1
        before = before[data[before] > byte]
        first = data[before]
        before = before[np.argsort(first, kind="stable")]
        edges = np.searchsorted(np.sort(first), np.arange(257)) if len(first) else None
        if edges is not None:
            for other in np.unique(first).tolist():
                induced[other].append(before[edges[other] : edges[other + 1]])
    return np.concatenate(out)


def common_prefixes(places: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the suffixes at neighbouring places begin with in common, ``most`` at most."""
    end = len(words) - 1
    out = np.full(max(0, len(places) - 1), most, np.int64)
    alive = np.arange(len(out))
    for step in range(0, most, 8):
        a, b = (words[np.minimum(places[alive + k] + step, end)] for k in (0, 1))
        other = a ^ b
        ends = other != 0
        same = sum((other[ends] < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8))
        out[alive[ends]] = np.minimum(step + same, most)
        alive = alive[~ends]
    return out


def repeats(texts: list[bytes], windows: np.ndarray, times: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, from, to): ranges of windows that occur more than once among pieces that occur ``times`` each."""
    data = np.frombuffer(b"".join(t + bytes([BETWEEN]) for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    words = words_at(data)
    order = suffix_array(data, width, words)
    piece = np.repeat(np.arange(len(texts)), sizes)
    order = order[(order - begins[piece[order]]) < windows[piece[order]]]
    new = np.append(True, common_prefixes(order, words, width) < width) if len(order) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    found = np.sort(order[np.bincount(group, times[piece[order]])[group] > 1])
    if not len(found):
        return (np.empty(0, np.int64),) * 3
    breaks = np.r_[True, (found[1:] != found[:-1] + 1) | (piece[found[1:]] != piece[found[:-1]])]
    a, b = found[breaks], found[np.append(np.flatnonzero(breaks)[1:], len(found)) - 1] + 1
    return piece[a], a - begins[piece[a]], b - begins[piece[a]]


def _taken(rows: DataFrame, width: int) -> DataFrame:
    """(key, digest, times, crowded, n, bytes) of each mark in ``rows``: the bytes of a piece."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PART_BYTES):
            marks = batch.column("marks")
            flat = marks.flatten()
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(marks).to_numpy())
            starts, n = (pc.struct_field(flat, c) for c in ("start", "n"))
            raw = batch.column("text").to_pylist()
            some = [raw[o][a : a + m + width - 1] for o, a, m in zip(owner.tolist(), starts.to_pylist(), n.to_pylist())]
            kept = [pc.struct_field(flat, c) for c in ("key", "digest", "times", "crowded")]
            yield pa.RecordBatch.from_arrays([*kept, n, pa.array(some, pa.binary())], ["key", "digest", "times", "crowded", "n", "bytes"])

    return rows.select("text", "marks").mapInArrow(run, "key long, digest long, times long, crowded boolean, n int, bytes binary")


def _in_suffix_arrays(some: DataFrame, width: int) -> DataFrame:
    """(key, digest, low, high): ranges of repeated windows of each piece, found in suffix arrays of bounded bytes."""

    def run(group: pa.Table) -> pa.Table:
        texts = group.column("bytes").to_pylist()
        windows, times = (group.column(c).to_numpy() for c in ("n", "times"))
        piece, low, high = repeats(texts, windows, times, width)
        taken = group.select(["key", "digest"]).take(pa.array(piece))
        return pa.table([*taken.columns, pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=["key", "digest", "low", "high"])

    size = some.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    dealt = some.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-size // BUCKET_BYTES)))))
    return dealt.groupBy("bucket").applyInArrow(run, "key long, digest long, low int, high int")


def find(rows: DataFrame, width: int, cells: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """Where windows of ``rows`` (row, times, text) occur again; a text counts ``times`` times.

    The pieces that may hold some, (key, digest, row, start), and the ranges of repeated windows in each kind of them,
    (key, digest, ranges). Both are stored, as all tables between the steps are, so that joins can split a frequent key.
    """
    spark = rows.sparkSession
    cut = stored(spark, _cut(rows, width, cells[0]), "suffix-pieces")
    again = stored(spark, cut.groupBy("key").agg(F.sum("times").alias("all")).where("all > 1").select("key"), "suffix-keys")
    hits = stored(spark, cut.join(again, "key"), "suffix-hits")
    kinds = hits.groupBy("key", "digest").agg(F.sum("times").alias("times"), F.min(F.struct("row", "start", "n")).alias("one"))
    kinds = stored(spark, kinds, "suffix-kinds")
    crowded = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where(F.col("kinds") > KINDS if len(cells) > 1 else F.lit(False))
    crowded = stored(spark, crowded.select("key", F.lit(True).alias("crowded")), "suffix-crowded")
    mark = F.struct("key", "digest", "times", F.coalesce("crowded", F.lit(False)).alias("crowded"), F.col("one.start").alias("start"), F.col("one.n").alias("n"))
    marks = kinds.join(crowded, "key", "left").groupBy(F.col("one.row").alias("row")).agg(F.collect_list(mark).alias("marks"))
    taken = stored(spark, _taken(rows.join(stored(spark, marks, "suffix-marks"), "row"), width), "suffix-taken")
    found = _in_suffix_arrays(taken.where(~F.col("crowded")), width)
    if not crowded.isEmpty():
        apart = taken.where("crowded").select(F.xxhash64("key", "digest").alias("row"), "times", F.col("bytes").alias("text"), "key", "digest")
        inner, ranges = find(apart, width, cells[1:])
        spans = inner.join(ranges, ["key", "digest"]).select("row", "start", F.explode("ranges").alias("r"))
        spans = spans.select("row", (F.col("start") + F.col("r.low")).cast("int").alias("low"), (F.col("start") + F.col("r.high")).cast("int").alias("high"))
        found = found.unionByName(spans.distinct().join(apart.select("row", "key", "digest").distinct(), "row").drop("row"))
    ranges = found.groupBy("key", "digest").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    return hits.select("key", "digest", "row", "start"), stored(spark, ranges, "suffix-ranges")


def deduplicate(docs: DataFrame, width: int = WIDTH, digest: bool = False) -> DataFrame:
    """Per row doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept, the bytes that are left (binary).

    A byte goes if ``width`` bytes over it occur anywhere else, in its own or any other row, overlaps included; all are
    judged on the input, so no copy stays. Texts are UTF-8; what is left need not be. Null and empty texts have no
    bytes. A repeated row is a repeat of itself. With ``digest`` the column kept_sha256 takes the place of kept. Rows are told
    apart by 64 bits of id and text, equal pieces by 128 bits; windows are compared byte by byte. Of ``docs`` only doc_id and
    text are looked at.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_text(docs, "text", "doc_id").select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("binary").alias("text"))
    hits, ranges = find(rows.select("row", F.lit(1).cast("long").alias("times"), "text"), width, (first_cell(width), *CELLS))
    spans = hits.join(ranges, ["key", "digest"]).groupBy("row").agg(F.collect_set(F.struct("start", "ranges")).alias("spans"))
    return _second(rows.join(stored(spark, spans, "suffix-spans"), "row", "left"), width, kind, digest)


def removed(size: int, spans: Iterable[tuple[int, int]]) -> tuple[np.ndarray, int]:
    """Which bytes the spans cover, and in how many maximal runs."""
    edges = np.zeros(size + 1, np.int64)
    for a, b in spans:
        edges[a] += 1
        edges[b] -= 1
    gone = np.cumsum(edges[:-1]) > 0
    return gone, int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))


def _second(rows: DataFrame, width: int, kind: str, digest: bool) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PART_BYTES):
            columns: list[list] = [[], [], [], []]
            for raw, marks in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                each = ((m["start"] + r["low"], m["start"] + r["high"] + width - 1) for m in marks or () for r in m["ranges"])
                gone, n = removed(len(raw), each)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                for column, value in zip(columns, (len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest() if digest else kept)):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string() if digest else pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"]
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, {names[-1]} {'string' if digest else 'binary'}"
    return rows.select("doc_id", "text", "spans").mapInArrow(run, schema)
