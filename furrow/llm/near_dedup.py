"""Near duplicates: order MinHash proposes pairs, a banded alignment of their shingles confirms them.

A document is the sequence of its shingles of five words, each labelled with how often it has occurred before. Every one
of SKETCHES random orders picks the three least labelled shingles and keeps them in text order, so that documents agree
in a sketch if they share those shingles and their order. Documents with one sketch value form a group; its members are
compared with two of them, and where that does not connect the group, with each other: a bound from bit signatures that
loses nothing comes first, and only pairs that are not yet connected are aligned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BASES, mix, slices, stored, texts, window_hashes, with_text, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Random orders, and shingles that each of them picks.
SKETCHES, PICKED = 24, 3
#: Members of a group, and their words, that a task compares with as many others; most bits of a signature.
BLOCK, BLOCK_WORDS, MOST_BITS = 1024, 1 << 20, 1 << 16

SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * BASES[1])
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of five words each; a shorter text is one shingle, an empty one has none."""
    if len(words) >= SHINGLE:
        return window_hashes(words, SHINGLE)
    return mix(window_hashes(words, len(words)) + np.uint64(len(words))) if len(words) else words


def labelled(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Each value together with the number of equal ones before it in the same document."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    starts = np.r_[True, (v[1:] != v[:-1]) | (o[1:] != o[:-1])] if len(v) else np.empty(0, bool)
    at = np.arange(len(v))
    count = at - np.maximum.accumulate(np.where(starts, at, 0)) if len(v) else at
    out = values.copy()
    out[order] = np.where(count > 0, mix(v + mix(count.astype(np.uint64))), v)
    return out


def sketches(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of SKETCHES hashes per document; ``sizes`` (all above 0) cut the labelled shingles into documents."""
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values))
    out = np.empty((len(sizes), SKETCHES), np.uint64)
    for s, seed in enumerate(SEEDS):
        h = mix(values ^ seed)
        places = np.empty((len(sizes), PICKED), np.int64)
        for p in range(PICKED):
            low = np.minimum.reduceat(h, starts)
            is_low = h == low[owner]
            places[:, p] = np.minimum.reduceat(np.where(is_low, at, len(values)), starts)
            h[places[:, p]] = NONE
        # Once a document has no shingle left its first one comes again, which is harmless: the same for its copies.
        picked = values[np.sort(places, axis=1)]
        code = np.full(len(sizes), seed)
        for p in range(PICKED):
            code = mix(code ^ picked[:, p])
        out[:, s] = code
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """(key, n, sketches) per row of ``docs`` with columns key and text; texts without a word are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            pieces = [t.lower().split() for t in texts(batch)]
            has = np.array([len(p) > 0 for p in pieces], bool)
            if not has.any():
                continue
            hashes = word_hashes([w for p in pieces for w in p])
            ends = np.cumsum([len(p) for p in pieces])
            grams = [shingles(hashes[e - len(p) : e]) for p, e in zip(pieces, ends) if p]
            sizes = np.array([len(g) for g in grams], np.int64)
            values = labelled(np.concatenate(grams), np.repeat(np.arange(len(sizes)), sizes))
            rows = sketches(values, sizes).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").filter(pa.array(has)), pa.array(sizes, pa.int32()), pa.array(list(rows), pa.list_(pa.int64()))],
                ["key", "n", "sketches"],
            )

    return docs.select("key", "text").mapInArrow(run, "key binary, n int, sketches array<bigint>")


def aligned(a: np.ndarray, b: np.ndarray) -> float:
    """Share of shingles that an alignment of two documents keeps: common ones in one order, over all distinct places.

    ``a`` and ``b`` are labelled shingles, so no value repeats. If the similarity reaches the threshold, at most
    a fifth of the longer document is unmatched, and matched places differ by no more than that: only this band is
    looked at, and there the longest common subsequence is a longest ascending one.
    """
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    longer = max(len(a), len(b))
    order = np.argsort(i)
    i, j = i[order], j[order]
    band = np.abs(i - j) <= longer - int(np.ceil(SIMILARITY * longer))
    j = j[band]
    if len(j) * (1 + SIMILARITY) < SIMILARITY * (len(a) + len(b)):
        return len(j) / (len(a) + len(b) - len(j)) if len(a) else 0.0  # not enough even in any order
    if len(j) and not (j[1:] > j[:-1]).all():
        ends = np.empty(len(j), np.int64)  # least end of an ascending sequence by its length
        n = 0
        for x in j:
            k = int(np.searchsorted(ends[:n], x))
            ends[k] = x
            n = max(n, k + 1)
    else:
        n = len(j)
    return n / (len(a) + len(b) - n) if n else 0.0


def _words(docs: DataFrame) -> DataFrame:
    """(key, words): 32-bit word hashes of each text, as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            pieces = [t.lower().split() for t in texts(batch)]
            hashes = (word_hashes([w for p in pieces for w in p]) >> np.uint64(32)).astype(np.uint32)
            ends = np.cumsum([len(p) for p in pieces]).tolist()
            out = [hashes[e - len(p) : e].tobytes() for p, e in zip(pieces, ends)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], ["key", "words"])

    return docs.select("key", "text").mapInArrow(run, "key binary, words binary")


def _shingles_of(raw: bytes) -> np.ndarray:
    grams = shingles(mix(np.frombuffer(raw, np.uint32).astype(np.uint64)))
    return labelled(grams, np.zeros(len(grams), np.int64))


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b, group) whose alignment reaches SIMILARITY, with ``similarity``; the rest with null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column("wa"), batch.column("wb")
            out = [aligned(_shingles_of(one[r].as_py()), _shingles_of(two[r].as_py())) for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    both = pairs.join(words.withColumnsRenamed({"key": "a", "words": "wa"}), "a").join(words.withColumnsRenamed({"key": "b", "words": "wb"}), "b")
    return both.select("a", "b", "wa", "wb").mapInArrow(run, "a binary, b binary, similarity double")


def _leaders(members: DataFrame) -> DataFrame:
    """(bucket, key, n, leader, size of leader): each member with the least and the greatest key of its bucket."""
    low, high = F.min(F.struct("key", "n")), F.max(F.struct("key", "n"))
    groups = members.groupBy("bucket").agg(low.alias("low"), high.alias("high")).where("low.key <> high.key")
    lead = F.posexplode(F.array("low", "high")).alias("rank", "lead")
    both = members.join(groups, "bucket").select("bucket", "place", "key", "n", lead)
    return both.select("bucket", "place", "key", "n", "rank", F.col("lead.key").alias("leader"), F.col("lead.n").alias("m")).where("key <> leader")


def _could_match() -> Column:
    """The shorter of two documents has at least four fifths of the longer one's shingles."""
    return F.least("n", "m") >= F.lit(SIMILARITY) * F.greatest("n", "m")


def _pairs(candidates: DataFrame) -> DataFrame:
    pairs = candidates.where(_could_match())
    return pairs.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct()


def signatures(grams: list[np.ndarray]) -> np.ndarray:
    """One row of bits per document, each the parity of the shingles that fall on it.

    Two rows differ in no more bits than the documents have shingles that only one of them holds.
    """
    bits = min(max(512, 1 << (8 * max(map(len, grams)) - 1).bit_length()), MOST_BITS)
    out = np.zeros((len(grams), bits // 64), np.uint64)
    for row, g in zip(out, grams):
        odd = np.bincount((mix(g) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        row[:] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    return out


def _rest(group: pa.Table) -> pa.Table:
    """Links between the members of one block, or of two different ones, that are not connected by others."""
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    keys, own = group.column("key").to_pylist(), group.column("block").to_numpy()
    grams = [_shingles_of(raw) for raw in group.column("words").to_pylist()]
    sizes = np.array([len(g) for g in grams])
    parts = group.column("part").to_numpy().copy()  # 0 and 1: connected by a leader
    parts[parts > 1] = np.arange(2, 2 + (parts > 1).sum())
    signs = signatures(grams)
    out = []
    for r in range(len(keys)):
        total = sizes[r] + sizes[r + 1 :]
        other = (parts[r + 1 :] != parts[r]) & (np.minimum(sizes[r], sizes[r + 1 :]) >= SIMILARITY * np.maximum(sizes[r], sizes[r + 1 :]))
        if i != j:
            other &= own[r + 1 :] != own[r]
        at = np.flatnonzero(other)
        differ = np.bitwise_count(signs[r + 1 + at] ^ signs[r]).sum(axis=1, dtype=np.int64)
        # At the threshold, (1 - s) / (1 + s) of all shingles are in one document only.
        for x in (at[differ <= (1 - SIMILARITY) / (1 + SIMILARITY) * total[at] + 1e-6] + r + 1).tolist():
            if parts[x] != parts[r] and (alike := aligned(grams[r], grams[x])) >= SIMILARITY:
                out.append((min(keys[r], keys[x]), max(keys[r], keys[x]), alike))
                parts[parts == parts[x]] = parts[r]
    columns = list(zip(*out)) or [(), (), ()]
    return pa.table([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.float64())], names=["a", "b", "similarity"])


def rest(candidates: DataFrame, first: DataFrame, words: DataFrame) -> DataFrame:
    """(a, b, similarity): what connects the members of the groups that the leaders leave in several parts.

    All members meet, in pairs of bounded blocks. Part 0 and 1 are those connected with the least and the greatest key
    (0 for both where something connects these), part 2 stands for a member of its own.
    """
    pair = candidates.select("bucket", "place", "key", "n", "rank", F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b"))
    matched = pair.join(first.select("a", "b", F.lit(1).alias("ok")), ["a", "b"], "left").groupBy("bucket", "place", "key")
    # A leader is not compared with itself: without a row for a rank it is the leader of that rank.
    is_with = lambda rank: F.count(F.when(F.col("rank") == rank, F.coalesce("ok", F.lit(0)))) == F.count(F.when((F.col("rank") == rank) & (F.col("ok") == 1), 1))
    spark = candidates.sparkSession
    members = stored(spark, matched.agg(F.first("n").alias("n"), is_with(0).alias("low"), is_with(1).alias("high")), "near-members")
    groups = members.groupBy("bucket", "place").agg(
        F.count("*").alias("size"), F.sum("n").alias("sum"), F.max(F.col("low") & F.col("high")).alias("one"),
        F.max(~F.col("low") & ~F.col("high")).alias("lone"),
    )
    # The leaders have met all others, so that three members leave nothing to compare.
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("sum") / BLOCK_WORDS)).cast("int")
    open_ = stored(spark, groups.where("size > 3 and (lone or not one)").select("bucket", "place", "one", blocks.alias("blocks")), "near-open")
    part = F.when(F.col("low"), 0).when(F.col("high"), F.when(F.col("one"), 0).otherwise(1)).otherwise(2)
    dealt = members.join(open_, ["bucket", "place"]).select(
        "bucket", "place", "key", part.alias("part"), "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")
    )
    met = dealt.join(words, "key").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", "place", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "key", "part", "block", "words"
    )
    return met.groupBy("bucket", "place", "i", "j").applyInArrow(_rest, "a binary, b binary, similarity double")


def links(docs: DataFrame) -> DataFrame:
    """(a, b, similarity): pairs of different texts found alike, by key. ``docs`` has columns key and text.

    They connect, directly or through others, all texts that are alike and agree in a sketch. First every member of
    a group is compared with its two leaders; in groups that this leaves in parts, all members of different parts are.
    """
    spark = docs.sparkSession
    known = stored(spark, sketch(docs).groupBy("key").agg(F.first("n").alias("n"), F.first("sketches").alias("sketches")), "near-sketches")
    places = known.select("key", "n", "sketches", F.posexplode("sketches").alias("place", "bucket"))
    candidates = stored(spark, _leaders(places.select("key", "n", "place", "bucket")), "near-candidates")
    needed = candidates.select("key").union(candidates.select(F.col("leader"))).distinct()
    texts_needed = docs.join(needed, "key", "left_semi")
    words = stored(spark, _words(texts_needed).groupBy("key").agg(F.first("words").alias("words")), "near-words")
    first = stored(spark, verified(_pairs(candidates), words).where(F.col("similarity") >= SIMILARITY), "near-links")
    return first.unionByName(rest(candidates, first, words).distinct())


def components(pairs: DataFrame) -> DataFrame:
    """(key, root): the least key of each connected component, for all keys in the pairs (a, b).

    Each round points every node to the least node it has seen (large star), then contracts chains (small star);
    rounds end when nothing moves, after about as many as the logarithm of the longest chain.
    """

    def star(edges: DataFrame, is_large: bool) -> DataFrame:
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
        if is_large:
            ends = ends.union(edges.select("b", "a"))
        else:
            ends = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
        low = ends.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("low"))
        moved = ends.join(low, "node")
        if is_large:
            moved = moved.where("other > node").select(F.col("low").alias("a"), F.col("other").alias("b"))
        else:
            moved = moved.select(F.col("low").alias("a"), F.col("other").alias("b")).union(low.select(F.col("low"), F.col("node")))
        return moved.where("a <> b").distinct()

    spark = pairs.sparkSession
    edges = stored(spark, pairs.select("a", "b").distinct(), "near-edges")
    state = None
    while True:
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return edges.select(F.col("b").alias("key"), F.col("a").alias("root"))
        state = new
        edges = stored(spark, star(star(edges, True), False), "near-edges")


def classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, key, root): root is the key of one text of the class.

    Equal texts have equal keys (MD5 of the text) and are one class from the start; null counts as empty, and all texts
    without a word but equal ones stay apart. Repeated rows are in one class; ids may be null or repeated.
    """
    keyed = with_text(docs, "text", "doc_id").select("doc_id", "text", F.unhex(F.md5("text")).alias("key"))
    roots = components(links(keyed))
    ids = keyed.select("doc_id", "key")
    return ids.join(roots, "key", "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))


def report(docs: DataFrame) -> DataFrame:
    """Per row doc_id, class_id (the least doc_id of the class, null if none has one) and class_size."""
    found = stored(docs.sparkSession, classes(docs).select("doc_id", "root"), "near-classes")
    # Stored, so that the join reads both sides from a shuffle and can split a large class.
    sizes = stored(docs.sparkSession, found.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "near-sizes")
    return found.join(sizes, "root").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose class has a row with a smaller doc_id.

    An id comes before a null; ties go to the smaller key, and of rows alike in id and text one stays.
    """
    found = stored(docs.sparkSession, classes(docs), "near-classes")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    best = found.groupBy("root").agg(F.min(rank).alias("best"))
    times = found.groupBy("root", "doc_id", "key").agg(F.count("*").alias("times")).join(best, "root")
    stays = times.where(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key") == F.col("best")).select(
        F.col("best.doc_id").alias("stays_id"), F.col("best.key").alias("stays_key"), "times"
    )
    keyed = docs.select(F.struct("*").alias("row"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("key"))
    kept = keyed.join(stays, (keyed["key"] == stays["stays_key"]) & keyed["row.doc_id"].eqNullSafe(stays["stays_id"]))
    once = kept.where("times = 1").select("row.*")
    return once.union(kept.where("times > 1").dropDuplicates(["stays_key"]).select("row.*"))
