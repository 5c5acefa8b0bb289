"""Alignment of two tokenizers: which tokens of one cover the bytes of which tokens of the other.

Both token sequences of a text cover the same bytes. Byte offsets at which a token of A and a token of B both end cut
them into groups, and within a group every token of A is linked with every token of B. The merge runs in lockstep: one
vector holds the pointers of all texts of a batch, every step moves each text's pointer that is behind (or both, at a
cut), emits the links of the token that was met, and drops texts that are finished. Long texts are dealt into several
lanes of the vector, so that none holds up its batch.

How many documents hold a pair of ids linked is counted in two levels, per task and by a shuffle of what tasks counted.
The counts go back to the documents in parts of bounded size.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .text import slices, stored, with_text

#: Bytes of text aligned together, and tokens of A that one lane of the merge holds.
SLICE_BYTES, LANE = 1 << 20, 512
#: Texts are tokenized by chunks, between single spaces, which no token of either kind reaches across. A task remembers so many
#: chunks of so many characters at most; what it encodes together has about so many characters.
REMEMBERED, CHUNK, PART_CHARS = 300_000, 64, 1 << 18
#: A group with more links is counted by its distinct ids and their numbers, instead of link by link.
WIDE = 1 << 12
#: Pairs a task counts before it gives them out, and pairs whose counts every task holds at a time.
COUNTED, HELD = 1 << 20, 4_000_000
#: Ids are below ROOM, so that a pair of ids is one number, and so is a pair with the place of its text among ROWS.
ROOM, ROWS = 1 << 24, 1 << 14


def bounded(texts: list[str], limit: int = PART_CHARS) -> Iterator[list[str]]:
    """The texts in lists of about ``limit`` characters, as the libraries hold much more than the ids of what they encode."""
    part = np.cumsum(list(map(len, texts))) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield texts[a:b]


class Bytewise:
    """A: byte-level BPE from a ``tokenizers`` file; special tokens in texts are plain text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.no_truncation()
        self.model.no_padding()
        value = {letter: b for b, letter in enumerate(byte_letters())}
        names = self.model.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes[i] = bytes(value[c] for c in name) if all(c in value for c in name) else name.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for some in bounded(texts) for e in self.model.encode_batch_fast(some, add_special_tokens=False)]


class Piecewise:
    """B: a sentencepiece model; it puts a space in front of a text."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [
            bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids for some in bounded(texts) for ids in self.model.encode(some, num_threads=1)]


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> tuple[Bytewise, Piecewise]:
    return tuple(kind(p if "/" in p else SparkFiles.get(p)) for kind, p in ((Bytewise, path_a), (Piecewise, path_b)))


#: A single space between two other characters.
GAP = re.compile(r" (?=\S)(?<=\S )")


def chunks(text: str) -> list[str]:
    """The text between its gaps: A's tokens of space + text are those of space + chunk in turn, and B's those of the chunks."""
    return GAP.split(text) if text else []


@dataclass
class Tokens:
    """The tokens of all texts of a batch in one row: ids, byte offsets of their ends, and where each text's begin."""

    ids: np.ndarray
    ends: np.ndarray
    starts: np.ndarray


class Side:
    """The ids of the chunks a task has met, in one row."""

    def __init__(self, kind: Bytewise | Piecewise) -> None:
        self.kind = kind
        self.space = " " if isinstance(kind, Bytewise) else ""  # B adds its own
        self.sizes = np.array([len(x) for x in kind.bytes], np.int64)
        self.ids, self.n = np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, plain: list[str], odd: list[str]) -> np.ndarray:
        """Adds the ids of chunks; whether they give the bytes of space + chunk. Plain ones are encoded as one text."""
        found = [self._together(some) or self._singly(some) for some in bounded(plain)]
        found += [self._singly(some) for some in bounded(odd)]
        ids, n, same = zip(*found)
        self.ids, self.n = np.concatenate([self.ids, *ids]), np.concatenate([self.n, *n])
        return np.concatenate(same)

    def _together(self, group: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        text = " ".join(group)
        found = self.kind.encode([self.space + text])[0]
        if b"".join(map(self.kind.bytes.__getitem__, found)) != b" " + text.encode():
            return None
        ids = np.array(found, np.int64)
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([1 + len(g.encode()) for g in group])) + 1
        return ids, np.diff(ends, prepend=0), np.ones(len(group), bool)

    def _singly(self, group: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.kind.encode([self.space + g for g in group])
        same = [b"".join(map(self.kind.bytes.__getitem__, f)) == b" " + g.encode() for f, g in zip(found, group)]
        return np.array(list(chain.from_iterable(found)), np.int64), np.array(list(map(len, found)), np.int64), np.array(same, bool)

    def row(self, codes: np.ndarray, owner: np.ndarray, n_texts: int) -> Tokens:
        """The tokens of chunks by their codes; ``owner`` is the text of each."""
        n = self.n[codes]
        run, place = _spread(n)
        ids = self.ids[(np.cumsum(self.n) - self.n)[codes][run] + place]
        starts = np.concatenate([[0], np.cumsum(np.bincount(owner, n, n_texts))]).astype(np.int64)
        return Tokens(ids, np.cumsum(self.sizes[ids]), starts)


class Encoder:
    """Both tokenizers, and what a task remembers of them."""

    def __init__(self, a: Bytewise, b: Piecewise) -> None:
        self.kinds = a, b
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.sides = [Side(kind) for kind in self.kinds]
        self.same = np.empty(0, bool)

    def tokens(self, texts: list[str | None]) -> tuple[Tokens, Tokens]:
        """Tokens of space + text; a text whose bytes either tokenizer changes has none, and neither has an empty one."""
        pieces = [chunks(t or "") for t in texts]
        if len(self.code) > REMEMBERED:
            self.forget()
        flat = list(chain.from_iterable(pieces))
        # Only the first and the last chunk of a text can begin or end with white space, and so be none between spaces.
        odd = {p for some in pieces if some for p in (some[0], some[-1]) if p.strip() != p}
        new = set(flat).difference(self.code)
        brief = [p for p in new if len(p) <= CHUNK]
        long = list(new.difference(brief)) if len(brief) < len(new) else []  # forgotten after this batch
        for some in (brief, long):
            plain = [p for p in some if p not in odd]
            strange = [p for p in some if p in odd] if len(plain) < len(some) else []
            if some:
                self.code.update(zip(plain + strange, range(len(self.code), len(self.code) + len(some))))
                same = [side.learn(plain, strange) for side in self.sides]
                self.same = np.concatenate([self.same, same[0] & same[1]])
        codes = np.array(list(map(self.code.__getitem__, flat)), np.int64)
        owner = np.repeat(np.arange(len(texts)), list(map(len, pieces)))
        changed = np.bincount(owner[~self.same[codes]], minlength=len(texts)) > 0
        kept = ~changed[owner]
        a, b = (side.row(codes[kept], owner[kept], len(texts)) for side in self.sides)
        for chunk in long:
            del self.code[chunk]
        keep = len(self.code)
        for side in self.sides:
            side.n = side.n[:keep]
            side.ids = side.ids[: side.n.sum()]
        self.same = self.same[:keep]
        return a, b


@dataclass
class Merged:
    """What the merge emits. Links as runs: (text, a from, to, b from, to), one of the two ranges holds one token.

    Cuts as (text, a, b): the first tokens of A and B behind the cut. Places count within the row of all texts.
    """

    links: np.ndarray
    cuts: np.ndarray


def merge(a: Tokens, b: Tokens, lane: int = LANE) -> Merged:
    """Groups and links of all texts of a batch, in lockstep.

    A lane begins at every ``lane`` th token of A. It emits nothing until its first cut (the lane before it
    still does), and goes on beyond its last token until a cut, so that every group is emitted by one lane.
    """
    n = np.diff(a.starts)
    lanes = -(-n // lane)
    text = np.repeat(np.arange(len(n)), lanes)
    if not len(text):
        return Merged(np.empty((0, 5), np.int64), np.empty((0, 3), np.int64))
    number = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    # Offsets count from the first text on, in the same way for A and B, as both cover the same bytes.
    ia = a.starts[text] + number * lane
    begin = np.where(ia > 0, a.ends[ia - 1], 0)
    ib = np.searchsorted(b.ends, begin, "right")
    before = np.where(ib > 0, b.ends[ib - 1], 0)
    last = np.minimum(ia + lane, a.starts[text + 1])  # cuts from here on belong to the next lane
    open_ = before == begin  # the lane begins at a cut
    ga, gb = ia.copy(), ib.copy()  # first tokens of the group
    links, cuts = [], []

    def emit(mask: np.ndarray, a0, a1, b0, b1) -> None:
        links.append(np.column_stack([text[mask], a0[mask], a1[mask], b0[mask], b1[mask]]))

    emit(open_, ia, ia + 1, ib, ib + 1)
    while len(ia):
        end_a, end_b = a.ends[ia], b.ends[ib]
        cut = end_a == end_b
        ia = ia + (end_a <= end_b)
        ib = ib + (end_b <= end_a)
        if cut.any():
            ga, gb = np.where(cut, ia, ga), np.where(cut, ib, gb)
            closed = cut & open_
            cuts.append(np.column_stack([text[closed], ia[closed], ib[closed]]))
            open_ = open_ | cut
            done = cut & (ia >= last)
            if done.any():
                stay = ~done
                text, ia, ib, ga, gb, last, open_, end_a, end_b = (x[stay] for x in (text, ia, ib, ga, gb, last, open_, end_a, end_b))
        by_a = open_ & (end_a <= end_b)  # a new token of A, alone or with the first one of B
        by_b = open_ & (end_a > end_b)
        emit(by_a, ia, ia + 1, gb, ib + 1)
        emit(by_b, ga, ia + 1, ib, ib + 1)
    cuts = np.concatenate(cuts)
    return Merged(np.concatenate(links), cuts[np.lexsort((cuts[:, 1], cuts[:, 0]))])


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of such lengths the number of the run and the place inside it, run by run."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys added up, ascending."""
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    if not len(keys):
        return keys, times
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(times, first)


def linked(found: Merged, a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair of ids, links) of each text's distinct pairs, from the runs of links.

    The runs of groups with more than WIDE links are not written out: their ids are counted on either side first.
    """
    runs, cuts = found.links, found.cuts
    # The group of a run: how many cuts lie before its first token of A, over all texts.
    order = np.searchsorted(cuts[:, 1], runs[:, 1], "right")
    size = (runs[:, 2] - runs[:, 1]) * (runs[:, 4] - runs[:, 3])
    wide = np.bincount(order, size, len(cuts) + 1) > WIDE
    some = runs[~wide[order]]
    run, place = _spread((some[:, 2] - some[:, 1]) * (some[:, 4] - some[:, 3]))
    across = (some[:, 4] - some[:, 3])[run]
    pair = a.ids[some[run, 1] + place // across] * ROOM + b.ids[some[run, 3] + place % across]
    out = [np.unique(some[run, 0] * ROOM**2 + pair, return_counts=True)]
    first = np.vstack([np.zeros((1, 2), np.int64), cuts[:-1, 1:]])
    for g in np.flatnonzero(wide).tolist():
        (a0, b0), (t, a1, b1) = first[g].tolist(), cuts[g].tolist()
        ids_a, n_a = np.unique(a.ids[a0:a1], return_counts=True)
        ids_b, n_b = np.unique(b.ids[b0:b1], return_counts=True)
        out.append((t * ROOM**2 + (ids_a[:, None] * ROOM + ids_b).ravel(), (n_a[:, None] * n_b).ravel()))
    keys, times = _summed(*(np.concatenate(x) for x in zip(*out))) if len(out) > 1 else out[0]
    return keys // ROOM**2, keys % ROOM**2, times


@lru_cache(maxsize=2)
def _names(n: int) -> pa.Array:
    """Decimal numbers below n, followed by comma, bar, semicolon and nothing."""
    digits = pc.cast(pa.array(np.arange(n)), pa.string())
    return pa.concat_arrays([pc.binary_join_element_wise(digits, mark, "") for mark in (",", "|", ";", "")])


def groups_text(found: Merged, a: Tokens, b: Tokens, n_names: int) -> pa.Array:
    """Per text its groups as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    cuts = found.cuts
    names = _names(n_names)
    # The tokens of A of a group come behind those of B of all groups before it; the tokens of B behind those of A up to it.
    group_a = np.searchsorted(cuts[:, 1], np.arange(len(a.ids)), "right")
    group_b = np.searchsorted(cuts[:, 2], np.arange(len(b.ids)), "right")
    b_before = np.concatenate([[0], cuts[:, 2]])
    which = np.empty(len(a.ids) + len(b.ids), np.int64)
    mark_a, mark_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    mark_a[cuts[:, 1] - 1] = 1
    mark_b[cuts[:, 2] - 1] = np.where(np.r_[cuts[1:, 0] != cuts[:-1, 0], True], 3, 2) if len(cuts) else 2
    which[np.arange(len(a.ids)) + b_before[group_a]] = mark_a * n_names + a.ids
    which[np.arange(len(b.ids)) + cuts[:, 1][group_b]] = mark_b * n_names + b.ids
    lists = pa.ListArray.from_arrays(pa.array((a.starts + b.starts).astype(np.int32)), names.take(pa.array(which)))
    return pc.binary_join(lists, "")


def _packed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending pairs as differences, and their links, byte by byte, so that leading zeros compress."""
    return np.concatenate([np.diff(pairs, prepend=0), times]).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    each = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()
    return np.cumsum(each[: len(each) // 2]), each[len(each) // 2 :]


FIGURES = "n_a long, n_b long, n_groups long, n_links long"


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", with_groups: bool = True) -> DataFrame:
    """Per row doc_id, n_a, n_b, n_groups, n_links, groups (text, see :func:`groups_text`), groups_sha256, row and links.

    ``row`` is a number of the row; ``links`` are its distinct linked pairs of ids with their numbers of links, packed; see
    :func:`link_table` for them as rows. Null and empty texts, and texts that a tokenizer does not give back byte for
    byte (unknown characters, U+2581), have no tokens. Repeated rows stay and are documents of their own. Other columns are not
    looked at. Whole texts are tokenized: their chunks are cut where no token reaches across.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = tokenizers(path_a, path_b)
        encoder = Encoder(*kinds)
        n_names = max(len(k.bytes) for k in kinds)
        number = TaskContext.get().partitionId() << 40
        for batch in (s.slice(at, ROWS) for s in slices(batches, "text", SLICE_BYTES) for at in range(0, s.num_rows, ROWS)):
            a, b = encoder.tokens(batch.column("text").to_pylist())
            found = merge(a, b)
            n = batch.num_rows
            owner, pairs, times = linked(found, a, b)
            cuts = np.searchsorted(owner, np.arange(n + 1)).tolist()
            links = [_packed(pairs[x:y], times[x:y]) for x, y in zip(cuts, cuts[1:])]
            n_links = np.bincount(owner, times, n).astype(np.int64)
            groups = groups_text(found, a, b, n_names)
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups.to_pylist()]
            rows = pa.array(np.arange(number, number + n))
            number += n
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), rows, pa.array(np.diff(a.starts)), pa.array(np.diff(b.starts)),
                 pa.array(np.bincount(found.cuts[:, 0], minlength=n)), pa.array(n_links),
                 *([groups] if with_groups else []), pa.array(digests, pa.string()), pa.array(links, pa.binary())],
                ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", *(["groups"] if with_groups else []), "groups_sha256", "links"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, row long, {FIGURES}, {'groups string, ' if with_groups else ''}groups_sha256 string, links binary"
    return with_text(docs, text, F.col(doc_id).alias("doc_id")).mapInArrow(run, schema)


def link_table(aligned: DataFrame) -> DataFrame:
    """(row, a, b, links): the distinct pairs of ids linked in each row of :func:`align`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "links"):
            for row, data in zip(batch.column("row").to_pylist(), batch.column("links").to_pylist()):
                pairs, times = _unpacked(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pairs), row)), pa.array((pairs // ROOM).astype(np.int32)), pa.array((pairs % ROOM).astype(np.int32)), pa.array(times)],
                    ["row", "a", "b", "links"],
                )

    return aligned.select("row", "links").mapInArrow(run, "row long, a int, b int, links long")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many rows a pair is linked, and whether that is the most of all pairs with this a."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        total = (np.empty(0, np.int64), np.empty(0, np.int64))

        def added() -> tuple[np.ndarray, np.ndarray]:
            values, n = np.unique(np.concatenate(held), return_counts=True) if held else total
            return _summed(np.concatenate([total[0], values]), np.concatenate([total[1], n]))

        def given(pairs: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs // ROOM, pa.int64()), pa.array(pairs % ROOM, pa.int64()), pa.array(times)], ["a", "b", "n"])

        for batch in batches:
            for data in batch.column("links").to_pylist():
                held.append(_unpacked(data)[0])
                size += len(held[-1])
                if size > COUNTED:
                    total, held, size = added(), [], 0
                    if len(total[0]) > COUNTED:
                        yield given(*total)
                        total = (np.empty(0, np.int64), np.empty(0, np.int64))
        yield given(*(added() if held else total))

    counts = aligned.select("links").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = stored(aligned.sparkSession, counts, "align-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _held(counts: DataFrame):
    """The counts as ascending numbers of pairs and twice the count, plus one for a best pair; broadcast."""
    rows = counts.select((F.col("a") * ROOM + F.col("b")).alias("pair"), (F.col("n") * 2 + F.col("best").cast("int")).alias("n")).toArrow()
    pairs, n = (rows.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pairs)
    return counts.sparkSession.sparkContext.broadcast((pairs[order], n[order]))


def _weighed(aligned: DataFrame, counts: DataFrame, keep: list[str]) -> DataFrame:
    """The columns named, and of the pairs that ``counts`` has the best links and the counts added up over links."""
    held = _held(counts)
    fields = ", ".join(f"`{k}` {aligned.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = held.value
        for batch in slices(batches, "links"):
            each = [_unpacked(x) for x in batch.column("links").to_pylist()]
            pairs, times = (np.concatenate([e[k] for e in each]) for k in (0, 1))
            owner = np.repeat(np.arange(len(each)), [len(e[0]) for e in each])
            at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            value = np.where(known[at] == pairs, n[at], 0) if len(known) else np.zeros(len(pairs), np.int64)
            sums = np.zeros((2, len(each)), np.int64)
            np.add.at(sums[0], owner, times * (value & 1))
            np.add.at(sums[1], owner, times * (value >> 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(sums[0]), pa.array(sums[1])], [*keep, "n_best", "count_sum"])

    return aligned.select(*keep, "links").mapInArrow(run, f"{fields}, n_best long, count_sum long")


def report(docs: DataFrame, path_a: str, path_b: str, held: int = HELD) -> DataFrame:
    """Per row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    The counts of pairs are broadcast in parts of about ``held`` pairs, one part for vocabularies and corpora of usual size; with several
    parts each row meets every part, and what it finds is added up.
    """
    spark = docs.sparkSession
    aligned = stored(spark, align(docs, path_a, path_b, with_groups=False), "align-rows")
    counts = stored(spark, pair_counts(aligned), "align-pairs")
    figures = [f.name for f in aligned.schema if f.name not in ("row", "links", "doc_id", "groups_sha256")]
    n_parts = max(1, -(-counts.count() // held))
    shown = ["doc_id", *figures, "n_best", "count_sum", "groups_sha256"]
    if n_parts == 1:
        return _weighed(aligned, counts, ["doc_id", *figures, "groups_sha256"]).select(*shown)
    part = F.pmod(F.xxhash64("a", "b"), F.lit(n_parts))
    sums = None
    for k in range(n_parts):
        one = _weighed(aligned, counts.where(part == k), ["row"])
        sums = one if sums is None else sums.unionByName(one)
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("links").join(sums, "row").select(*shown)
