"""Byte-level BPE with word ends: encoding by an index of pair occurrences, and decoding.

A vocabulary file in the ``tokenizers`` JSON form is a parameter; every task loads it once.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices, texts, with_text

#: White space as Unicode defines it.
SPACE = "\t-\r \x85\xa0  -     　"
# A fixed pattern: it must equal the one in the vocabulary file. (The library has the letters of its own Unicode version;
# the few that ``regex`` knows beyond it are the only difference.)
UNITS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: Encoded words a task remembers before it starts anew.
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Symbols, merges and special tokens of a vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        self.end = model["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.names = {i: t for t, i in (ids | self.special).items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + self.end] for c in letters]
        self.markers = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def units(self, text: str) -> list[str]:
        """The pieces merges stay within; special tokens are pieces too, and are found before any normalising."""
        if self.markers is None or not self.markers.search(text):
            return self._plain(text)
        out = []
        for i, part in enumerate(self.markers.split(text)):
            out += [part] if i % 2 else self._plain(part)
        return out

    @staticmethod
    def _plain(text: str) -> list[str]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return UNITS.findall(text.replace("Σ", "σ").lower())  # lower() alone looks at the letters around a sigma

    def encode_units(self, units: list[str]) -> list[tuple[int, ...]]:
        """Ids of distinct pieces, merged all at once.

        All symbols stand in one row, each with links to its neighbours inside its piece. ``where`` maps the rank
        of a pair to all positions where the pair may begin. The least active rank is applied to all its positions
        from left to right; each merge adds the two pairs it makes to their lists. Ranks of pairs with a new symbol
        are queued as they appear, so each piece sees its merges in ascending order of rank.
        """
        ranks, merged = self.ranks, self.merged
        symbol: list[int] = []
        after: list[int] = []
        before: list[int] = []
        starts = []
        for unit in units:
            at = len(symbol)
            starts.append(at)
            if unit in self.special:
                symbol.append(self.special[unit])
            else:
                raw = unit.encode()
                symbol += [self.inner[b] for b in raw[:-1]]
                symbol.append(self.last[raw[-1]])
            n = len(symbol)
            after += range(at + 1, n + 1)
            after[-1] = -1
            before += range(at - 1, n - 1)
            before[at] = -1
        where: dict[int, list[int]] = {}
        for i, j in enumerate(after):
            if j >= 0 and (rank := ranks.get((symbol[i], symbol[j]))) is not None:
                where.setdefault(rank, []).append(i)
        active = list(where)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            left, right, new = merged[rank]
            places = where.pop(rank)
            places.sort()
            for i in places:
                j = after[i]
                if symbol[i] != left or j < 0 or symbol[j] != right:
                    continue
                k, h = after[j], before[i]
                symbol[i], symbol[j] = new, -1
                after[i] = k
                if k >= 0:
                    before[k] = i
                    made = ranks.get((new, symbol[k]))
                    if made is not None:
                        if made in where:
                            where[made].append(i)
                        else:
                            where[made] = [i]
                            heapq.heappush(active, made)
                if h >= 0:
                    made = ranks.get((symbol[h], new))
                    if made is not None:
                        if made in where:
                            where[made].append(h)
                        else:
                            where[made] = [h]
                            heapq.heappush(active, made)
        out = []
        for at in starts:
            ids = []
            while at >= 0:
                ids.append(symbol[at])
                at = after[at]
            out.append(tuple(ids))
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _local(path: str) -> str:
    """A file shipped with ``addFile`` is known by its bare name; others lie at the same place everywhere."""
    return path if "/" in path else SparkFiles.get(path)


def encode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id`` and ``ids``, an array of int.

    Null and empty texts have no ids; repeated rows stay; other columns of ``df`` are not looked at.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(_local(path))
        known: dict[str, tuple[int, ...]] = {}
        for batch in slices(batches, "text"):
            pieces = [words.units(t) for t in texts(batch)]
            if len(known) > REMEMBERED:
                known.clear()
            new = list({*chain.from_iterable(pieces)} - known.keys())
            known.update(zip(new, words.encode_units(new)))
            ids = [list(chain.from_iterable(map(known.__getitem__, p))) for p in pieces]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    docs = with_text(df, text, F.col(doc_id).alias("doc_id"))
    return docs.mapInArrow(run, f"doc_id {df.schema[doc_id].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row ``doc_id``, ``ids`` and ``decoded``: the symbols' names with one space between them.

    That is what a vocabulary file without a decoder asks for: word ends and byte letters stay visible, and special
    tokens are kept. Null ids count as none; an id the vocabulary lacks is left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = vocabulary(_local(path)).names
        table = np.array([names.get(i) for i in range(max(names) + 1)], dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids_, sizes = part.column("ids"), pc.fill_null(pc.list_value_length(part.column("ids")), 0)
                flat = pc.fill_null(ids_.flatten(), -1).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(part.num_rows), sizes.to_numpy(zero_copy_only=False))
                known = (flat >= 0) & (flat < len(table))
                known[known] = table[flat[known]] != None  # noqa: E711
                words = table[flat[known]].tolist()
                ends = np.cumsum(np.bincount(owner[known], minlength=part.num_rows)).tolist()
                out = [" ".join(words[a:b]) for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], ["doc_id", "ids", "decoded"])

    kind = df.schema[doc_id].dataType.simpleString()
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return docs.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
