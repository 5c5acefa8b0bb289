"""Fill-in-the-middle: every text cut into units, dealt to prefix, middle and suffix, and put together in another order.

The cuts and the form of a row come from a hash of its id, as column expressions. The texts go through Arrow kernels only:
each batch is split into lists of units, the lists are flattened next to the numbers of their rows, a unit's ordinal
within its row decides its role, the units of a role are filtered out and make lists again, and the lists are joined to
pieces, these with their markers to the output. Texts of any length pass in bounded parts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import slices, with_text

#: In front of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Shares in hundredths: texts that are transformed, and of these the ones whose suffix comes first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Bytes of text that are lists of units at a time.
PART_BYTES = 1 << 20


def plan(docs: DataFrame, seed: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, n, low, high and form: the cuts after ``low`` and ``high`` code points, from ``seed`` and the id.

    A null text is empty; a null id counts as no digits. ``form`` is plain for texts that are empty, that hold a marker, or
    that fall outside the share; else spm (suffix first) or psm.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)

    def draw(k: int) -> Column:
        return F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")

    rows = with_text(docs, text, F.col(doc_id).alias("doc_id")).withColumn("n", F.char_length("text").cast("long"))
    marked = F.lit(False)
    for marker in MARKERS:
        marked = marked | F.contains("text", F.lit(marker))
    cuts = [draw(k) % (F.col("n") + 1) for k in (0, 1)]
    form = (
        F.when((F.col("n") == 0) | marked | (draw(2) % 100 >= TRANSFORMED), "plain")
        .when(draw(3) % 100 < SUFFIX_FIRST, "spm")
        .otherwise("psm")
    )
    rows = rows.withColumn("digest", digest)
    return rows.select("doc_id", "text", "n", F.least(*cuts).alias("low"), F.greatest(*cuts).alias("high"), form.alias("form"))


def units(texts: pa.Array) -> pa.ListArray:
    """The code points of each text, as lists that share the bytes of the texts."""
    if texts.offset:
        texts = pa.concat_arrays([texts])
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32, len(texts) + 1)
    raw = np.frombuffer(data, np.uint8, ends[-1]) if data is not None else np.empty(0, np.uint8)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    starts = starts[starts >= ends[0]].astype(np.int32)
    points = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, ends[-1]).astype(np.int32)), data)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, ends).astype(np.int32)), points)


def pieces(texts: pa.Array, first: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
    """Per text its units of each role. ``first`` is the ordinal of its first unit, where the text is part of a longer one."""
    lists = units(texts)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    begins = pa.array(lists.offsets.to_numpy()[:-1] - first)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(begins, parent))
    after = [pc.greater_equal(ordinal, pc.take(pa.array(cut), parent)) for cut in (low, high)]
    masks = [pc.invert(after[0]), pc.and_(after[0], pc.invert(after[1])), after[1]]
    out = []
    for mask in masks:
        sizes = np.bincount(pc.filter(parent, mask).to_numpy(), minlength=len(texts))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        out.append(pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(flat, mask)), ""))
    return out


def parts(text: str, limit: int = PART_BYTES) -> Iterator[tuple[int, str]]:
    """(ordinal of the first code point, part) of a text, in parts of about ``limit`` bytes at most."""
    step = max(1, limit // 4)
    for at in range(0, len(text), step):
        yield at, text[at : at + step]


def cut(texts: pa.Array, low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each text; a text that is long by itself is cut part by part."""
    if len(texts) == 1 and texts.nbytes > PART_BYTES:
        found = [pieces(pa.array([p]), np.array([at]), low, high) for at, p in parts(texts[0].as_py())]
        return [pa.array(["".join(f[role][0].as_py() for f in found)]) for role in range(3)]
    return pieces(texts, np.zeros(len(texts), np.int64), low, high)


def put_together(prefix: pa.Array, middle: pa.Array, suffix: pa.Array, form: pa.Array, plain: pa.Array) -> pa.Array:
    """The output of each row by its form."""
    p, s, m = MARKERS
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, "")
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, "")
    return pc.case_when(pa.StructArray.from_arrays([pc.equal(form, "psm"), pc.equal(form, "spm")], ["psm", "spm"]), psm, spm, plain)


def restore(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts again, from outputs and forms alone: a transformed text holds each marker once."""
    whole = pc.equal(form, "plain")
    split = pc.split_pattern_regex(pc.if_else(whole, "".join(MARKERS), output), "<[PSM]>")
    one, two, three = (pc.list_element(split, k) for k in (1, 2, 3))
    turned = pc.equal(form, "spm")
    text = pc.binary_join_element_wise(pc.if_else(turned, two, one), three, pc.if_else(turned, one, two), "")
    return pc.if_else(whole, output, text)


def transform(docs: DataFrame, seed: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row doc_id, n, form, prefix_chars, middle_chars (null if plain), output and restored.

    Null and empty texts stay empty and plain; repeated rows get equal results, as do texts with one id and length; other
    columns of ``docs`` are not looked at, and may have any name. There is no random state: a lost task gives the same again.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PART_BYTES):
            whole, form = batch.column("text"), batch.column("form")
            low, high = (batch.column(c).to_numpy() for c in ("low", "high"))
            is_plain = pc.equal(form, "plain")
            # Plain texts are not taken apart.
            output = put_together(*cut(pc.if_else(is_plain, "", whole), low, high), form, whole)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n"), form, pc.if_else(is_plain, None, batch.column("low")),
                 pc.if_else(is_plain, None, pa.array(high - low)), output, restore(output, form)],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string, restored string"
    return plan(docs, seed, doc_id, text).mapInArrow(run, schema)
