"""Search without reading the texts: a table of where each word stands, by which a query meets only its own words.

Texts are lower-cased and cut at every single space: repeated spaces give empty words, and other white space is part of words.
A text then contains a query exactly where consecutive words match its pieces, the first at its end, the last at its start and
those between as a whole; a query without spaces is contained in one word. So :func:`find` equals :func:`furrow.functions.text.search`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.operators.columns import named

#: Folders that the words are dealt into. A query lists the folders of its words, so this bounds what comes to the driver.
FOLDERS = 256
#: Bytes of texts that a task cuts into words together; a longer text is cut by itself. Their words are indexed so many at a time.
CUT_BYTES, BLOCK_WORDS = 12 << 20, 1 << 21


def build(df: DataFrame, id_column: str, columns: Sequence[str], path: str, folders: int = FOLDERS) -> None:
    """Write the index of text columns to ``path``: the places of all words, and the words with their numbers.

    Ids tell rows apart: of rows with one id, a query may match words of several. Rows without an id are left out, as are missing texts; an empty text has one empty word.
    The places of a word in a run of texts are one row with lists, so that such rows, and not single places, are dealt and sorted.
    The position of a text's last word is stored as -1 - position. Rows are in the order of folder and word; those of a frequent
    word may be spread over files.
    """
    texts = [F.struct(F.lit(i).alias("column"), F.lower(named(c).cast("string")).alias("text")) for i, c in enumerate(columns)]
    cells = df.where(named(id_column).isNotNull()).select(named(id_column).alias("id"), F.inline(F.array(*texts)))
    blocks = _blocks(cells.where(F.col("text").isNotNull()))
    (
        # The adaptive plan splits the folders of frequent words and joins small ones.
        blocks.withColumn("folder", F.pmod(F.xxhash64("word"), F.lit(folders)).cast("int"))
        .hint("rebalance", "folder")
        .withColumn("n", F.size("id").cast("long"))
        .sortWithinPartitions("folder", "word")
        .write.option("compression", "zstd")
        .partitionBy("folder")
        .parquet(f"{path}/places")
    )
    kind = cells.schema["id"].dataType
    words = _stored(df.sparkSession, path, kind).groupBy("folder", "word").agg(F.sum("n").alias("n"))
    words = words.withColumn("id", F.lit(None).cast(kind))  # tells readers the type of ids
    words.sortWithinPartitions("word").write.parquet(f"{path}/words")


def _lists(kind: T.DataType) -> T.StructType:
    whole = T.IntegerType()
    return T.StructType([
        T.StructField("word", T.StringType()), T.StructField("column", whole),
        T.StructField("id", T.ArrayType(kind)), T.StructField("position", T.ArrayType(whole)),
    ])


def _blocks(cells: DataFrame) -> DataFrame:
    """The places of the words of ``cells`` (id, column, text): a row per word and column of a run of texts, with lists."""
    cut_bytes, block_words = CUT_BYTES, BLOCK_WORDS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            part = np.cumsum(pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64) // cut_bytes
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), whole.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                batch = whole.slice(a, b - a)
                lists = pc.split_pattern(batch.column("text"), " ")
                sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
                begins = np.cumsum(sizes) - sizes
                columns, words = batch.column("column").to_numpy().astype(np.int64), lists.flatten()
                for at in range(0, len(words), block_words):
                    coded = words.slice(at, block_words).dictionary_encode()
                    places = np.arange(at, at + len(coded))
                    text = np.searchsorted(begins, places, "right") - 1
                    group = columns[text] * len(coded.dictionary) + coded.indices.to_numpy()
                    # Places in the order of group, found by sorting numbers that hold both.
                    order = np.sort(group << 32 | places - at) & 0xFFFFFFFF
                    n = np.bincount(group)
                    some = np.flatnonzero(n)
                    ends = pa.array(np.append(0, np.cumsum(n[some])), pa.int32())
                    text, places = text[order], places[order]
                    position = places - begins[text]
                    position = np.where(position == sizes[text] - 1, -1 - position, position)
                    values = batch.column("id").take(pa.array(text)), pa.array(position, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [coded.dictionary.take(pa.array(some % len(coded.dictionary))), pa.array(some // len(coded.dictionary), pa.int32()),
                         *(pa.ListArray.from_arrays(ends, v) for v in values)],
                        ["word", "column", "id", "position"],
                    )

    return cells.select("id", "column", "text").mapInArrow(run, _lists(cells.schema["id"].dataType))


@dataclass(frozen=True)
class Index:
    """An index that is open: its words and their places."""

    words: DataFrame
    places: DataFrame


def opened(spark: SparkSession, path: str) -> Index:
    """The index at ``path``. Its files are listed once, for any number of queries."""
    words = spark.read.parquet(f"{path}/words")
    return Index(words, _places(spark, path, words.schema["id"].dataType))


def _stored(spark: SparkSession, path: str, kind: T.DataType) -> DataFrame:
    return spark.read.schema(_lists(kind).add("n", T.LongType()).add("folder", T.IntegerType())).parquet(f"{path}/places")


def _places(spark: SparkSession, path: str, kind: T.DataType) -> DataFrame:
    places = _stored(spark, path, kind).select("word", "column", "folder", F.inline(F.arrays_zip("id", F.col("position").alias("at"))))
    at = F.col("at")
    return places.select("id", "column", F.when(at < 0, -1 - at).otherwise(at).alias("position"), (at < 0).alias("end"), "word", "folder")


def pieces(query: str) -> tuple[list[tuple[int, Column]], int]:
    """Conditions on words, each with its offset from the first piece, and the number of pieces."""
    texts = query.lower().split(" ")
    last = len(texts) - 1
    word = F.col("word")
    if not last:
        return [(0, F.contains(word, F.lit(texts[0])))], 1
    found = []
    for k, text in enumerate(texts):
        if 0 < k < last:
            found.append((k, word == text))
        elif text:  # an empty piece at an edge asks for a neighbour only, which the positions tell
            found.append((k, F.startswith(word, F.lit(text)) if k else F.endswith(word, F.lit(text))))
    return found or [(last, F.lit(True))], last + 1


def find(index: Index, query: str) -> DataFrame:
    """``id`` of all rows that contain the query in one of the columns, ignoring case.

    One pass over the words gives the folders to read and the rarest piece, with which the others are intersected.
    """
    conditions, n = pieces(query)
    asked = F.lit(False)
    figures = []
    for _, condition in conditions:
        asked = asked | condition
        figures.append(F.struct(
            F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias("n"),
            F.collect_set(F.when(condition, F.col("folder"))).alias("folders"),
        ))
    sizes = index.words.where(asked).agg(*figures).first()
    start = F.col("position") - F.col("offset")
    found = None
    for k in sorted(range(len(conditions)), key=lambda k: sizes[k].n):
        offset, condition = conditions[k]
        starts = (
            index.places.where(F.col("folder").isin(sorted(sizes[k].folders)) & condition)
            .withColumn("offset", F.lit(offset))
            # An empty last piece is not looked for: a word must follow.
            .where((start >= 0) & ~F.col("end") if offset == n - 2 else start >= 0)
            .select("id", "column", start.alias("start"))
        )
        found = starts if found is None else found.join(starts, ["id", "column", "start"], "left_semi")
    return found.select("id").distinct()
