"""Helpers the operators share: slices of Arrow batches, word hashes, row passing."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Bytes of text a Python worker holds as word lists at a time; one longer text is a slice of its own.
SLICE_BYTES = 3 << 20

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd multipliers of the polynomial hashes over word hashes.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, cut so that the texts of a slice have about ``limit`` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a column; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def reach(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if it lies there on their machine too.

    On a cluster where it does not, ship it as usual, with ``--py-files`` or in the image.
    """
    home = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [home, *paths]))


def with_text(df: DataFrame, text: str, *keep) -> DataFrame:
    """Only the columns named in ``keep`` and the text as ``text``, null as empty."""
    reach(df.sparkSession)
    return df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list) -> np.ndarray:
    """64-bit hashes of words; the same word has the same hash in every process."""
    if not words:
        return np.empty(0, np.uint64)
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return pd.util.hash_array(distinct, categorize=False)[codes]


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def window_hashes(hashes: np.ndarray, width: int, base: np.uint64 = BASES[0]) -> np.ndarray:
    """A hash for every ``width`` consecutive entries: a polynomial modulo 2**64, mixed."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    total = np.empty(len(hashes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(hashes * powers(len(hashes), base), out=total[1:])
    return mix((total[width:] - total[:n]) * powers(n, inverse))


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: executors can be lost afterwards."""
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column, modulus: int):
    """crc32 of the value as text, modulo ``modulus``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
