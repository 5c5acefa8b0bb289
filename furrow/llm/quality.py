"""Document quality: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import SAMPLE, held_out, training_rows
from .text import slices, stored, texts, with_text

#: Random features, width of the kernel in standardised statistics, ridge per training row, seed of the features.
FEATURES, WIDTH, RIDGE, SEED = 256, 3.0, 1e-4, 7
#: Tasks the training rows are summed in.
PARTS = 8

_kinds = np.zeros((256, 6))
_kinds[[*range(48, 58)], 0] = 1  # digits
_kinds[[*range(65, 91)], 1] = 1  # capitals
_kinds[[*range(97, 123)], 2] = 1  # small letters
_kinds[[*range(128, 256)], 3] = 1  # bytes of other letters
_kinds[[ord(c) for c in ".,;:!?"], 4] = 1  # punctuation
_kinds[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:!?"], 5] = 1  # signs

NAMES = (
    "log_bytes log_words word_mean word_spread word_longest distinct repeats top_word top_three sentence_words lines "
    "line_repeats short_lines digits capitals small others points signs sign_words word_kinds_bits joined_signs"
).split()


def statistics(text: str) -> list[float]:
    """Figures of the whole text; all 0 for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    raw = text.encode()
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _kinds / len(raw)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    times = np.fromiter(counts.values(), np.int64, len(counts))
    common = [c for _, c in counts.most_common(3)]
    share = times / n
    lines = [line for line in text.split("\n") if line]
    sign_words = sum(1 for w in counts if not w[-1].isalnum() and w[-1] not in ".,;:!?")
    return [
        float(np.log1p(len(raw))), float(np.log1p(n)), float(sizes.mean()), float(sizes.std()), float(np.log1p(sizes.max())),
        len(counts) / n, sum(map(eq, words, words[1:])) / n, common[0] / n, sum(common) / n,
        float(np.log1p(n / (1 + sum(text.count(c) for c in ".!?")))), float(np.log1p(n / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)), sum(1 for line in lines if len(line) < 20) / max(1, len(lines)),
        *kinds.tolist(), sign_words / len(counts), float(-(share * np.log2(share)).sum() / np.log2(n + 1)),
        counts["|"] / n,
    ]


def describe(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id`` and ``stats``, the figures named in NAMES. Null texts count as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [statistics(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_text(docs, "text", "doc_id").mapInArrow(run, f"doc_id {kind}, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # raw scores in ascending order
    levels: np.ndarray  # their calibrated scores

    def features(self, x: np.ndarray) -> np.ndarray:
        """Cosines whose products approximate a Gaussian kernel of the standardised statistics, and a 1."""
        random = np.random.default_rng(SEED)
        turn = random.normal(size=(x.shape[1], FEATURES)) / WIDTH
        shift = random.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ turn + shift), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.steps, self.levels)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function nearest to y, by pooling neighbours; ties in x are pooled first."""
    steps, place = np.unique(x, return_inverse=True)
    weight = np.bincount(place).astype(float)
    value = np.bincount(place, y) / weight
    pools: list[list[float]] = []  # mean, weight, number of steps
    for v, w in zip(value, weight):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools[-1]
            a[0] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1])
            a[1] += b[1]
            a[2] += b[2]
    return steps, np.repeat([p[0] for p in pools], [p[2] for p in pools])


def _summed(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The normal equations: each task sums its rows, Spark adds the sums line by line."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    size = FEATURES + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z = shared.value.features(np.array(batch.column("stats").to_pylist(), float))
                total += z.T @ np.column_stack([z, batch.column("label").to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total.tolist())], ["line", "sums"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"line": frame["line"][:1], "sums": [np.sum(frame["sums"].tolist(), axis=0)]})

    lines = rows.mapInArrow(run, "line int, sums array<double>").groupBy("line").applyInPandas(add, "line int, sums array<double>")
    total = np.array([r["sums"] for r in lines.orderBy("line").collect()])
    return total[:, :size], total[:, size]


def train(stats: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """A model from ``labels.quality`` of at most ``bound`` training rows of ``stats``.

    A quarter of the rows, by the hash of the id, is kept for the calibration. Without training rows every score is 0.5;
    with one class only it is that class.
    """
    spark = stats.sparkSession
    rows = stored(spark, training_rows(stats, labels, "quality", "stats", bound).repartition(PARTS, "doc_id"), "quality-rows")
    is_fit = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) > 0
    figures = [F.col("stats")[i] for i in range(len(NAMES))]
    first = rows.agg(F.count("*"), F.avg("label"), *map(F.avg, figures), *map(F.stddev_pop, figures)).first()
    n, rate, rest = first[0], first[1], first[2:]
    if not n:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    mean, spread = np.array(rest[: len(NAMES)], float), np.array(rest[len(NAMES) :], float)
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, float(rate)))
    if not 0 < rate < 1:
        return model
    left, right = _summed(rows.where(is_fit), model)
    keep = np.eye(FEATURES + 1) * RIDGE * max(1.0, left[-1, -1])
    keep[-1, -1] = 1e-9
    model.weights = np.linalg.solve(left + keep, right)
    other = rows.where(~is_fit).select("stats", "label").toPandas()
    if len(other):
        x = np.array(other["stats"].tolist(), float)
        model.steps, model.levels = isotonic(model.raw(x), other["label"].to_numpy(float))
    else:
        model.steps, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Per row doc_id, held_out, score and predicted (1 from 0.3 on).

    Null and empty texts have statistics of 0 and are scored like any other; repeated rows get equal scores; only
    ``doc_id`` and ``text`` of the documents are looked at. The statistics, a few figures per row, are written once.
    """
    stats = stored(docs.sparkSession, describe(docs), "quality-stats")
    shared = docs.sparkSession.sparkContext.broadcast(train(stats, labels, bound))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("stats").to_pylist(), float).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(x))], ["doc_id", "score"])

    scored = stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
