"""Toxic documents: a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two words sums, over all strings of three characters, the weights with which each word holds the string
as a subsequence; every character skipped costs a factor ``DECAY``, and at most three are skipped. Inserted and gapped
characters therefore leave most of an insult's kernel value in place. Only documents have labels; the words that tell
toxic ones apart are the positives of the machine, and with the clean words most like them its landmarks. A document's
score comes from its two most toxic words, as an insult's stem can occur once by chance.
"""

from __future__ import annotations

import heapq
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import SAMPLE, held_out, training_rows
from .text import mix, slices, stored, texts, with_text, word_hashes

#: Places of the second and third character after the first.
STEPS = [(a, b) for b in range(2, 6) for a in range(1, b)]
DECAY = 0.7
#: Characters fall into so many classes; a string of three is a number below CODES.
CLASSES = 128
CODES = CLASSES**3
#: Words of more characters are cut into pieces of this length that overlap by half.
PIECE = 24
#: Landmarks of either kind, and the training words of the machine.
LANDMARKS, POSITIVES, NEGATIVES = 128, 600, 6000
#: Words whose features are made together.
TOGETHER = 2000
#: Bytes of text that are word lists at a time.
SLICE_BYTES = 1 << 20
#: Rounds in which the clean words the machine finds most toxic join the negatives.
HARD_ROUNDS, HARD = 2, 2000
#: Words a task remembers before it starts anew.
REMEMBERED = 100_000

SPELLED = re.compile(r"(?<!\S)(?:\w[ .*_-]){2,}\w(?!\w)")
EDGES = string.punctuation + "«»“”„…–—¿¡"


def words_of(text: str) -> list[str]:
    """Lower-case words in order without outer punctuation; letters spelled one by one count as one word."""
    text = SPELLED.sub(lambda m: re.sub(r"[ .*_-]", "", m.group()), text.lower())
    out = []
    for word in text.split():
        word = word.strip(EDGES)
        if len(word) > PIECE:
            out += [word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]
        elif word:
            out.append(word)
    return out


@dataclass
class Subsequences:
    """The kernel's features of many words as three arrays, by word and then by code; words have length 1."""

    word: np.ndarray
    code: np.ndarray
    weight: np.ndarray


def subsequences(words: list[str]) -> Subsequences:
    """Weights of all strings of three characters, scaled so that each word's kernel with itself is 1."""
    marked = [f"\x01{w}\x02" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    letters = np.where(points < CLASSES, points, 3 + points % 29).astype(np.int64)
    sizes = np.array([len(w) for w in marked], np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
    at = np.arange(len(points))
    keys = []
    for a, b in STEPS:
        p = at[at + b < ends]
        code = (letters[p] * CLASSES + letters[p + a]) * CLASSES + letters[p + b]
        keys.append(((owner[p] * CODES + code) << 2) + (b - 2))
    key = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    if not len(key):
        return Subsequences(key, key, np.empty(0))
    first = np.flatnonzero(np.r_[True, (key[1:] >> 2) != (key[:-1] >> 2)])
    weight = np.add.reduceat(DECAY ** (key & 3).astype(float), first)
    pair = key[first] >> 2
    word, code = pair // CODES, pair % CODES
    length = np.sqrt(np.bincount(word, weight**2, len(words)))
    return Subsequences(word, code, weight / length[word])


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values, one row per word and one column per landmark."""
    out = np.zeros((len(words), len(landmarks)))
    x, y = subsequences(words), subsequences(landmarks)
    order = np.argsort(y.code, kind="stable")
    lo, hi = (np.searchsorted(y.code[order], x.code, side) for side in ("left", "right"))
    for step in range(int((hi - lo).max(initial=0))):
        has = lo + step < hi
        other = order[lo[has] + step]
        np.add.at(out, (x.word[has], y.word[other]), x.weight[has] * y.weight[other])
    return out


@dataclass
class Model:
    """``weights`` by code, so that a word's margin is one sum; the last two turn a document's margins into a score."""

    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    offset: float

    def margins(self, words: list[str]) -> np.ndarray:
        parts = []
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            x = subsequences(some)
            parts.append(np.bincount(x.word, x.weight * self.weights[x.code], len(some)) + self.bias)
        return np.concatenate(parts) if parts else np.empty(0)

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margins @ self.slopes + self.offset, -500, 500)))


def constant(rate: float) -> Model:
    return Model(np.zeros(CODES, np.float32), 0.0, np.zeros(2), float(np.log((rate + 1e-6) / (1 - rate + 1e-6))))


def machine(z: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    w = np.zeros(z.shape[1])
    keep = np.eye(z.shape[1]) * ridge
    keep[-1, -1] = 1e-6  # the bias
    for _ in range(50):
        inside = y * (z @ w) < 1
        zc = z[inside] * c[inside, None]
        new = np.linalg.solve(keep + zc.T @ z[inside], zc.T @ y[inside])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and offset of a logistic curve, with targets moved off 0 and 1 as for Platt scaling."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(len(w)), a.T @ (target - p) - 1e-3 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    if len(w) > 2 and (w[:-1] < 0).any():  # more toxic words never make a document less toxic
        kept = w[:-1] > 0
        slopes, offset = _logistic(x[:, kept], y)
        w = np.zeros(len(w))
        w[:-1][kept], w[-1] = slopes, offset
    return w[:-1], float(w[-1])


def _word_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many different neighbourhoods a word occurs in either kind of document.

    Counting the words in front, and not documents, makes copies of one document count once.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            pieces = [words_of(t) for t in texts(batch)]
            flat = list(chain.from_iterable(pieces))
            if not flat:
                continue
            label = np.repeat(batch.column("label").to_numpy(), [len(p) for p in pieces])
            hashes = word_hashes(flat)
            frame = pd.DataFrame({"word": flat, "near": mix(np.r_[np.uint64(0), hashes[:-1]]).view(np.int64), "label": label})
            yield pa.RecordBatch.from_pandas(frame.drop_duplicates(), preserve_index=False)

    seen = rows.select("label", "text").mapInArrow(run, "word string, near long, label int").distinct()
    return seen.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))


def _document_margins(rows: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns named, and the margins of the two most toxic words and the score they make."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in slices(batches, "text", SLICE_BYTES):
            margins = judge.margins(texts(batch))
            figures = [pa.array(x) for x in (margins[:, 0].copy(), margins[:, 1].copy(), shared.value.score(margins))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *figures], [*keep, "margin", "second", "score"])

    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.select(*keep, "text").mapInArrow(run, f"{types}, margin double, second double, score double")


class Judge:
    """Margins of documents within one task, remembering those of words.

    A word that occurs twice is both of the two; a word that is missing has the bias of the model as its margin.
    """

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, float] = {}

    def margins(self, docs: list[str]) -> np.ndarray:
        pieces = [Counter(words_of(t)) for t in docs]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*pieces) - self.known.keys())
        if new:
            self.known.update(zip(new, self.model.margins(new).tolist()))
        return np.array([self._two(p) for p in pieces], float).reshape(-1, 2)

    def _two(self, words: Counter) -> tuple[float, float]:
        best = heapq.nlargest(2, words, self.known.__getitem__)
        values = [self.known[w] for w in best for _ in range(min(2, words[w]))]
        return (*values, self.model.bias, self.model.bias)[:2]


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """A model from ``labels.toxic`` of at most ``bound`` training documents, which are read by broadcast join.

    What reaches the driver is bounded: POSITIVES + NEGATIVES words, HARD per round, and two margins per training document. Without labels, with one class only or without telling words the score is the rate of toxic labels.
    """
    spark = docs.sparkSession
    rows = stored(spark, training_rows(with_text(docs, "text", "doc_id"), labels, "toxic", "text", bound), "toxic-rows")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n or not 0 < toxic < n:
        return constant(toxic / n if n else 0.0)
    counts = stored(spark, _word_counts(rows), "toxic-words")
    total, all_toxic, all_clean = counts.agg(F.count("*"), F.sum("toxic"), F.sum("clean")).first()
    if not total:
        return constant(toxic / n)
    rate = all_toxic / (all_toxic + all_clean)
    # How unlikely the share of toxic neighbourhoods is by chance; so rare that no word is expected to have it.
    k, m = F.col("toxic"), F.col("toxic") + F.col("clean")
    gain = k * F.log(k / m / rate) + F.when(m > k, (m - k) * F.log((m - k) / m / (1 - rate))).otherwise(0.0)
    telling = counts.where((k > 0) & (k / m > 0.5)).withColumn("gain", gain).where(F.col("gain") > float(np.log(2 * total)))
    chosen = telling.orderBy(F.desc("gain"), "word").limit(POSITIVES).collect()
    if not chosen:
        return constant(toxic / n)
    good, weight = [r["word"] for r in chosen], np.array([r["toxic"] for r in chosen], float)
    clean = counts.where((F.col("clean") > 0) & (k / m <= 0.5))
    often = clean.orderBy(F.desc("clean"), "word").limit(NEGATIVES // 2)
    some = clean.orderBy(F.xxhash64("word"), "word").limit(NEGATIVES // 2)
    bad = sorted({r["word"] for r in often.union(some).collect()})
    marks = good[:LANDMARKS]
    model = _fit(good, weight, bad, marks)
    for _ in range(HARD_ROUNDS):
        hard = _document_margins(clean.select(F.col("word").alias("text"), "word"), model, "word")
        hardest = [r["word"] for r in hard.orderBy(F.desc("margin"), "word").limit(HARD).collect()]
        bad = sorted({*bad, *hardest})
        marks += [w for w in hardest[:LANDMARKS] if w not in marks]
        model = _fit(good, weight, bad, marks)
    seen = _document_margins(rows, model, "label").toPandas()
    model.slopes, model.offset = _logistic(seen[["margin", "second"]].to_numpy(), seen["label"].to_numpy(float))
    return model


def _fit(good: list[str], weight: np.ndarray, bad: list[str], marks: list[str]) -> Model:
    """The machine on Nyström features: kernel values with the landmarks times the inverse root of theirs with each other."""
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    sure = values > 1e-6
    root = vectors[:, sure] / np.sqrt(values[sure])
    z = kernel(good + bad, marks) @ root
    z = np.column_stack([z, np.ones(len(z))])
    y = np.r_[np.ones(len(good)), -np.ones(len(bad))]
    share = np.r_[weight / weight.sum(), np.full(len(bad), 1 / max(1, len(bad)))] * 4000
    w = machine(z, y, share)
    beta = root @ w[:-1]
    x = subsequences(marks)
    return Model(np.bincount(x.code, x.weight * beta[x.word], CODES).astype(np.float32), float(w[-1]), np.zeros(2), 0.0)


def score(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Per row doc_id, held_out, score and predicted (1 from 0.5 on).

    Null and empty texts get the score of a text without words; repeated rows get equal scores; only ``doc_id`` and
    ``text`` of the documents are looked at, so other columns may have any name.
    """
    model = train(docs, labels, bound)
    scored = _document_margins(with_text(docs, "text", "doc_id"), model, "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, bound))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in slices(batches, "text", SLICE_BYTES):
            yield batch.filter(pa.array(shared.value.score(judge.margins(texts(batch))) < 0.5))

    return docs.mapInArrow(run, docs.schema)
