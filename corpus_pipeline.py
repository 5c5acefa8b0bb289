"""The corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next one's
``docs``. All but the last keep the columns of documents. Also here: all queries of the subpackage ``llm``, for registration.

In all stages a null text counts as empty, a row without an id stays a row of its own, repeated rows are separate rows, and an
empty table gives an empty table. Other columns are passed on as they are, whatever their names; the last stage leaves them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import bpe, decontaminate, near_dedup, pii, toxicity
from furrow.llm.queries import ORACLES
from furrow.llm.queries import QUERIES as OPERATORS
from furrow.llm.queries import tokenizer
from furrow.llm.text import table
from furrow.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5. An empty text has the score of a text without words, and stays unless nearly all labels are toxic."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least doc_id (null counts as the greatest).

    Null and empty texts are one class; of a repeated row one stays.
    """
    return near_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item. Empty texts hold none; empty items are in no text."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; a null text stays null."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document doc_id, n_tokens, ids and the text decoded from them; an empty text has no ids and decodes to an empty one."""
    path = tokenizer("word_bpe_49k.json")
    return bpe.decode(bpe.encode(docs, path), path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_copies),
    ("decontaminate", drop_benchmark),
    ("pii", hide_personal),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "corpus")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


#: SQL can express neither the toxicity model nor the merges; tests compare with brute force.
ORACLE_SQL = None

QUERIES = OPERATORS | {"pipeline": run}
SQL = dict(ORACLES)
