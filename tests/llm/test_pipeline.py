"""Each stage of the pipeline on its own input against plain Python; the whole run; registration."""

import itertools
import re
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline
from furrow.llm import decontaminate
from furrow.llm.text import table
from tests.compare import both, connect
from tests.llm.test_passages import shingle_set
from tests.llm.test_pii import base_spans

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each."""
    folder = tmp_path_factory.mktemp("stages")
    docs = table(spark, SF_DIR, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_columns_stay(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:-1])
    assert all(set(b.select("doc_id").collect()) <= set(a.select("doc_id").collect()) for a, b in itertools.pairwise(stages))


def test_insults_go(stages):
    """Clean documents stay; with the few labels of this table most labelled toxic ones go."""
    before, after = ({r["doc_id"]: r["text"] for r in rows_of(df)} for df in stages[:2])
    insults = {"idiot", "moron", "scum", "trash", "clown", "loser", "stupid", "pathetic", "worthless", "disgusting"}
    dropped = {i: t for i, t in before.items() if i not in after}
    assert all(t == before[i] for i, t in after.items())
    assert sum(bool(set(t.lower().split()) & insults) for t in dropped.values()) >= 0.6 * len(dropped)


def test_one_of_each_class_stays(stages):
    before, after = rows_of(stages[1]), {r["doc_id"] for r in rows_of(stages[2])}
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in before}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        same = len(sets[a] & sets[b])
        if same >= 0.8 * (len(sets[a]) + len(sets[b]) - same):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert after == {find(i) for i in sets} and len(after) < len(sets)


def test_documents_with_benchmark_passages_go(spark, stages):
    items = [" ".join(decontaminate.words_of(r["text"])) for r in rows_of(table(spark, SF_DIR, "benchmark"))]
    before, after = rows_of(stages[2]), {r["doc_id"] for r in rows_of(stages[3])}
    for row in before:
        text = " ".join(decontaminate.words_of(row["text"]))
        assert (row["doc_id"] not in after) == any(f" {i} " in f" {text} " for i in items)


def test_personal_data_is_hidden(stages):
    before, after = ({r["doc_id"]: r for r in rows_of(df)} for df in stages[3:5])
    assert before.keys() == after.keys()
    for i, row in after.items():
        spans = base_spans(before[i]["text"])
        assert base_spans(row["text"]) == [] and row["n_chars"] == (len(row["text"]) if spans else row["n_chars"])
        assert (row["text"] == before[i]["text"]) == (not re.search(r"<(EMAIL|IP|CARD|PHONE|IBAN|SSN)>", row["text"]))


def test_tokens_are_the_library_s(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in rows_of(stages[4])}
    for row in rows_of(stages[5]):
        ids = library.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert (row["ids"], row["n_tokens"], row["decoded"]) == (ids, len(ids), library.decode(ids, skip_special_tokens=False))


def test_run_is_the_stages(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(str, stages[-1].collect()))


def test_stages_over_no_documents(spark):
    none = table(spark, SF_DIR, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF_DIR).count() == 0


def test_registered():
    names = driver.queries().keys()
    assert {*corpus_pipeline.QUERIES} <= names and len([n for n in names if re.match(r"op\d+_", n)]) == 13 and "pipeline" in names


@pytest.mark.parametrize("name", list(corpus_pipeline.SQL))
def test_matches_sql(spark, name):
    ours, theirs = both(spark, connect(SF_DIR), corpus_pipeline.QUERIES[name], corpus_pipeline.SQL[name], SF_DIR)
    assert ours == theirs
