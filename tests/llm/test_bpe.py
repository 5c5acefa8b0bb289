import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from furrow.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["hello", "'s", "'S", "'ll", " ", "\n", "é", "É", "é", "Σ", "ΑΣ", "İ", "ß", "ﬁ", "１", "²", "<|endoftext|>",
          "<|startoftext|>", "<|", "|>", "123", "\x1c", "\x85", "​", "\xa0", "中文", "🙂", "!!", "aaaaaaa", "̀", "the", "ing"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encodes_and_decodes_as_the_library(spark, library, odd_docs):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))) for i in range(1500)]
    docs = spark.createDataFrame([*rows, (2000, None), (2001, "ab" * 20_000)], "doc_id long, text string").union(odd_docs.select("doc_id", "text"))
    out = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    want = []
    for row in docs.collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        want.append((row["doc_id"], ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(str, ((r["doc_id"], r["ids"], r["decoded"]) for r in out))) == sorted(map(str, want))


def test_empty_table_and_unknown_ids(spark, no_docs):
    assert bpe.decode(bpe.encode(no_docs, PATH), PATH).count() == 0
    ids = spark.createDataFrame([(1, None), (2, []), (3, [0, 10**8])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(ids, PATH).orderBy("doc_id").collect()] == ["", "", "!"]
