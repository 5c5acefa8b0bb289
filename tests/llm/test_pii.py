import hashlib
import random
import re

import pytest

from furrow.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def is_good(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text) if is_good(k, m.group())]


PIECES = ["a", "@", "b.c", ".", "1", "22", "4111111111111111", "+1 ", "(2)", " ", "-", "é", "𝔘", "5500 0000 0000 0004",
          "\n", "%", "+", "1.2.3.4", "x@y.z", "GB82WEST12345698765432", "256.1.1.1", "001.02.3.4"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    out = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    return [*out, None, "", "a@b.c " * 700, "1" * 9000, "x@" + "a." * 9000 + "b", "1 " * 9000, "a" * 90_000, "+1" + "(" * 5000]


def test_base_spans_are_those_of_the_contract(spark, texts, tmp_path):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    found = {r["doc_id"]: r for r in pii.report(spark.read.parquet(f"{tmp_path}/t")).collect()}
    for i, text in enumerate(texts):
        spans = base_spans(text or "")
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), text
        assert [found[i][f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k + ":") for s in spans) for k in PATTERNS]
        assert found[i]["spans"].split(",")[: len(spans)] == (spans or [found[i]["spans"]][: len(spans)])


def test_method_adds_checked_and_contextual_spans(spark):
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32."), (2, "iban GB83 WEST 1234 5698 7654 32."), (3, "ssn 123-45-6789"),
            (4, "part 123-45-6789"), (5, "ssn 666-45-6789"), (6, "+1 (269) 555-3296 4524132264652876")]
    found = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: "iban:5:32", 2: "", 3: "ssn:4:15", 4: "", 5: "", 6: "card_part:18:34,phone_part:0:17"}


def test_context_raises_the_score(spark):
    rows = spark.createDataFrame([("mail me: a@b.cd",), ("the a@b.cd",)], "text string")
    scores = [r["spans"][0]["score"] for r in pii.find(rows).collect()]
    assert scores[0] > scores[1] >= pii.KEEP


def test_redact_keeps_rows_and_columns(spark, odd_docs, no_docs):
    rows = [(1, "x a@b.cd y", 10, "s"), (1, "x a@b.cd y", 10, "s"), (2, None, None, "s"), (None, "", 0, None), (3, "mail 1.2.3.4@host.com 4111111111111111", 1, "s")]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string"))
    assert out.columns == ["doc_id", "text", "n_chars", "spans"]
    got = sorted(out.collect(), key=str)
    assert sorted(map(str, got)) == sorted(map(str, [
        spark.createDataFrame([r], out.schema).first() for r in
        [(1, "x <EMAIL> y", 11, "s"), (1, "x <EMAIL> y", 11, "s"), (2, None, None, "s"), (None, "", 0, None), (3, "mail <EMAIL> <CARD>", 19, "s")]
    ]))
    assert pii.redact(odd_docs, n_chars=None).columns == odd_docs.columns
    assert pii.redact(no_docs).count() == 0 and pii.report(no_docs).count() == 0


def test_plan_has_no_python(spark, odd_docs):
    plan = pii.report(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
