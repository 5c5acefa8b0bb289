import random

import pytest

#: Columns that operators use as names of their own.
CLASH = "score string, key string, n int, row string, value string, label int, spans string, kept string, sketches int, place int"


@pytest.fixture(scope="session")
def passages():
    """Deterministic texts: invented words, copies, near copies, a shared passage, junk."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [text(rng.choice([1, 3, 4, 5, 6, 34, 35, 36, 80, 200])) for _ in range(60)]
    shared = text(55)
    for _ in range(8):
        out.append(f"{text(rng.randint(5, 60))}\n{shared} {text(rng.randint(5, 60))}")
    base = text(300)
    for _ in range(12):
        w = base.split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    out += [base, base, base.upper(), out[3], out[3]]
    out += ["na " * 90, "na na hey " * 40, "é ü ñ " * 30, "\x0b \x0c\t\r\n", " "]
    return out


@pytest.fixture(scope="session")
def odd_docs(spark, passages):
    """Null ids and texts, empty and very long texts, repeated ids and rows, and clashing extra columns."""
    rows = [(i, t) for i, t in enumerate(passages)]
    rows += [(None, None), (None, passages[2]), (900, None), (901, ""), (902, "x" * 200_000), (903, passages[8] + " word" * 30_000)]
    rows += [(904, passages[0]), (904, passages[1]), (905, passages[9]), (905, passages[9]), (905, passages[9])]
    extra = ("s", "k", 1, "r", "v", 3, "p", "t", 2, 4)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, {CLASH}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
