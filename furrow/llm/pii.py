"""Personal data: patterns propose spans, checksums confirm them, words in front adjust the score.

Everything is a column expression over one row; there is no shuffle and no Python code on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,score:double>"
#: Code points in front of a span in which context words count.
CONTEXT = 40
#: A span is kept from this score on.
KEEP = 0.5
#: Spans are placed in blocks of so many, so that a text of many spans is not copied once per span.
BLOCK = 256


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _is_ip(x: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(x, r"\."), small)


def _is_card(x: Column) -> Column:
    digits = _digits(x)
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _is_phone(x: Column) -> Column:
    return F.length(_digits(x)).between(9, 15)


def _is_iban(x: Column) -> Column:
    """ISO 13616: the first four characters go last, A is 10, and the number modulo 97 is 1."""
    bare = F.regexp_replace(x, " ", "")
    moved = F.split(F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4)), "")

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.length(bare).between(15, 34) & (F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), step) == 1)


def _is_ssn(x: Column) -> Column:
    """Areas 000, 666 and 900 to 999, group 00 and serial 0000 are never issued."""
    return ~x.rlike("^(000|666|9)|-00-|-0000$")


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes, ``check`` confirms; ``score`` of a confirmed span, ``bonus`` with a context word in front."""

    name: str
    pattern: str
    check: object
    needs: str  # a LIKE pattern every text with such a span matches
    context: str
    score: float
    bonus: float


# The patterns are those of the contract with possessive repetitions, and starts limited to places where a run of
# the first class begins (or a match ended): the same matches, in linear time, without recursion.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, "%@%.%", "mail|contact|write", 0.8, 0.1),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _is_ip, "%.%.%.%", r"\bip\b|address|host|server", 0.6, 0.2),
    Kind("card", r"(?<![0-9])[0-9](?:[ -]?[0-9])++", _is_card, "%", "card|visa|credit|payment", 0.7, 0.2),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _is_phone, "%+%", "phone|call|tel|mobile|fax", 0.6, 0.2),
)
MORE = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _is_iban, "%", "iban|account|bank", 0.7, 0.2),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _is_ssn, "%-%-%", r"\bssn\b|social security|tax", 0.3, 0.5),
)
# Sought only inside proposals of the base kinds that failed their check, such as a phone number right before a card.
PARTS = {
    "card": Kind("card_part", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])", _is_card, "%", "card|visa|credit|payment", 0.6, 0.2),
    "phone": Kind("phone_part", r"\+[0-9]{1,3}[ -]?(?:\([0-9]{3}\)|[0-9]{3})[ -]?[0-9]{3}-[0-9]{4}(?![0-9])", _is_phone, "%+%", "phone|call|tel|mobile|fax", 0.6, 0.2),
}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _placed(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: array of (start, text, before)."""

    def piece(gap: Column, hit: Column) -> Column:
        return F.struct(F.length(gap).alias("gap"), F.lower(F.right(gap, F.lit(CONTEXT))).alias("before"), hit.alias("text"))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # One gap more than matches: what follows the last match is dropped.
    pairs = _let(F.zip_with(F.split(text, pattern, -1), found, piece), lambda p: F.slice(p, 1, F.size(p) - 1))
    return _let(pairs, _summed)


def _summed(pairs: Column) -> Column:
    """The start of each match, from the lengths of gaps and matches in front of it."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))),
        lambda i: F.slice(pairs, i * BLOCK + 1, BLOCK),
    )
    none = F.array().cast("array<struct<start:int,text:string,before:string>>")

    def add(state: Column, x: Column) -> Column:
        start = state["pos"] + x["gap"]
        hit = F.struct(start.alias("start"), x["text"].alias("text"), x["before"].alias("before"))
        return F.struct((start + F.length(x["text"])).alias("pos"), F.array_append(state["out"], hit).alias("out"))

    def block(done: Column, one: Column) -> Column:
        start = F.struct(F.element_at(done, -1)["pos"].alias("pos"), none.alias("out"))
        return F.array_append(done, F.aggregate(one, start, add))

    first = F.array(F.struct(F.lit(0).alias("pos"), none.alias("out")))
    return F.flatten(F.transform(F.aggregate(blocks, first, block), lambda s: s["out"]))


def _proposed(text: Column, kind: Kind) -> Column:
    none = F.array().cast("array<struct<start:int,text:string,before:string>>")
    is_there = text.like(kind.needs) & text.rlike(kind.pattern) if kind.needs != "%" else text.rlike(kind.pattern)
    return F.when(is_there, _placed(text, kind.pattern)).otherwise(none)


def _confirmed(hits: Column, kind: Kind) -> Column:
    return F.filter(hits, lambda h: kind.check(h["text"])) if kind.check else hits


def _scored(hits: Column, kind: Kind, shift: Column | None = None) -> Column:
    def span(h: Column) -> Column:
        start = h["start"] if shift is None else h["start"] + shift
        score = F.lit(kind.score) + F.when(h["before"].rlike(kind.context), kind.bonus).otherwise(0.0)
        return F.struct(
            F.lit(kind.name).alias("kind"), start.alias("start"),
            (start + F.length(h["text"])).alias("end"), score.alias("score"),
        )

    return F.filter(F.transform(hits, span), lambda s: s["score"] >= KEEP)


def _parts(hits: Column, whole: Kind, part: Kind) -> Column:
    failed = F.filter(hits, lambda h: ~whole.check(h["text"]))
    return F.flatten(F.transform(
        failed, lambda h: _scored(_confirmed(_placed(h["text"], part.pattern), part), part, h["start"])
    ))


def find(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """All columns of ``df`` and ``out``, an array of (kind, start, end, score): code points, end exclusive.

    Base kinds ``email``, ``ip``, ``card``, ``phone`` come first, each by start, then ``iban``, ``ssn`` and the parts of
    failed proposals (``card_part``, ``phone_part``). Null and empty texts have no spans. Each row is judged by itself,
    so repeated rows get equal spans and a column of the input may have any name but ``out``.
    """
    row = [F.struct("*").alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")]
    kinds = [*BASE, *MORE]
    have = df.select(*row).select("row", "text", *(_proposed(F.col("text"), k).alias(f"hit_{k.name}") for k in kinds))
    good = [_scored(_confirmed(F.col(f"hit_{k.name}"), k), k) for k in kinds]
    for name, part in PARTS.items():
        whole = next(k for k in BASE if k.name == name)
        good.append(_parts(F.col(f"hit_{name}"), whole, part))
    return have.select("row.*", F.concat(*good).cast(f"array<{SPAN}>").alias(out))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, the digest of the base spans, and all spans as text."""
    found = find(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "spans")
    names = [k.name for k in BASE]

    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    base = joined(F.filter("spans", lambda s: s["kind"].isin(*names)))
    return found.select("doc_id", *map(count, names), F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(df: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The rows with each span replaced by its kind in angle brackets; spans that overlap become one, of the first's kind
    (of the longest, where several begin together).

    A null text stays null. ``n_chars``, where the column exists, is set to the new length of changed texts.
    """
    found = df.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"))
    found = find(found, "text", "spans").select(
        "row", "text",
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("spans"),
    )

    def step(state: Column, s: Column) -> Column:
        is_new = s["start"] >= state["pos"]
        piece = F.concat(
            F.col("text").substr(state["pos"] + 1, s["start"] - state["pos"]), F.lit("<"), F.upper(F.element_at(F.split(s["kind"], "_"), 1)), F.lit(">")
        )
        return F.struct(
            F.greatest(state["pos"], s["end"]).alias("pos"),
            F.when(is_new, F.array_append(state["out"], piece)).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    rest = F.lit(2**31 - 1)
    cut = F.aggregate(
        "spans", start, step,
        lambda s: F.concat(F.array_join(s["out"], ""), F.col("text").substr(s["pos"] + 1, rest - s["pos"] - 1)),
    )
    done = found.select("row", F.size("spans").alias("n"), F.when(F.size("spans") > 0, cut).otherwise(F.col("text")).alias("clean"))

    def column(name: str) -> Column:
        old = F.col("row")[name]
        if name == text:
            return F.col("clean").alias(name)
        if n_chars and name == n_chars:
            return F.when(F.col("n") > 0, F.length("clean").cast(df.schema[name].dataType)).otherwise(old).alias(name)
        return old.alias(name)

    return done.select(*map(column, df.columns))
