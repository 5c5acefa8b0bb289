"""Zones named in a text, without those that its brackets take off."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.functions import text as X
from furrow.functions.values import STATE_PATTERNS

#: How an exception begins, right after its bracket.
EXCEPTION = r"^\s*(?i:except(ing)?|excluding|but not|other than)\b"
#: What divides the names of a list.
_BETWEEN = r"\s*(?:,|;|&|\band\b)\s*"


def scopes(text: Column) -> Column:
    """The pieces of a text between brackets, in order, as ``array<struct<excepted, piece>>``.

    A bracket that begins as :data:`EXCEPTION` holds an exception up to the bracket that closes it, with whatever is nested
    in it; other brackets are ordinary text. An opened bracket that never closes lasts to the end, a closing one too many
    counts for nothing.
    """
    pieces = F.regexp_extract_all(F.translate(text, "[]{}", "()()"), F.lit(r"([()]|[^()]+)"), 1)
    start = F.struct(
        F.lit(0).alias("depth"),
        F.lit(0).alias("since"),  # the depth at which the exception began, 0 outside
        F.lit(False).alias("opened"),
        F.array().cast("array<struct<excepted:boolean,piece:string>>").alias("out"),
    )

    def step(state: Column, piece: Column) -> Column:
        opens, closes = piece == "(", piece == ")"
        begins = ~opens & ~closes & state["opened"] & (state["since"] == 0) & piece.rlike(EXCEPTION)
        since = F.when(begins, state["depth"]).when(closes & (state["depth"] <= state["since"]), 0).otherwise(state["since"])
        depth = F.when(opens, state["depth"] + 1).when(closes, F.greatest(state["depth"] - 1, F.lit(0))).otherwise(state["depth"])
        said = F.struct((since > 0).alias("excepted"), piece.alias("piece"))
        longer = F.transform(state["out"], lambda one, i: F.struct(
            one["excepted"].alias("excepted"),
            F.when(i == F.size(state["out"]) - 1, F.concat(one["piece"], piece)).otherwise(one["piece"]).alias("piece"),
        ))
        # Brackets inside an exception stay in its text.
        out = (
            F.when((state["since"] > 0) & (since > 0), longer)
            .when(opens | closes, state["out"])
            .otherwise(F.array_append(state["out"], said))
        )
        return F.struct(depth.alias("depth"), since.alias("since"), opens.alias("opened"), out.alias("out"))

    return F.aggregate(pieces, start, step, lambda state: state["out"])


def zones_but(text: Column, patterns: Mapping[str, str] | None = None) -> Column:
    """``struct(states, parts)``: the names left after the exceptions, and parts of them that are excepted.

    Text counts in order: a piece adds the names it holds, an exception takes off the names that it lists on their own
    (``South India (except Kerala)``). What else it lists is a part of the name before the bracket, which stays:
    ``West Bengal (except Hills)`` gives ``West Bengal`` and the part ``(West Bengal, Hills)``; where the bracket follows a name
    that stands for several, a part that names one of them belongs to that one alone. Names are in the order of
    the patterns, parts in that of the text; a part of a name that is taken off later goes too. Without any bracket the states
    are those of :func:`furrow.functions.text.zones`; a NULL text has none of either.
    """
    patterns = patterns or STATE_PATTERNS
    names = F.array(*[F.lit(n) for n in patterns])
    alone = {n: rf"(?:^|{_BETWEEN})(?:{p})(?=\s*$|{_BETWEEN}|\.)" for n, p in patterns.items()}

    def latest(piece: Column) -> Column:
        """The names whose pattern occurs last in a piece; one word can stand for several."""
        ends = F.array_compact(F.array(*[
            F.when(piece.rlike(p), F.struct(F.length(F.regexp_extract(piece, rf"(?s)^(.*)(?:{p})", 1)).alias("at"), F.lit(n).alias("name")))
            for n, p in patterns.items()
        ]))
        return F.filter(ends, lambda e: e["at"] == F.array_max(ends)["at"])["name"]

    def read(scope: Column) -> Column:
        bare = X.strip(F.regexp_replace(scope["piece"], EXCEPTION, ""))
        off = F.array_compact(F.array(*[F.when(bare.rlike(p), F.lit(n)) for n, p in alone.items()]))
        rest = F.regexp_replace(bare, "|".join(alone.values()), "")
        listed = F.filter(F.transform(F.split(rest, _BETWEEN), lambda x: F.btrim(X.strip(x), F.lit(" ."))), lambda x: x != "")
        named = F.transform(listed, lambda x: F.struct(x.alias("text"), X.zones(x, patterns).alias("names")))
        none = F.array().cast("array<string>")
        return F.struct(
            F.when(scope["excepted"], none).otherwise(X.zones(scope["piece"], patterns)).alias("add"),
            F.when(scope["excepted"], none).otherwise(latest(scope["piece"])).alias("last"),
            F.when(scope["excepted"], off).otherwise(none).alias("off"),
            F.when(scope["excepted"], named).otherwise(F.array().cast("array<struct<text:string,names:array<string>>>")).alias("parts"),
        )

    start = F.struct(
        F.array().cast("array<string>").alias("states"),
        F.array().cast("array<string>").alias("last"),
        F.array().cast("array<struct<state:string,part:string>>").alias("parts"),
    )

    def step(state: Column, scope: Column) -> Column:
        states = F.array_union(F.array_except(state["states"], scope["off"]), scope["add"])
        added = F.flatten(F.transform(
            scope["parts"],
            lambda part: F.transform(
                F.filter(
                    F.array_except(state["last"], scope["off"]),
                    lambda name: (F.size(F.array_intersect(part["names"], state["last"])) == 0) | F.array_contains(part["names"], name),
                ),
                lambda name: F.struct(name.alias("state"), part["text"].alias("part")),
            ),
        ))
        return F.struct(
            states.alias("states"),
            F.when(F.size(scope["last"]) > 0, scope["last"]).otherwise(state["last"]).alias("last"),
            F.concat(F.filter(state["parts"], lambda p: ~F.array_contains(scope["off"], p["state"])), added).alias("parts"),
        )

    found = F.aggregate(F.transform(scopes(text), read), start, step)
    states = F.filter(names, lambda name: F.array_contains(found["states"], name))
    no_parts = F.array().cast("array<struct<state:string,part:string>>")
    plain = F.struct(F.coalesce(X.zones(text, patterns), F.array().cast("array<string>")).alias("states"), no_parts.alias("parts"))
    return F.when(text.rlike(r"[(\[{]"), F.struct(states.alias("states"), found["parts"].alias("parts"))).otherwise(plain)
