"""Secret scan: known patterns, and strings whose characters look random.

Known kinds are found by pattern, leftmost and non-overlapping per kind. Candidate strings of one character class are
then scanned by a sliding window whose Shannon entropy is kept up by counts: a character enters, another leaves, and the
sum of ``c * log2(c)`` changes by those two terms alone. Windows at or above the class's threshold are joined into one
span. Placeholders of the allow-list cut a candidate: no window holds a character of them, and what is left on either side
is a candidate of its own. Hexadecimal runs are candidates also inside longer ones. The known kinds are never suppressed.

Spans are ``struct(kind, start, end)`` in code points, end exclusive. Every document is scanned in its own row over its
whole text, by SQL functions only. Null or empty text has no spans, repeated rows have equal spans, and other columns
pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, let, text_or_empty

SPAN = "array<struct<kind:string,start:int,end:int>>"
_KEYS = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Known:
    """A pattern; matches whose ``group`` has fewer than ``least`` characters are dropped after matching."""

    kind: str
    pattern: str
    group: int
    least: int


#: In the order in which spans of equal start are listed. A run of hexadecimal digits is matched from its length on:
#: maximal runs cannot overlap, so the shorter ones need no match. So it is for the access keys, too.
KNOWN = (
    Known(
        "assign",
        "(" + "|".join(_either_case(k) for k in _KEYS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Known("access", "AKIA[A-Z0-9]{14,}", 0, 18),
    Known("hex", "[0-9a-f]{16,}", 0, 16),
)


@dataclass(frozen=True)
class CharClass:
    """Candidates ``pattern`` that hold ``needs``; a window of ``window`` characters is random from ``threshold`` bits on.

    With ``run``, the runs of that pattern in such strings are the candidates.
    """

    kind: str
    pattern: str
    needs: tuple[str, ...]
    excludes: str
    window: int
    threshold: float
    run: str | None = None


CLASSES = (
    CharClass("entropy_hex", "[0-9A-Za-z+/_-]{20,}", ("[0-9]", "[A-Fa-f]"), "[^0-9A-Fa-f]", 20, 2.75, "[0-9A-Fa-f]{20,}"),
    CharClass("entropy_base64", "[0-9A-Za-z+/_-]{20,}", ("[0-9]", "[A-Za-z]"), "^[0-9A-Fa-f]+$", 20, 3.71),
)
#: Parts of candidates that are no secrets: alphabets, counted digits, placeholders, one character repeated.
ALLOWED = ("(?i)abcdefghij", "0123456789", "(?i)example", "(?i)placeholder", "(?i)xxxxxxxx", "00000000")

_FIRST, _SLOTS = ord("+"), ord("z") - ord("+") + 1


def _located(found: Column, pieces: Column) -> Column:
    """Matches with their places, leftmost and non-overlapping: the pieces between them give the offsets."""

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(F.get(pieces, acc["n"]))
        span = F.struct(m.alias("match"), start.alias("start"), (start + F.length(m)).alias("end"))
        return F.struct((start + F.length(m)).alias("at"), (acc["n"] + 1).alias("n"), F.array_append(acc["spans"], span).alias("spans"))

    empty = F.array().cast("array<struct<match:string,start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), empty.alias("spans"))
    return F.when(F.size(found) > 0, F.aggregate(found, start, step, lambda acc: acc["spans"])).otherwise(empty)


def _known(located: Column, known: Known) -> Column:
    kept = F.filter(
        located,
        lambda x: F.length(F.regexp_extract(x["match"], known.pattern, known.group)) >= known.least,
    )
    return F.transform(kept, lambda x: F.struct(F.lit(known.kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _random_part(candidate: Column, window: int, threshold: float) -> Column:
    """First start and last end (relative) of windows at or above the threshold; ``first`` is -1 if none."""
    def term(count: Column) -> Column:
        return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(0.0)

    zero = F.array_repeat(F.lit(0), _SLOTS)

    def step(codes: Column, acc: Column, code: Column) -> Column:
        old = F.when(acc["i"] >= window, F.get(codes, acc["i"] - window)).otherwise(F.lit(-1))
        entered = acc["total"] + term(F.get(acc["counts"], code) + 1) - term(F.get(acc["counts"], code))
        held = F.get(acc["counts"], old) + F.when(old == code, 1).otherwise(0)
        total = F.when(old < 0, entered).otherwise(entered - term(held) + term(held - 1))
        full = acc["i"] + 1 >= window
        random = full & (F.lit(log2(window)) - total / window >= threshold)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            total.alias("total"),
            F.transform(
                acc["counts"],
                lambda c, k: c + F.when(k == code, 1).otherwise(0) - F.when(k == old, 1).otherwise(0),
            ).alias("counts"),
            F.when(random & (acc["first"] < 0), acc["i"] + 1 - window).otherwise(acc["first"]).alias("first"),
            F.when(random, acc["i"] + 1).otherwise(acc["last"]).alias("last"),
        )

    start = F.struct(
        F.lit(0).alias("i"), F.lit(0.0).alias("total"), zero.alias("counts"), F.lit(-1).alias("first"), F.lit(-1).alias("last")
    )

    def scanned(codes: Column) -> Column:
        return F.aggregate(
            codes, start, lambda acc, c: step(codes, acc, c), lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last"))
        )

    letters = F.filter(F.split(candidate, ""), lambda c: c != "")
    return let(F.transform(letters, lambda c: F.ascii(c) - _FIRST), scanned)


def _inside(x: Column, match: Column, start: Column) -> Column:
    """A part of the candidate ``x``, placed in the text."""
    return F.struct(match.alias("match"), (x["start"] + start).alias("start"), (x["start"] + start + F.length(match)).alias("end"))


def _matches(text: Column, pattern: str) -> Column:
    return _located(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))


def _cut(located: Column, allowed: tuple[str, ...]) -> Column:
    """The parts of candidates between placeholders."""
    if not allowed:
        return located
    any_ = "|".join(f"(?:{p})" for p in allowed)

    def between(x: Column) -> Column:
        def parts(held: Column) -> Column:
            after = lambda k: F.when(k > 0, F.get(held, k - 1)["end"]).otherwise(0)
            return F.transform(F.split(x["match"], any_, -1), lambda p, k: _inside(x, p, after(k)))

        return let(_matches(x["match"], any_), parts)

    return F.flatten(F.transform(located, between))


def _candidates(located: Column, group: CharClass, allowed: tuple[str, ...]) -> Column:
    def wanted(x: Column) -> Column:
        ok = (F.length(x["match"]) >= group.window) & ~x["match"].rlike(group.excludes)
        for pattern in group.needs:
            ok = ok & x["match"].rlike(pattern)
        return ok

    parts = _cut(located, allowed)
    if group.run:
        runs = lambda x: F.transform(_matches(x["match"], group.run), lambda r: _inside(x, r["match"], r["start"]))
        parts = F.flatten(F.transform(parts, runs))
    return F.filter(parts, wanted)


def _by_entropy(candidates: Column, group: CharClass) -> Column:
    scored = F.transform(
        candidates,
        lambda x: F.struct(x["start"].alias("at"), _random_part(x["match"], group.window, group.threshold).alias("part")),
    )
    return F.transform(
        F.filter(scored, lambda x: x["part"]["first"] >= 0),
        lambda x: F.struct(
            F.lit(group.kind).alias("kind"), (x["at"] + x["part"]["first"]).alias("start"), (x["at"] + x["part"]["last"]).alias("end")
        ),
    )


def _ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))


def scan(
    docs: DataFrame,
    text: str = "text",
    into: str = "secrets",
    known: tuple[Known, ...] = KNOWN,
    classes: tuple[CharClass, ...] = CLASSES,
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """``docs`` with a struct ``into``: ``known`` (spans of the patterns) and ``spans`` (those and the random strings).

    Both are sorted by start, then by kind in the order of ``known`` and ``classes``.
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {into} exists; choose another name with fresh()")
    t = fresh(docs, "_text")
    staged = docs.withColumn(t, text_or_empty(F.col(text)))
    names = {k.kind: fresh(docs, f"_{k.kind}") for k in (*known, *classes)}
    # Each pattern runs once over the text; only where it matches is the text cut, and each result is a column of its
    # own, so that no lambda computes it again.
    patterns = {p: n for n, p in enumerate(dict.fromkeys(x.pattern for x in (*known, *classes)))}
    found, pieces, located = ({p: fresh(docs, f"_{w}{n}") for p, n in patterns.items()} for w in ("found", "pieces", "located"))
    staged = staged.withColumns({found[p]: F.regexp_extract_all(F.col(t), F.lit(p), F.lit(0)) for p in patterns})
    staged = staged.withColumns({pieces[p]: F.when(F.size(found[p]) > 0, F.split(F.col(t), p, -1)) for p in patterns})
    staged = staged.withColumns({located[p]: _located(F.col(found[p]), F.col(pieces[p])) for p in patterns})
    staged = staged.withColumns(
        {names[k.kind]: _known(F.col(located[k.pattern]), k) for k in known}
        | {names[c.kind]: _candidates(F.col(located[c.pattern]), c, allowed) for c in classes}
    )
    staged = staged.withColumns({names[c.kind]: _by_entropy(F.col(names[c.kind]), c) for c in classes})
    order = [k.kind for k in (*known, *classes)]

    def in_order(kinds: list[str]) -> Column:
        ranked = F.flatten(F.array(*[_ranked(F.col(names[k]), order.index(k)) for k in kinds]))
        labels = F.array(*[F.lit(k) for k in order])
        return F.transform(
            F.array_sort(ranked),
            lambda x: F.struct(F.get(labels, x["rank"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
        )

    return staged.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(in_order([k.kind for k in known]).alias("known"), in_order(order).alias("spans")).alias(into),
    )


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def digest(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", into: str = "secrets", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` (scanned) with every span replaced by ``mark``; overlapping spans give one mark. Null text stays null."""
    chars = text_or_empty(F.col(text))
    walk = F.aggregate(
        F.col(into)["spans"],
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(x["start"] < acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], F.substring(chars, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)))
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(chars, acc["at"] + 1, F.length(chars))),
    )
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), walk)).drop(into)
