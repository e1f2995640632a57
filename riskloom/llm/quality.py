"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one ``long`` whose bit *k* says that
rule *k* failed. A policy is a named, versioned mask of rules; applying or ablating one is arithmetic on the bits and
never reads a text again. Each document is judged in its own row: nothing is shuffled, and a text of any length is
measured whole.

Null or empty text has no words, fails ``few_words`` and no rule on ratios. Repeated rows are judged alike. Other
columns of the input, also ones named like a measurement, pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, fresh, text_or_empty, without, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; ``bit`` never changes once ledgers are stored."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version of the rules in force."""

    name: str
    version: int
    rules: tuple[str, ...]


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 20 * n_words"),
    Rule(5, "duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
)
BASE = Policy("base", 1, ("few_words", "repeated_windows"))
WEB = Policy("web", 2, tuple(r.name for r in RULES))


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[name] for name in set(policy.rules))


def _covered(sorted_hits: Column) -> Column:
    """Words covered by windows at these ascending starts: overlaps count once."""
    steps = F.transform(sorted_hits, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(sorted_hits, i + 1) - x, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "ledger") -> DataFrame:
    """``docs`` with a struct ``into``: the measurements and ``failures``, the bits of the failed rules.

    Measurements: ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_lines`` (lines with a word),
    ``n_dup_lines`` (lines equal to an earlier one), ``n_repeat_words`` (words inside 5-word windows that occur twice).
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {into} exists; choose another name with fresh()")
    w, t, s, hits, lines, m = (fresh(docs, f"_{x}") for x in ("words", "text", "sorted", "hits", "lines", "measures"))
    split = docs.withColumn(t, text_or_empty(F.col(text)))
    split = split.withColumn(w, words(F.col(t)))
    split = split.withColumn(lines, F.filter(F.split(F.col(t), "\n"), lambda x: F.length(without(x, SPACES)) > 0))

    # A window is known by the hash of its five words. Only texts with a repeated hash are sorted.
    window = F.transform(
        F.slice(F.col(w), F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(F.col(w), i + k) for k in range(1, WINDOW)]),
    )
    split = split.withColumn(hits, window)
    pairs = F.sort_array(F.transform(F.col(hits), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    split = split.withColumn(s, F.when(F.size(F.array_distinct(hits)) < F.size(hits), pairs))
    twice = F.filter(
        F.col(s),
        lambda x, i: (F.get(F.col(s), i - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get(F.col(s), i + 1)["h"] == x["h"]).eqNullSafe(True),
    )
    starts = fresh(docs, "_starts")
    split = split.withColumn(starts, F.sort_array(F.transform(twice, lambda x: x["i"])))

    long = lambda c: c.cast("long")
    measures = F.struct(
        long(F.size(w)).alias("n_words"),
        long(F.length(without(F.col(t), SPACES))).alias("word_chars"),
        long(F.length(t) - F.length(without(F.col(t), SYMBOLS))).alias("n_symbols"),
        long(F.size(lines)).alias("n_lines"),
        long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        F.coalesce(_covered(F.col(starts)), F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    measured = split.withColumn(m, measures)
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    bits = F.lit(0).cast("long")
    for rule in rules:
        failed = F.expr(_qualified(rule.fails, m, names))
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(*[F.col(m)[n].alias(n) for n in names], bits.alias("failures")).alias(into),
    )


def _qualified(sql: str, struct: str, names: tuple[str, ...]) -> str:
    return " ".join(f"`{struct}`.`{part}`" if part in names else part for part in sql.split())


def passes(failures: Column, policy: Policy) -> Column:
    """Whether none of the policy's rules failed."""
    return failures.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def apply_policy(ledgered: DataFrame, policy: Policy, into: str = "ledger") -> DataFrame:
    """Documents that pass, without the ledger.

    The row number keeps the optimizer from writing every measurement out again inside the filter.
    """
    row = fresh(ledgered, "_row")
    held = ledgered.withColumn(row, F.monotonically_increasing_id())
    return held.filter(passes(F.col(into)["failures"], policy) & (F.col(row) >= 0)).drop(into, row)


def ablation(ledgered: DataFrame, policy: Policy, into: str = "ledger", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents it fails, documents only it fails, documents kept without it.

    One aggregate over the failure bits, summed before the shuffle; an empty table gives zeros.
    """
    failures = F.col(into)["failures"].bitwiseAND(F.lit(mask(policy, rules)).cast("long"))
    used = [r for r in rules if r.name in policy.rules]
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    sums = []
    for r in used:
        bit = F.lit(1 << r.bit).cast("long")
        sums += [
            F.lit(r.name), one(failures.bitwiseAND(bit) != 0), one(failures == bit), one((failures == 0) | (failures == bit)),
        ]
    row = ledgered.agg(
        F.array(*[
            F.struct(sums[k].alias("rule"), sums[k + 1].alias("failed"), sums[k + 2].alias("failed_alone"), sums[k + 3].alias("kept_without"))
            for k in range(0, len(sums), 4)
        ]).alias("rows")
    )
    return row.select(F.inline("rows"))
