"""Prompts and source summaries from retrieved chunks, as batch jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import preview, score_format
from .text import BLANKS, strip

# Limits and the words of the prompt frame.
MAX_SNIPPETS = 5
SUMMARY_SOURCES = 3
SUMMARY_WIDTH = 220
NO_CONTEXT = "No supporting documents were retrieved. Use general project knowledge."
NO_SUMMARY = "- No project documentation snippets were available for this query."
RULES_HEAD = "Additional business rules:"
CONTEXT_HEAD = "Context to reference:"
QUESTION_HEAD = "User question:"
ANSWER_FRAME = (
    "Provide a structured answer with:\n"
    "1. Brief summary (2 sentences)\n"
    "2. Recommended actions / talking points\n"
    "3. Optional cautionary notes if relevant"
)
# Extra rules per persona.
PERSONA_RULES: dict[str, tuple[str, ...]] = {
    "support": (
        "Keep language empathetic and customer-friendly.",
        "Offer to connect the user with a human representative for complex cases.",
    ),
    "executive": (
        "Highlight business impact in monetary or KPI terms.",
        "Keep explanations concise (<=3 bullets) and avoid technical jargon.",
    ),
    "analyst": (
        "Reference relevant notebooks or model cards for follow-up validation.",
        "Mention key metrics (precision, recall, AUCPR) when explaining model behaviour.",
    ),
}
# The frame of an answer put together without a language model.
ANSWER_HEAD = "### Summary\nLeveraging the highlighted documentation, here is a recommended response crafted without an LLM:"
ANSWER_POINTS = (
    "### Suggested talking points\n"
    "- Reference the top sources above when addressing the customer.\n"
    "- Emphasise that metrics should be validated in the analytics notebook or model card.\n"
    "- Offer to escalate to a human analyst if deeper investigation is required."
)
# Own wording, an argument of `compose_answers`.
DISCLAIMER = "_Caution: this response was put together by rules, without a language model._"
# Own wording; both texts are arguments of `build_prompts`.
SYSTEM_TEXT = (
    "You explain the results of fraud and churn analytics in plain business terms, name sensible next steps "
    "and say so when a question lies outside the material."
)
SAFETY_TEXT = (
    "Give no legal advice, reveal no customer identifiers, point privacy and fairness questions to compliance, "
    "and ask for human review where confidence is low."
)


def persona_table(spark, rules: Mapping[str, Sequence[str]] = PERSONA_RULES) -> DataFrame:
    """``(persona, rules)``, a handful of rows."""
    return spark.createDataFrame([(p, list(r)) for p, r in rules.items()], "persona string, rules array<string>")


def with_persona_rules(queries: DataFrame, persona: str = "persona", rules: Mapping[str, Sequence[str]] = PERSONA_RULES) -> DataFrame:
    """Add ``rules``; an unknown or missing persona has none."""
    known = persona_table(queries.sparkSession, rules).withColumnRenamed("persona", persona)
    joined = queries.join(F.broadcast(known), persona, "left")
    return joined.withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))


def _ranked_texts(hits: DataFrame, query: str, limit: int) -> DataFrame:
    """Texts of the best hits per query, in order: at most ``limit`` per group."""
    top = hits.where(F.col("rank") <= limit)
    packed = top.groupBy(query).agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("h"))
    return packed.select(query, F.transform("h", lambda x: x["text"]).alias("texts"))


def build_prompts(
    queries: DataFrame,
    hits: DataFrame,
    query: str = "query_id",
    question: str = "question",
    persona: str = "persona",
    system: str = SYSTEM_TEXT,
    safety: str = SAFETY_TEXT,
    limit: int = MAX_SNIPPETS,
) -> DataFrame:
    """``(query, prompt)``: system text, safety text, persona rules, numbered context and question.

    ``hits`` is ``(query, rank, text)``. A query without hits gets a fixed sentence for context.
    """
    rows = with_persona_rules(queries, persona) if persona in queries.columns else queries.withColumn(
        "rules", F.array().cast("array<string>")
    )
    rows = rows.join(_ranked_texts(hits, query, limit), query, "left")
    numbered = F.transform(
        "texts", lambda t, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit("]\n"), strip(t))
    )
    context = F.when(F.size("texts") > 0, F.array_join(numbered, "\n\n")).otherwise(F.lit(NO_CONTEXT))
    rules = F.when(
        F.size("rules") > 0, F.concat(F.lit(f"{RULES_HEAD}\n- "), F.array_join("rules", "\n- "))
    )
    blocks = [
        F.lit(system.strip()),
        F.lit(safety.strip()),
        rules,
        F.concat(F.lit(f"{CONTEXT_HEAD}\n"), context),
        F.concat(F.lit(f"{QUESTION_HEAD}\n"), strip(F.col(question))),
        F.lit(ANSWER_FRAME),
    ]
    return rows.select(query, F.concat_ws("\n\n", *blocks).alias("prompt"))


def shorten(text: Column, width: int = SUMMARY_WIDTH) -> Column:
    """One line of at most ``width`` characters, cut after a word, with an ellipsis when cut.

    A hyphen between letters may end the line too. A first word too long for the line leaves the
    ellipsis alone.
    """
    line = F.trim(F.regexp_replace(text, f"[{BLANKS}]+", " "))
    letter = r"[\p{L}_]"
    word_end = rf"(?= )|(?<={letter}{letter}-)(?={letter}-?{letter})"
    head = F.regexp_extract(line, rf"^(.{{1,{width - 1}}})(?:{word_end})", 1)
    return F.when(F.length(line) <= width, line).otherwise(F.concat(F.rtrim(head), F.lit("…")))


def summarise_sources(
    queries: DataFrame, hits: DataFrame, query: str = "query_id", limit: int = SUMMARY_SOURCES, width: int = SUMMARY_WIDTH
) -> DataFrame:
    """``(query, summary)``: one line per source, or a fixed line when there is none."""
    rows = queries.select(query).join(_ranked_texts(hits, query, limit), query, "left")
    lines = F.transform(
        "texts", lambda t, i: F.concat(F.lit("- Source "), (i + 1).cast("string"), F.lit(": "), shorten(t, width))
    )
    return rows.select(query, F.when(F.size("texts") > 0, F.array_join(lines, "\n")).otherwise(F.lit(NO_SUMMARY)).alias("summary"))


def compose_answers(summaries: DataFrame, query: str = "query_id", disclaimer: str | None = DISCLAIMER) -> DataFrame:
    """``(query, response)``: the fixed frame around each summary, with a closing note unless it is None."""
    blocks = [F.lit(ANSWER_HEAD), F.col("summary"), F.lit(ANSWER_POINTS)] + ([F.lit(disclaimer)] if disclaimer else [])
    return summaries.select(query, F.concat_ws("\n\n", *blocks).alias("response"))


def source_list(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """Sources as shown to a reader: ``(query, rank, source, score, preview)`` as text."""
    return hits.select(query, "rank", F.col("source").cast("string").alias("source"), score_format("score").alias("score"), preview("text").alias("preview"))
