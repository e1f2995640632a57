"""Batch answers to questions from a document corpus: retrieve, prompt, summarise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.prompts import build_prompts, compose_answers, source_list, summarise_sources
from ..operators.search import CHUNK, TermIndex, bounded_k, tfidf_search
from ..session import stage

FEW_QUESTIONS = 100_000


@dataclass
class Answers:
    hits: DataFrame
    prompts: DataFrame
    summaries: DataFrame
    responses: DataFrame
    sources: DataFrame


def retrieve(index: TermIndex, questions: DataFrame, k: int = 4, query: str = "query_id", text: str = "question") -> DataFrame:
    """Best chunks per question with their text ``(query, rank, source, chunk_no, score, text)``.

    The hits of a checked number of questions go to the chunks; more than that are joined by key.
    """
    hits = tfidf_search(index, questions, query, text, bounded_k(k))
    few = questions.limit(FEW_QUESTIONS + 1).count() <= FEW_QUESTIONS
    texts = index.chunks.select(*CHUNK, "text")
    return texts.join(F.broadcast(hits) if few else hits, CHUNK).select(query, "rank", *CHUNK, "score", "text")


def answer(index: TermIndex, questions: DataFrame, k: int = 4, query: str = "query_id", text: str = "question") -> Answers:
    """Prompts and source summaries for a table of questions ``(query_id, question[, persona])``.

    Empty questions are an error, as for a single one.
    """
    blank = questions.where(F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0)
    if not blank.isEmpty():
        raise ValueError("a question must not be empty")
    # Four tables come from the hits, a few rows per question.
    hits = stage(retrieve(index, questions, k, query, text), "answers")
    summaries = summarise_sources(questions, hits, query)
    return Answers(
        hits=hits,
        prompts=build_prompts(questions, hits, query, text),
        summaries=summaries,
        responses=compose_answers(summaries, query),
        sources=source_list(hits, query),
    )
