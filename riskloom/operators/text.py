"""Documents to chunks, chunks to terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stopwords import ENGLISH

# Chunk sizes, separators and the word pattern.
MIN_CHARS = 120
MAX_CHARS = 1200
PARAGRAPH = r"\n{2,}"
SENTENCE = r"(?<=[.!?])[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"(?U)\b\w\w+\b"
# Characters of a task that counts terms: their counts, some 20 times as large, are in its memory.
TASK_CHARS = 4_000_000
EMPTY_TEXT = "No documentation available. Respond with general project guidance."
EMPTY_SOURCE = "<empty>"


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def paragraphs(text: Column, pattern: str = PARAGRAPH) -> Column:
    """Non-empty trimmed paragraphs as an array."""
    return F.filter(F.transform(F.split(text, pattern), strip), lambda p: F.length(p) > 0)


def split_paragraphs(df: DataFrame, text: str, pattern: str = PARAGRAPH) -> DataFrame:
    """One row per paragraph: ``(*others, paragraph_no, paragraph)``."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(paragraphs(F.col(text), pattern)).alias("paragraph_no", "paragraph"))


def pack_sentences(paragraph: Column, max_chars: int = MAX_CHARS) -> Column:
    """Fill pieces with whole sentences up to ``max_chars``, blanks between them not counted.

    A sentence longer than the limit stays whole. The fold keeps the piece under construction and
    copies the finished ones only when a piece is closed.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("buf"), F.lit(0).alias("n")
    )

    def step(state: Column, sentence: Column) -> Column:
        size = F.length(sentence)
        full = state["buf"].isNotNull() & (state["n"] + size > max_chars)
        return F.struct(
            F.when(full, F.concat(state["out"], F.array(state["buf"]))).otherwise(state["out"]).alias("out"),
            F.when(full | state["buf"].isNull(), sentence).otherwise(F.concat(state["buf"], F.lit(" "), sentence)).alias("buf"),
            F.when(full, size).otherwise(state["n"] + size).alias("n"),
        )

    finish = lambda state: F.concat(state["out"], F.array(state["buf"]))
    return F.transform(F.aggregate(F.split(paragraph, SENTENCE), start, step, finish), strip)


def chunk_documents(
    df: DataFrame,
    text: str,
    source: str,
    min_chars: int = MIN_CHARS,
    max_chars: int = MAX_CHARS,
    pattern: str = PARAGRAPH,
) -> DataFrame:
    """Chunks ``(source, chunk_no, text)`` of ``min_chars`` up, split further above ``max_chars``.

    The whole text is used; a document is cut in the task that reads it, without a shuffle.
    """
    pieces = F.transform(
        paragraphs(F.col(text), pattern),
        lambda p: F.when(F.length(p) <= max_chars, F.array(p)).otherwise(pack_sentences(p, max_chars)),
    )
    kept = F.filter(F.flatten(pieces), lambda c: F.length(c) >= min_chars)
    return df.select(F.col(source).alias("source"), F.posexplode(kept).alias("chunk_no", "text"))


def or_placeholder(chunks: DataFrame, text: str = EMPTY_TEXT, source: str = EMPTY_SOURCE) -> DataFrame:
    """One placeholder chunk when nothing was read."""
    if not chunks.isEmpty():
        return chunks
    row = chunks.sparkSession.range(1).select(F.lit(source).alias("source"), F.lit(0).alias("chunk_no"), F.lit(text).alias("text"))
    return row.select(*[F.col(f.name).cast(f.dataType) if f.name in row.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in chunks.schema.fields])


def tokens(text: Column, stop_words: Sequence[str] = ENGLISH) -> Column:
    """Lower-case words of two or more characters without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    if not stop_words:
        return words
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def spread(df: DataFrame, text: str, by: Sequence[str]) -> DataFrame:
    """The rows dealt out by some columns to tasks of about ``TASK_CHARS`` characters, however many tasks that makes.

    Without the number, adaptive execution would make a task of up to 64 MB of packed texts.
    """
    chars = df.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    return df.repartition(max(1, -(-chars // TASK_CHARS)), *by)


def term_counts(df: DataFrame, keys: Sequence[str], text: str, stop_words: Sequence[str] = ENGLISH) -> DataFrame:
    """Occurrences per term ``(*keys, term, tf)``.

    Terms are summed map-side. Where the keys are unique, as for chunks, ``spread(df, text, keys)`` before
    it moves each text once instead of its terms and spares the shuffle of the counts.
    """
    return (
        df.select(*keys, F.explode(tokens(F.col(text), stop_words)).alias("term"))
        .groupBy(*keys, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
