"""Chunks, terms, retrieval, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.stopwords import ENGLISH
from riskloom.operators import prompts as pt
from riskloom.operators import search as se
from riskloom.operators import text as tx
from riskloom.plans.assistant import answer, retrieve
from riskloom.session import stage

from .tables import table

K = 4


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _chunks(spark, d):
    documents = _documents(spark, d)
    # A table of one row group is read by one task; the texts are spread before they are cut.
    found = tx.chunk_documents(documents.repartition("doc_id", "text"), "text", "doc_id")
    return tx.or_placeholder(found) if tx.chunk_documents(documents, "text", "doc_id").isEmpty() else found


def _questions(spark, d):
    persona = F.element_at(F.array(*[F.lit(p) for p in ("support", "executive", "analyst", "visitor")]), (F.col("item_id") % 4 + 1).cast("int"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), persona.alias("persona"))


def _hits(spark, d):
    return retrieve(se.build_term_index(_chunks(spark, d)), _questions(spark, d), K)


def paragraphs(spark, d):
    # The texts have no blank lines, so one line break separates paragraphs here.
    rows = tx.split_paragraphs(_documents(spark, d), "text", r"\n+")
    return rows.select("doc_id", "paragraph_no", "paragraph")


def chunks(spark, d):
    return _chunks(spark, d)


def term_counts(spark, d):
    # As the index does: chunks are spread by their own key and counted where they are.
    chunks = stage(_chunks(spark, d), "chunks")
    return tx.term_counts(tx.spread(chunks, "text", ["source", "chunk_no"]), ["source", "chunk_no"], "text")


def tfidf_weights(spark, d):
    index = se.build_term_index(_chunks(spark, d))
    return index.weights().withColumn("weight", F.round("weight", 7))


def tfidf_search(spark, d):
    index = se.build_term_index(_chunks(spark, d))
    return se.tfidf_search(index, _questions(spark, d), "query_id", "question", K).withColumn("score", F.round("score", 7))


def vector_search(spark, d):
    vectors = table(spark, d, "embeddings")
    # The centre of each label asks for its nearest vectors.
    entries = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = entries.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("e"))
    queries = centres.select("label", F.transform("e", lambda s: s["x"]).alias("centre"))
    out = se.vector_search(vectors.select("vec_id", "embedding"), "vec_id", "embedding", queries, "label", "centre", 8)
    return out.withColumn("score", F.round("score", 7))


def prompts(spark, d):
    return pt.build_prompts(_questions(spark, d), _hits(spark, d))


def summaries(spark, d):
    return answer(se.build_term_index(_chunks(spark, d)), _questions(spark, d), K).summaries


def responses(spark, d):
    return answer(se.build_term_index(_chunks(spark, d)), _questions(spark, d), K).responses


def sources(spark, d):
    return pt.source_list(_hits(spark, d))


def personas(spark, d):
    rows = pt.with_persona_rules(_questions(spark, d))
    return rows.select("query_id", "persona", F.concat_ws(" | ", "rules").alias("rules"))


QUERIES = {
    "split_paragraphs": paragraphs,
    "chunks": chunks,
    "term_counts": term_counts,
    "tfidf_index": tfidf_weights,
    "tfidf_search": tfidf_search,
    "vector_search": vector_search,
    "persona_lookup": personas,
    "prompts": prompts,
    "summaries": summaries,
    "responses": responses,
    "source_list": sources,
}

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

CHUNKS_SQL = rf"""
  WITH RECURSIVE p AS (
    SELECT doc_id, para, {STRIP.format('x')} AS x
    FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n{{2,}}')) AS x, generate_subscripts(regexp_split_to_array(text, '\n{{2,}}'), 1) AS para FROM documents)),
  s AS (SELECT doc_id, para, string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS t FROM p WHERE length(x) > {tx.MAX_CHARS}),
  r AS (
    SELECT doc_id, para, 1 AS i, length(t[1]) AS n, 0 AS g FROM s
    UNION ALL
    SELECT r.doc_id, r.para, i + 1, CASE WHEN n + length(t[i + 1]) > {tx.MAX_CHARS} THEN length(t[i + 1]) ELSE n + length(t[i + 1]) END,
           g + CAST(n + length(t[i + 1]) > {tx.MAX_CHARS} AS INTEGER)
    FROM r JOIN s ON r.doc_id = s.doc_id AND r.para = s.para WHERE i < len(t)),
  c AS (
    SELECT doc_id, para, g, {STRIP.format("string_agg(t[i], ' ' ORDER BY i)")} AS text FROM r JOIN s USING (doc_id, para) GROUP BY doc_id, para, g
    UNION ALL SELECT doc_id, para, 0, x FROM p WHERE length(x) <= {tx.MAX_CHARS})
  SELECT doc_id AS source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para, g) - 1 AS INTEGER) AS chunk_no, text
  FROM c WHERE length(text) >= {tx.MIN_CHARS}
"""

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in ENGLISH) + ")"


def _counts_sql(source: str, keys: str) -> str:
    return rf"""
      SELECT {keys}, term, count(*) AS tf
      FROM (SELECT {keys}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]{{2,}}')) AS term FROM ({source}))
      WHERE term NOT IN {STOP_SQL} GROUP BY {keys}, term"""


QUESTIONS_SQL = "SELECT item_id AS query_id, text AS question, text, (['support', 'executive', 'analyst', 'visitor'])[item_id % 4 + 1] AS persona FROM benchmark"

# Chunks, weights of chunks and of questions, and hits, as common table expressions.
INDEX_CTE = f"""
  ch AS MATERIALIZED ({CHUNKS_SQL}),
  tf AS MATERIALIZED ({_counts_sql('SELECT * FROM ch', 'source, chunk_no')}),
  idf AS MATERIALIZED (SELECT term, ln((1 + (SELECT count(*) FROM ch)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
  w AS MATERIALIZED (SELECT source, chunk_no, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY source, chunk_no)) AS weight
        FROM tf JOIN idf USING (term))"""
HITS_CTE = f"""{INDEX_CTE},
  qt AS ({_counts_sql(QUESTIONS_SQL, 'query_id')}),
  qw AS (SELECT query_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY query_id)) AS weight FROM qt JOIN idf USING (term)),
  sc AS (SELECT query_id, source, chunk_no, round(sum(w.weight * qw.weight), {se.SCORE_DIGITS}) AS score FROM w JOIN qw USING (term) GROUP BY ALL),
  al AS (SELECT query_id, source, chunk_no, coalesce(score, 0.0) AS score
         FROM (SELECT query_id, source, chunk_no FROM ({QUESTIONS_SQL}), ch) LEFT JOIN sc USING (query_id, source, chunk_no)),
  hits AS MATERIALIZED (
    SELECT query_id, CAST(rank AS INTEGER) AS rank, source, chunk_no, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source DESC, chunk_no DESC) AS rank FROM al) WHERE rank <= {K}),
  ht AS MATERIALIZED (SELECT hits.*, ch.text FROM hits JOIN ch USING (source, chunk_no))"""

RULES_SQL = " ".join(f"WHEN '{p}' THEN ['" + "', '".join(r.replace("'", "''") for r in rules) + "']" for p, rules in pt.PERSONA_RULES.items())
NL = "chr(10)"

SUMMARY_CTE = rf"""{HITS_CTE},
  ln AS (SELECT query_id, rank, {STRIP.format(r"regexp_replace(text, '\s+', ' ', 'g')")} AS t FROM ht WHERE rank <= {pt.SUMMARY_SOURCES}),
  sh AS (SELECT query_id, rank, CASE WHEN length(t) <= {pt.SUMMARY_WIDTH} THEN t
           ELSE regexp_extract(t, '^(.{{1,{pt.SUMMARY_WIDTH - 1}}}) ', 1) || '…' END AS t FROM ln),
  su AS (SELECT query_id, string_agg('- Source ' || rank || ': ' || t, {NL} ORDER BY rank) AS summary FROM sh GROUP BY query_id)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL = {
    "split_paragraphs": rf"""
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS paragraph_no, x AS paragraph FROM (
          SELECT doc_id, i, {STRIP.format('x')} AS x FROM (
            SELECT doc_id, unnest(regexp_split_to_array(text, '\n+')) AS x, generate_subscripts(regexp_split_to_array(text, '\n+'), 1) AS i FROM documents))
        WHERE length(x) > 0""",
    "chunks": CHUNKS_SQL,
    "term_counts": _counts_sql(CHUNKS_SQL, "source, chunk_no"),
    "tfidf_index": f"WITH {INDEX_CTE} SELECT source, chunk_no, term, round(weight, 7) AS weight FROM w",
    "tfidf_search": f"WITH {HITS_CTE} SELECT query_id, rank, source, chunk_no, round(score, 7) AS score FROM hits",
    "vector_search": f"""
        WITH e AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY label, i),
        q AS (SELECT label, list(x ORDER BY i) AS c FROM e GROUP BY label),
        s AS (SELECT q.label, vec_id, round(list_inner_product(c, embedding::DOUBLE[])
                / sqrt(list_inner_product(c, c) * list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), {se.SCORE_DIGITS}) AS score FROM q, embeddings)
        SELECT label, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 7) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id DESC) AS rank FROM s) WHERE rank <= 8""",
    "persona_lookup": f"""
        SELECT query_id, persona, coalesce(array_to_string(CASE persona {RULES_SQL} END, ' | '), '') AS rules FROM ({QUESTIONS_SQL})""",
    "prompts": f"""
        WITH {HITS_CTE},
        cx AS (SELECT query_id, string_agg('[Source ' || rank || ']' || {NL} || {STRIP.format('text')}, {NL} || {NL} ORDER BY rank) AS c FROM ht GROUP BY 1)
        SELECT query_id, concat_ws({NL} || {NL}, {_quoted(pt.SYSTEM_TEXT)}, {_quoted(pt.SAFETY_TEXT)},
               '{pt.RULES_HEAD}' || {NL} || '- ' || array_to_string(CASE persona {RULES_SQL} END, {NL} || '- '),
               '{pt.CONTEXT_HEAD}' || {NL} || coalesce(c, {_quoted(pt.NO_CONTEXT)}),
               '{pt.QUESTION_HEAD}' || {NL} || {STRIP.format('question')}, {_quoted(pt.ANSWER_FRAME)}) AS prompt
        FROM ({QUESTIONS_SQL}) LEFT JOIN cx USING (query_id)""",
    "summaries": f"WITH {SUMMARY_CTE} SELECT query_id, summary FROM su",
    "responses": f"""
        WITH {SUMMARY_CTE}
        SELECT query_id, concat_ws({NL} || {NL}, {_quoted(pt.ANSWER_HEAD)}, summary, {_quoted(pt.ANSWER_POINTS)}, {_quoted(pt.DISCLAIMER)}) AS response
        FROM su""",
    "source_list": f"""
        WITH {HITS_CTE}
        SELECT query_id, rank, CAST(source AS VARCHAR) AS source, format('{{:.3f}}', score) AS score,
               replace(substr(text, 1, 180), {NL}, ' ') || CASE WHEN length(text) > 180 THEN '…' ELSE '' END AS preview FROM ht""",
}
