import math
import re
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions.stopwords import ENGLISH
from riskloom.operators import prompts as pt
from riskloom.operators import search as se
from riskloom.operators import text as tx
from riskloom.plans.assistant import answer

from helpers import plan_of


def pieces(text, low=120, high=1200):
    """Chunks as the documentation describes them, for one text."""
    out = []
    for block in (b.strip() for b in re.split(r"\n{2,}", text)):
        if not block:
            continue
        if len(block) <= high:
            candidates = [block]
        else:
            candidates, line, size = [], [], 0
            for s in re.split(r"(?<=[.!?])\s+", block):
                if line and size + len(s) > high:
                    candidates.append(" ".join(line))
                    line, size = [], 0
                line.append(s)
                size += len(s)
            candidates.append(" ".join(line))
        out += [c.strip() for c in candidates if len(c.strip()) >= low]
    return out


def words(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        word = "".join(rng.choice(list("abcdeéfg"), rng.integers(1, 9)))
        out.append(word + rng.choice(["", "", "", ".", "!", "?\n"]))
    return " ".join(out)


TEXTS = {
    "short": "x" * 119,
    "least": "x" * 120,
    "full": "y" * 1200,
    "over": "z" * 1201,
    "two": "a" * 130 + "\n\n\n" + "  " + "b" * 140 + "\t\n\n\n\n",
    "long": words(1500, 1),
    "mixed": words(300, 2) + "\n\n" + words(40, 3) + "\n\n" + "q" * 1300 + ". " + words(200, 4),
    "tail": "w" * 1190 + ". " + "v" * 50 + ".",
    "blank": "\n\n\n  ",
    "odd blanks": "\u2003\xa0" + "k" * 150 + "\x1c\u3000" + "\n\n" + ("m" * 500 + ".\u2009\x1f" + "n" * 400 + "!\xa0") * 3,
}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(list(TEXTS.items()), "name string, body string")


def test_chunks(documents):
    got = {}
    for r in tx.chunk_documents(documents, "body", "name").collect():
        got.setdefault(r["source"], []).append((r["chunk_no"], r["text"]))
    for name, text in TEXTS.items():
        assert [t for _, t in sorted(got.get(name, []))] == pieces(text), name
    assert [n for n, _ in sorted(got["long"])] == list(range(len(got["long"])))


def test_chunking_needs_no_shuffle(documents):
    assert "Exchange" not in plan_of(tx.chunk_documents(documents, "body", "name"))


def test_paragraphs(documents):
    rows = tx.split_paragraphs(documents.where("name = 'two'"), "body").collect()
    assert [(r["paragraph_no"], len(r["paragraph"])) for r in rows] == [(0, 130), (1, 140)]


def test_placeholder(spark, documents):
    empty = tx.chunk_documents(documents.where("name = 'blank'"), "body", "name")
    assert [r.asDict() for r in tx.or_placeholder(empty).collect()] == [{"source": tx.EMPTY_SOURCE, "chunk_no": 0, "text": tx.EMPTY_TEXT}]
    full = tx.chunk_documents(documents, "body", "name")
    assert tx.or_placeholder(full) is full


def tokenise(text):
    return [w for w in re.findall(r"(?u)\b\w\w+\b", text.lower()) if w not in ENGLISH]


def test_tokens(spark):
    text = "The Élan of a re-build: snake_case, x, 42 and don't 日本語 ΑΒΓ"
    df = spark.createDataFrame([(text,)], "t string").select(tx.tokens(F.col("t")).alias("w"))
    assert df.first()["w"] == tokenise(text)


CORPUS = [
    ("a", 0, "fraud score threshold fraud"),
    ("a", 1, "churn score retention"),
    ("b", 0, "drift report threshold"),
    ("b", 1, "churn score retention"),
    ("c", 0, "governance"),
]


def reference_search(corpus, query, k):
    docs = [tokenise(t) for _, _, t in corpus]
    n = len(docs)
    df = Counter(w for d in docs for w in set(d))
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}

    def weigh(tokens):
        v = {w: c * idf[w] for w, c in Counter(tokens).items() if w in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    q = weigh(tokenise(query))
    scores = [round(sum(x * weigh(d).get(w, 0.0) for w, x in q.items()), 10) for d in docs]
    order = sorted(range(n), key=lambda i: (scores[i], i), reverse=True)[: min(k, n)]
    return [(corpus[i][0], corpus[i][1], scores[i]) for i in order]


@pytest.mark.parametrize("limit", [300_000, 3, 0])
def test_tfidf_search(spark, monkeypatch, limit):
    # With a lower limit some or all terms go through the ordinary join.
    monkeypatch.setattr(se, "FREQUENT_LIMIT", limit)
    index = se.build_term_index(spark.createDataFrame(CORPUS, "source string, chunk_no int, text string"))
    questions = {1: "fraud threshold?", 2: "churn churn retention", 3: "unknown words", 4: "governance of drift"}
    df = spark.createDataFrame(list(questions.items()), "query_id int, question string")
    for k in (1, 4, 8):
        got = {}
        for r in se.tfidf_search(index, df, "query_id", "question", k).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["source"], r["chunk_no"], r["score"]))
        for q, text in questions.items():
            expected = reference_search(CORPUS, text, k)
            assert [g[1:3] for g in sorted(got[q])] == [e[:2] for e in expected], (q, k)
            np.testing.assert_allclose([g[3] for g in sorted(got[q])], [e[2] for e in expected], atol=1e-9)


def test_many_query_terms_use_the_salted_join(spark, monkeypatch):
    index = se.build_term_index(spark.createDataFrame(CORPUS, "source string, chunk_no int, text string"))
    df = spark.createDataFrame([(1, "fraud score threshold"), (2, "churn drift")], "query_id int, question string")
    expected = sorted(map(tuple, se.tfidf_search(index, df, "query_id", "question").collect()))
    monkeypatch.setattr(se, "QUERY_TERM_LIMIT", 1)
    assert sorted(map(tuple, se.tfidf_search(index, df, "query_id", "question").collect())) == expected


def test_frequency_cutoff_is_raised(spark, monkeypatch):
    idf = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0), ("c", 40, 1.0)], "term string, df long, idf double")
    assert se.frequency_cutoff(idf) == 1.0
    monkeypatch.setattr(se, "FREQUENT_LIMIT", 1)
    assert 2 < se.frequency_cutoff(idf) <= 40


def test_top_k_is_limited_before_the_shuffle(spark):
    scored = spark.range(1000).select((F.col("id") % 3).alias("q"), "id", F.rand(1).alias("score"))
    plan = plan_of(se.top_k_per_query(scored, ["q"], 4, [F.desc("score")]), "simple")
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("size,k", [(8, 3), (8, 1), (64, 3), (1024, 5)])
def test_pruned_search_equals_all_pairs(spark, monkeypatch, size, k):
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words[40 * (i // 60) % 360 :][:60], 12)) for i in range(600)]
    texts[100:140] = [texts[100]] * 40
    corpus = [(f"d{i % 7}", i, t) for i, t in enumerate(texts)]
    monkeypatch.setattr(se, "BLOCK_CHUNKS", size)
    index = se.build_term_index(spark.createDataFrame(corpus, "source string, chunk_no int, text string").coalesce(2))
    asked = spark.createDataFrame([(i, texts[37 * i][:50]) for i in range(15)] + [(99, "unknown")], "query_id int, question string")
    full = se.tfidf_scores(index, asked, "query_id", "question")
    order = [F.desc("score"), F.desc("source"), F.desc("chunk_no")]
    expected = se.top_k_per_query(full, ["query_id"], k, order).select("query_id", "rank", "source", "chunk_no", "score")
    got = se.tfidf_search(index, asked, "query_id", "question", k)
    assert sorted(map(tuple, got.where("score > 0").collect())) == sorted(map(tuple, expected.collect()))
    assert got.where("query_id = 99").count() == k


def test_blocks_below_the_threshold_are_passed_over():
    rng = np.random.default_rng(4)
    search = se.BlockSearch(np.array([0, 3, 3, 5]), np.array([0, 1, 2, 1, 7]), np.array([0.5, 0.4, 0.3, 0.9, 0.2]), 2)
    sums, seen = np.zeros((3, 400)), []
    for b in range(40):
        strong = 1.0 if b in (3, 30) else 0.1
        place, term = np.repeat(np.arange(10), 3), np.tile([0, 1, 7], 10)
        impact = np.round(rng.uniform(0, strong, 30), 3)
        for p, t, w in zip(place, term, impact):
            for q in range(3):
                for j in range(search.starts[q], search.starts[q + 1]):
                    sums[q, 10 * b + p] += w * search.factors[j] * (search.terms[j] == t)
        q, at, score = search.block(place, term, impact, 10)
        seen += [(int(a), int(10 * b + c), float(s)) for a, c, s in zip(q, at, score)]
    for q in (0, 2):
        want = sorted(((-round(s, 10), i) for i, s in enumerate(sums[q])))[:2]
        assert sorted((-s, i) for a, i, s in seen if a == q)[:2] == want
    assert not [x for x in seen if x[0] == 1]
    assert search.skipped > 60 and search.pairs < 0.3 * 40 * 10 * 4


def test_vector_search_with_many_queries(spark, monkeypatch):
    rng = np.random.default_rng(11)
    vectors, queries = rng.integers(-3, 4, (400, 6)).astype(float), rng.integers(-3, 4, (5000, 6)).astype(float)
    v = spark.createDataFrame([(f"v{i:03d}", r.tolist()) for i, r in enumerate(vectors)], "name string, v array<double>").repartition(3)
    q = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(queries)], "qid int, qv array<double>")
    monkeypatch.setattr(se, "CELL_ROWS", 60)
    found = se.vector_search(v, "name", "v", q, "qid", "qv", 3)
    assert "MapInArrow" in plan_of(found, "simple") and "Join" not in plan_of(found, "simple")
    got = {(r["qid"], r["rank"]): r["name"] for r in found.collect()}
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) > 0, np.linalg.norm(m, axis=1, keepdims=True), 1)
    scores = np.round(unit(queries) @ unit(vectors).T, 10)
    order = np.argsort(-scores[:, ::-1], axis=1, kind="stable")[:, :3]
    assert len(got) == 15000
    assert all(got[i, r + 1] == f"v{399 - order[i, r]:03d}" for i in range(5000) for r in range(3))


def test_vector_search(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    vectors[10] = vectors[200]
    vectors[5] = 0
    queries = np.concatenate([rng.normal(size=(6, 8)), [vectors[10]]])
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(vectors)], "vec_id long, v array<float>").repartition(7)
    q = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(queries)], "qid int, qv array<double>")
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) > 0, np.linalg.norm(m, axis=1, keepdims=True), 1)
    scores = np.round(unit(vectors.astype(float)) @ unit(queries).T, 10)
    monkeypatch.setattr(se, "VECTOR_SLICE", 16)
    for block, cell in ((2048, 1), (3, 1 << 17), (3, 7)):
        monkeypatch.setattr(se, "QUERY_BLOCK", block)
        monkeypatch.setattr(se, "CELL_ROWS", cell)
        got = {}
        for r in se.vector_search(v, "vec_id", "v", q, "qid", "qv", 5).collect():
            got.setdefault(r["qid"], []).append((r["rank"], r["vec_id"], r["score"]))
        for i in range(len(queries)):
            expected = sorted(range(300), key=lambda j: (scores[j, i], j), reverse=True)[:5]
            assert [g[1] for g in sorted(got[i])] == expected
    assert [g[1] for g in sorted(got[6])][:2] == [200, 10]
    assert se.vector_search(v, "vec_id", "v", q.limit(0), "qid", "qv").count() == 0
    # A zero vector scores 0 with all, and rows without a vector are left out.
    gone = v.union(spark.createDataFrame([(999, None)], v.schema))
    assert se.vector_search(gone, "vec_id", "v", q.where("qid = 0"), "qid", "qv", 400).count() == 300
    a, b = F.array(*[F.lit(float(x)) for x in (3, 4)]), se.normalise(F.array(F.lit(0.0), F.lit(2.0)))
    assert spark.range(1).select(se.dot(se.normalise(a), b)).first()[0] == pytest.approx(0.8)


def test_bounds_of_k():
    assert se.bounded_k(8) == 8
    with pytest.raises(ValueError):
        se.bounded_k(9)


def test_shorten_equals_textwrap(spark):
    texts = [
        words(80, s) for s in range(20)
    ] + ["well-known " * 40, "x" * 300, "ab " + "y" * 300, "exact " * 36 + "last", " spaced \n\t out ", "\u2003odd\x1c\xa0blanks\u3000 ", "a" * 218 + " b c", "a" * 219 + " b", "a" * 220, "ab-cd " * 60]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", pt.shorten(F.col("t")).alias("x"))
    got = {r["i"]: r["x"] for r in df.collect()}
    for i, t in enumerate(texts):
        assert got[i] == textwrap.shorten(" ".join(t.split()), width=220, placeholder="…"), i


def test_prompts(spark):
    queries = spark.createDataFrame([(1, " why? ", "analyst"), (2, "how", "nobody"), (3, "what", None)], "query_id int, question string, persona string")
    hits = spark.createDataFrame([(1, r, f"text {r} ") for r in range(8, 0, -1)], "query_id int, rank int, text string")
    got = {r["query_id"]: r["prompt"] for r in pt.build_prompts(queries, hits, system="S", safety="G").collect()}
    assert got[1].startswith("S\n\nG\n\nAdditional business rules:\n- Reference relevant")
    assert "[Source 1]\ntext 1\n\n[Source 2]\ntext 2" in got[1] and "[Source 5]" in got[1] and "[Source 6]" not in got[1]
    assert "User question:\nwhy?\n\nProvide" in got[1]
    assert pt.NO_CONTEXT in got[2] and pt.RULES_HEAD not in got[2] and pt.RULES_HEAD not in got[3]
    summary = {r["query_id"]: r["summary"] for r in pt.summarise_sources(queries, hits).collect()}
    assert summary == {1: "- Source 1: text 1\n- Source 2: text 2\n- Source 3: text 3", 2: pt.NO_SUMMARY, 3: pt.NO_SUMMARY}


def test_answers(spark):
    index = se.build_term_index(spark.createDataFrame(CORPUS, "source string, chunk_no int, text string"))
    questions = spark.createDataFrame([(1, "fraud score", "support")], "query_id int, question string, persona string")
    out = answer(index, questions, 2)
    assert out.sources.where("rank = 1").first()["preview"] == CORPUS[0][2]
    assert out.summaries.count() == out.prompts.count() == 1
    response = out.responses.first()["response"]
    assert response.startswith("### Summary\n") and "- Source 1: fraud score" in response and response.endswith(pt.DISCLAIMER)
    plain = pt.compose_answers(out.summaries, "query_id", None).first()["response"]
    assert plain.endswith("investigation is required.")
    with pytest.raises(ValueError):
        answer(index, questions.withColumn("question", F.lit("  ")))


def test_tasks_that_count_terms_are_bounded(spark, monkeypatch):
    """Adaptive execution may not put more texts into a task than TASK_CHARS says."""
    monkeypatch.setattr(tx, "TASK_CHARS", 5_000)
    rows = spark.range(200).select(F.col("id").alias("source"), F.lit(0).alias("chunk_no"), F.repeat(F.lit("riskier word "), 20).alias("text"))
    spread = tx.spread(rows, "text", ["source", "chunk_no"])
    sizes = spread.groupBy(F.spark_partition_id()).agg(F.sum(F.length("text")).alias("n")).collect()
    assert spread.rdd.getNumPartitions() == 11 and max(r.n for r in sizes) < 20_000
    counts = tx.term_counts(spread, ["source", "chunk_no"], "text")
    assert counts.count() == 400 and counts.where("tf <> 20").isEmpty()
    assert "hashpartitioning(source" in counts._jdf.queryExecution().executedPlan().toString()
    assert tx.spread(rows.limit(0), "text", ["source"]).count() == 0
