"""Factors against every window in plain Python, with nulls, ties, repeated rows and ids, hot windows and clashing names."""

import random

import duckdb
import numpy as np
import pytest

from riskloom.llm import factors, queries

SCHEMA = "doc_id long, text string, id string, first int, core string"


def plain(rows, window):
    places, texts = {}, [(i, factors.words(t)) for i, t, *_ in rows]
    for i, ws in texts:
        for k in range(len(ws) - window + 1):
            places.setdefault(tuple(ws[k : k + window]), set()).add((i is None, i or 0, k))
    least = {w: min(p) for w, p in places.items()}
    out = []
    for i, ws in texts:
        gone = [False] * len(ws)
        for k in range(len(ws) - window + 1):
            if least[tuple(ws[k : k + window])] < (i is None, i or 0, k):
                gone[k : k + window] = [True] * window
        out.append((i, len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone) if not g)))
    return out


def found(spark, rows, window, gram, block, partitions=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    return [tuple(r) for r in factors.remove_factors(docs, window=window, gram=gram, block=block).collect()]


def table(seed, few_words):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4 if few_words else 300)] + ["ü漢"]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, texts = prose(60), []
    for _ in range(60):
        text = prose(rng.randrange(0, 120))
        if rng.random() < 0.5:
            a = rng.randrange(50)
            text = f"{text}\t{' '.join(passage.split()[a : a + rng.randrange(5, 40)])}\n {prose(rng.randrange(30))}"
        texts.append(text)
    texts += [texts[0], texts[1], None, "", " \n\x0b", "short", "same word " * 90, passage]
    rows = [(k, t, "clash", 1, "x") for k, t in enumerate(texts)]
    return rows + [(3, texts[3], "", 1, ""), (3, texts[4], "", 1, ""), (None, texts[2], "", 1, ""), (None, passage, "", 1, ""), rows[5]]


@pytest.mark.parametrize("seed,few,window,gram,block", [(1, False, 20, 6, 10_000), (2, True, 6, 2, 10_000), (3, True, 5, 2, 3), (4, False, 8, 3, 1), (5, False, 20, 20, 2)])
def test_factors_against_all_windows(spark, seed, few, window, gram, block):
    rows = table(seed, few)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(found(spark, rows, window, gram, block), key=key) == sorted(plain(rows, window), key=key)


def test_a_hot_window_in_many_settings(spark):
    rng = random.Random(9)
    hot = " ".join(f"hot{k}" for k in range(20))
    rows = [(k, f"{rng.random()} {rng.random()} {hot} {rng.random()} {rng.random()}", "", 1, "") for k in range(300)]
    for block in (10_000, 50):
        got = found(spark, rows, 20, 6, block, partitions=9)
        assert sorted(r[0] for r in got if r[2] == 20) == list(range(1, 300)) and sum(r[2] for r in got) == 20 * 299


def test_empty_table(spark):
    assert factors.remove_factors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_fragments_hold_every_window_once():
    rng = np.random.default_rng(2)
    counts = np.array([0, 19, 20, 0, 21, 400, 3, 33, 0])
    texts = [rng.integers(0, 5, n).astype(np.uint64) for n in counts]
    row, first, n, at, core, run = factors.fragments(np.concatenate(texts), counts, 20, 6)
    assert [int(n[row == k].sum()) for k in range(9)] == [max(0, c - 19) for c in counts]
    assert (at >= first + n - 1).all() and (at + 6 <= first + 20).all() and (first + n + 19 <= counts[row]).all()
    # A text is cut alike alone and among others.
    for k, text in enumerate(texts):
        alone = factors.fragments(text, counts[k : k + 1], 20, 6)
        for a, b in zip(alone[1:], (first, n, at, core, run)):
            assert (a == b[row == k]).all()


def test_query_against_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    sql = con.execute(queries.SQL["op11_factors"])
    names = [d[0] for d in sql.description]
    got = queries.QUERIES["op11_factors"](spark, sf_dir).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(sql.fetchall())
