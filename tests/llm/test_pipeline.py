"""The pipeline against plain versions of its stages, and the registered queries against their SQL."""

import random

import duckdb
import pytest

import corpus_pipeline
from riskloom.llm import decontaminate, lines, queries, simhash

from test_operators import plain_leaks


def connect(sf_dir, documents=None):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op1_mixture", "op2_quality_rules", "op10_secret_scan"])
def test_queries_against_their_sql(spark, sf_dir, name):
    sql = connect(sf_dir).execute(queries.SQL[name])
    names = [d[0] for d in sql.description]
    got = queries.QUERIES[name](spark, sf_dir).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(sql.fetchall())


def test_secrets_inside_longer_strings_against_their_sql(spark, tmp_path):
    rng = random.Random(6)
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    low, high = "0123456789abcdef", "0123456789ABCDEF"
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [None, "", "no secrets here", "é漢 " + "0x" + pick(high, 40), "key-" + pick(high, 32) + "-end", "id_" + pick(low, 32)]
    texts += [f"url/{pick(base64, 30)}example{pick(base64, 44)}", pick(base64, 64) + "00000000" + pick(base64, 12), "EXAMPLE" * 5]
    for _ in range(120):
        words = []
        for _ in range(rng.randrange(1, 6)):
            parts = [pick(rng.choice([low, high, base64, "ab1", "Zz_-/"]), rng.randrange(1, 50)) for _ in range(rng.randrange(1, 4))]
            words.append(rng.choice(["", "-", "example", "0123456789", "xxxxxxxx", "_PlaceHolder/"]).join(parts))
        texts.append(rng.choice([" ", "\n", "; ", " password= "]).join(words))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.execute(queries.SQL["op10_secret_scan"])
    names = [d[0] for d in sql.description]
    got = sorted(map(tuple, queries.QUERIES["op10_secret_scan"](spark, str(tmp_path)).select(names).collect()))
    assert got == sorted(sql.fetchall())
    spans = {r[names.index("doc_id")]: r[names.index("spans")] for r in got}
    assert "entropy_hex:5:45" in spans[3] and "entropy_hex:4:36" in spans[4] and sum("entropy_base64" in v for v in spans.values()) > 20


def roots(n, near):
    """Least member of each component."""
    root = list(range(n))
    for a, b in near:
        low, high = sorted((root[a], root[b]))
        if low != high:
            root = [low if r == high else r for r in root]
    return root


def without_later_lines(docs, size=lines.SIZE):
    """Documents in order of id, less lines that resemble an earlier line's class."""
    spaces = str.maketrans("\t\n\x0b\x0c\r", "     ")
    worded = lambda line: line.strip(" \t\n\x0b\x0c\r") != ""
    split = {d["doc_id"]: (d["text"] or "").split("\n") for d in docs}
    distinct = sorted({line for held in split.values() for line in held if worded(line)})
    sets = []
    for line in distinct:
        flat = line.translate(spaces)
        sets.append({flat[k : k + size] for k in range(max(len(flat) - size + 1, 1))})
    # Lines of similarity 0.8 share one of the rarest fifth of their shingles.
    held = {}
    for s in sets:
        for x in s:
            held[x] = held.get(x, 0) + 1
    index, near = {}, []
    for b, s in enumerate(sets):
        rare = sorted(s, key=lambda x: (held[x], x))[: len(s) - -(-4 * len(s) // 5) + 1]
        for a in {a for x in rare for a in index.get(x, ())}:
            if 5 * len(sets[a] & s) >= 4 * len(sets[a] | s):
                near.append((a, b))
        for x in rare:
            index.setdefault(x, []).append(b)
    name = dict(zip(distinct, roots(len(distinct), near)))
    seen, out = set(), []
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        kept, lost = [], False
        for line in split[d["doc_id"]]:
            if worded(line) and name[line] in seen:
                lost = True
                continue
            if worded(line):
                seen.add(name[line])
            kept.append(line)
        text = "\n".join(kept) if lost else d["text"]
        if not lost or any(map(worded, kept)):
            out.append({**d, "text": text, "n_chars": len(text) if lost else d["n_chars"]})
    return out


def test_every_stage_against_a_plain_version(spark, sf_dir):
    con = connect(sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    plain = [r.asDict() for r in docs.collect()]
    assert len({d["doc_id"] for d in plain}) == len(plain)
    stages = dict(corpus_pipeline.STAGES)
    same = lambda df, rows: sorted(map(tuple, df.select(columns).collect()), key=str) == sorted((tuple(r[c] for c in columns) for r in rows), key=str)

    passed = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.SQL['op2_quality_rules']}) WHERE kept").fetchall()}
    plain = [d for d in plain if d["doc_id"] in passed]
    docs = corpus_pipeline.stage(stages["quality"](spark, docs, sf_dir), "quality")
    assert docs.columns == columns and same(docs, plain)

    plain = without_later_lines(plain)
    docs = corpus_pipeline.stage(stages["lines"](spark, docs, sf_dir), "lines")
    assert docs.columns == columns and same(docs, plain)

    prints = [simhash.fingerprint_of(d["text"]) % 2**64 for d in plain]
    near = [(a, b) for b in range(len(plain)) for a in range(b) if (prints[a] ^ prints[b]).bit_count() <= 3]
    order = sorted(range(len(plain)), key=lambda k: plain[k]["doc_id"])
    assert order == list(range(len(plain)))
    plain = [d for k, (d, r) in enumerate(zip(plain, roots(len(plain), near))) if k == r]
    docs = corpus_pipeline.stage(stages["near_duplicates"](spark, docs, sf_dir), "near")
    assert docs.columns == columns and same(docs, plain)

    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    passage = max(128, 2 * max(len(decontaminate.tokens(t)) for _, t in items))
    leaks = plain_leaks([d["text"] for d in plain], items, passage)
    plain = [d for d, (_, found) in zip(plain, leaks) if not found]
    docs = corpus_pipeline.stage(stages["decontamination"](spark, docs, sf_dir), "clean")
    assert docs.columns == columns and same(docs, plain)

    con.execute("DROP VIEW documents")
    con.register("documents", docs.toArrow())
    sql = con.execute(queries.SQL["op1_mixture"])
    names = [d[0] for d in sql.description]
    expected = sorted(sql.fetchall())
    assert sorted(map(tuple, stages["mixing"](spark, docs, sf_dir).select(names).collect())) == expected
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select(names).collect())) == expected
