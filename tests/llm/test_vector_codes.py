"""Vector codes against a plain version with every distance, on small tables with nulls, ties, repeats and clashes."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from riskloom.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, id long"


def plain(rows, parts=4, entries=256, rounds=4):
    """Codes, errors and the digest by comparing each part with each entry in Python's whole numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [[math.floor(1024 * x) for x in r[1]] for r in kept]
    width = len(ints[0]) // parts if ints else 0
    cut = [[v[p * width : (p + 1) * width] for v in ints] for p in range(parts)]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, ints[k]))[:entries]
    books = [[list(c[k]) for k in order] for c in cut]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min((far(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for c, book in zip(cut, books):
            own = [near(x, book)[1] for x in c]
            for k in range(len(book)):
                mine = [x for x, o in zip(c, own) if o == k]
                if mine:
                    book[k] = [sum(col) // len(mine) for col in zip(*mine)]
    out = []
    for k, r in enumerate(kept):
        found = [near(c[k], book) for c, book in zip(cut, books)]
        out.append((r[0], "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), r[2]))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return out, digest


def table(seed, n):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 0.3, (6, 16))
    rows = []
    for k in range(n):
        v = (middles[k % 6] + rng.normal(0, 0.02, 16)).round(2).tolist() if k % 3 else middles[0].round(2).tolist()
        rows.append((k, v, None if k % 7 == 0 else k % 4, "clash", -k))
    rows += [(n, None, 1, "", 0), (n + 1, [0.5] * 15 + [float("nan")], 1, "", 0), (n + 2, [float("inf")] + [0.0] * 15, 1, "", 0)]
    return rows + [(n + 3, [None] + [0.0] * 15, 1, "", 0), (None, [0.25] * 16, 2, "", 0), (5, rows[5][1], 3, "", 0), rows[4]]


@pytest.mark.parametrize("seed,n,entries,partitions", [(1, 400, 16, 3), (2, 150, 64, 7), (3, 90, 256, 1)])
def test_codes_against_all_distances(spark, monkeypatch, seed, n, entries, partitions):
    monkeypatch.setattr(vector_codes, "BLOCK", 128)
    rows = table(seed, n)
    coded, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(partitions), entries=entries)
    expected, digest = plain(rows, entries=entries)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3] or -1)
    assert sorted(((r.id, r.code, r.error, r.label) for r in coded.collect()), key=key) == sorted(expected, key=key)
    assert vector_codes.books_sha256(books) == digest


def test_label_errors_broadcast_and_salted(spark, monkeypatch):
    coded, _ = vector_codes.compress(spark.createDataFrame(table(4, 60), SCHEMA), entries=8)
    rows = coded.collect()
    totals = {}
    for r in rows:
        totals[r.label] = totals.get(r.label, 0) + r.error
    for limit in (100, 0):
        monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", limit)
        got = vector_codes.with_label_error(coded).collect()
        assert len(got) == len(rows) and all(r.label_error == totals[r.label] for r in got)


def test_trees_hold_every_point_and_prune(spark):
    rng = np.random.default_rng(0)
    middles = rng.integers(-4000, 4000, (40, 4))
    points = (middles[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 4))).astype(float)
    nodes = vector_codes.tree(points)
    held = points[nodes["order"]]
    owned = [(n, o) for n, o in vector_codes.walk(nodes, held, middles.astype(float)) if not isinstance(o, np.ndarray)]
    assert sorted(nodes["order"]) == list(range(3000))
    assert sum(nodes["last"][n] - nodes["first"][n] for n, _ in owned) > 2500
    for n, o in owned:
        own = held[nodes["first"][n] : nodes["last"][n]]
        assert (((own[:, None] - middles[None]) ** 2).sum(2).argmin(1) == o).all() and (own.sum(0) == nodes["sums"][n]).all()


def test_large_components_and_bad_lengths(spark):
    rows = [(k, [100000.0 * (k % 5), -3.0, 0.5, 7.0 * k], 1, "", 0) for k in range(40)]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), entries=4)
    expected, digest = plain(rows, entries=4)
    assert sorted((r.id, r.code, r.error, r.label) for r in coded.collect()) == sorted(expected)
    assert vector_codes.books_sha256(books) == digest
    for bad in ([(1, [1.0] * 6, 1, "", 0)], [(1, [1.0] * 4, 1, "", 0), (2, [1.0] * 8, 1, "", 0)], [(1, [1e30] * 4, 1, "", 0)]):
        with pytest.raises(ValueError):
            vector_codes.compress(spark.createDataFrame(bad, SCHEMA))


def test_empty_table(spark):
    coded, books = vector_codes.compress(spark.createDataFrame([(1, None, 1, "", 0)], SCHEMA))
    assert coded.count() == 0 and books.size == 0 and vector_codes.with_label_error(coded).count() == 0


def test_query_against_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    sql = con.execute(queries.SQL["op13_vector_codes"])
    names = [d[0] for d in sql.description]
    got = queries.QUERIES["op13_vector_codes"](spark, sf_dir).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(sql.fetchall())
