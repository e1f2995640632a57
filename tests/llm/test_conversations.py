"""The conversation trie against plain Python, over shards of every size, with nulls, ties, repeats and clashing names."""

import binascii
import hashlib
import random

import duckdb
import pytest

from riskloom.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, seq string, conv long"


def plain(rows):
    """Nodes by holding every prefix of every rebuilt conversation."""
    by = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in by.items()}
    full = {}
    for c in own:
        h = binascii.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members = {}
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, held in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(held) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(full[c]) == len(k))
        out.append((
            min(held), len(k), min(members[k[:-1]]) if k else None, len(held), len(children.get(k, [])), leaves[k], saved[k],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def nodes(df, shard_turns=1 << 19):
    trie = conversations.prefix_trie(conversations.with_shared_heads(conversations.sequences(df)), shard_turns)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert trie.columns == names
    return [tuple(r) for r in trie.collect()]


def table(seed, n):
    rng = random.Random(seed)
    said = ["hello", "héllo 漢字", "", None, "what is it", "a longer answer of some words"]
    rows = []
    for c in rng.sample(range(500), n):
        same = rng.random() < 0.4
        for k in range(3 if same else rng.randrange(1, 9)):
            role, text = ("user", "hello") if same else (rng.choice(["user", "bot", None]), rng.choice(said))
            rows.append((c, None if rng.random() < 0.1 else k, role, text, "clash", 7))
    rows += [(7, 1, "user", "x" * 30000, "", 1), (None, 1, "user", "lost", "", 1), rows[0], rows[0]]
    return rows + [(900, k, "user", f"t{k % 3}", "", 1) for k in range(400)] + [(901, k, "user", f"t{k % 3}", "", 1) for k in range(390)]


@pytest.mark.parametrize("seed,n,shard_turns,shuffle", [(1, 120, 1 << 19, 4), (2, 150, 6, 3), (3, 60, 1, 1), (4, 90, 40, 9)])
def test_trie_against_all_prefixes(spark, seed, n, shard_turns, shuffle):
    rows = table(seed, n)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    try:
        found = nodes(spark.createDataFrame(rows, SCHEMA).repartition(3), shard_turns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    key = lambda r: (r[1], r[0], r[2] or -1, r[3:])
    assert sorted(found, key=key) == sorted(plain(rows), key=key)


def test_no_rows_and_turnless_conversations(spark):
    assert nodes(spark.createDataFrame([(None, 1, "a", "b", "", 1)], SCHEMA)) == []
    # Its one turn goes, and there is no conversation 0 to copy from.
    c = next(c for c in range(1, 100) if binascii.crc32(str(c).encode()) % 6)
    ends = hashlib.sha256(str(c).encode()).hexdigest()
    assert nodes(spark.createDataFrame([(c, 1, "a", "b", "", 1)], SCHEMA)) == [(c, 0, None, 1, 0, 1, 0, ends)]


def test_codes_are_one_to_one(spark):
    turns = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("", "abc"), ("abc", ""), ("a", "bc")], "role string, text string")
    coded = conversations.encoded(turns).collect()
    assert len({r.code for r in coded}) == 4 and sorted(r.chars for r in coded) == [0, 1, 2, 2, 3]


def test_ternary_tree_is_balanced_by_medians():
    tree = conversations.TernaryTree()
    for k in conversations._medians(1000):
        tree.insert([k, 1], [1, 1], k)
    depth, stack = 0, [(tree.equal[0], 1)]
    while stack:
        node, d = stack.pop()
        if node:
            depth = max(depth, d)
            stack += [(tree.low[node], d + 1), (tree.high[node], d + 1)]
    assert depth == 10 and len(tree.walk()[0]) == 2001


def test_query_against_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    sql = con.execute(queries.SQL["op12_conversation_trie"])
    names = [d[0] for d in sql.description]
    got = queries.QUERIES["op12_conversation_trie"](spark, sf_dir).select(names).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(sql.fetchall(), key=key)
