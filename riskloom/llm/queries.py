"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversations, decontaminate, extract, factors, language, licences, lines, mixing, quality, repeats, secrets, simhash, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The tree of the mixture: a domain for each fourth source, then language, then source.
TREE = {
    "domain": "concat('d', coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})', 1) AS int) % 4, 0))",
    "lang": "lang",
    "source": "source",
}
WEIGHTS = {("d0",): 4.0, ("d1",): 2.0, **{(f"d{k}", "en"): 2.0 for k in range(4)}, ("d0", "en", "src0"): 3.0}
SHARE, EPOCHS, SEED = 0.75, 4, 7


def mixed(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, {k: F.expr(v) for k, v in TREE.items()}, WEIGHTS, SHARE, EPOCHS, SEED)


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select(
        "doc_id", "leaf", "epoch", "n_tokens", "n_taken"
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failures")
    failures = F.col("ledger.failures")
    return judged.select(
        "doc_id",
        *[F.col(f"ledger.{n}").alias(n) for n in names],
        (~quality.passes(failures, quality.BASE)).alias("base_failed"),
        quality.passes(failures, quality.WEB).alias("kept"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = docs.select("doc_id", lines.document("doc_id", "text").alias("document"), lines.n_lines("text").alias("n_lines"))
    drops = lines.dropped_lines(docs)
    dropped = F.coalesce(F.col("drop"), F.array().cast("array<int>"))
    return counts.join(drops, "document", "left").select(
        "doc_id", "n_lines", F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped")
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "leak.n_passages", "leak.n_retrieved", "leak.items", (F.size("leak.items") > 0).alias("contaminated")
    )


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"))
    automata, alphabet = language.fit(docs.filter(~out))
    return language.predict(docs.drop("lang"), automata, alphabet).select(
        "doc_id", out.alias("held_out"), "language.lang_pred", "language.score"
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["licence"])))
    return found.select(
        "doc_id",
        F.size("licences").cast("long").alias("n_found"),
        F.array_join(names, ",").alias("licences"),
        F.coalesce(F.array_max(F.transform("licences", lambda x: x["dice"])), F.lit(0.0)).alias("best_dice"),
    )


_WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

def _weight_sql(depth: int) -> str:
    path = " || '/' || ".join(("l0", "l1", "l2")[:depth])
    whens = " ".join(f"WHEN '{'/'.join(p)}' THEN {w}" for p, w in WEIGHTS.items() if len(p) == depth)
    return f"CASE {path} {whens} ELSE 1.0 END::DOUBLE" if whens else "1.0::DOUBLE"


def _level_sql(depth: int) -> str:
    """Budgets of one level of the tree out of the level above."""
    keys, parents = ", ".join(("l0", "l1", "l2")[:depth]), ", ".join(("l0", "l1", "l2")[: depth - 1])
    group = f"PARTITION BY {parents}" if parents else ""
    given = f"JOIN b{depth - 1} USING ({parents})" if parents else "CROSS JOIN total"
    return f"""
n{depth} AS (SELECT {keys}, sum(tokens) * {EPOCHS} AS supply, {_weight_sql(depth)} AS weight FROM leaves GROUP BY {keys}),
o{depth} AS (SELECT n{depth}.*, given, row_number() OVER ({group} ORDER BY supply / weight, {("l0", "l1", "l2")[depth - 1]}) AS place
             FROM n{depth} {given}),
v{depth} AS (SELECT *, (given - coalesce(sum(supply) OVER below, 0)) / (sum(weight) OVER ({group}) - coalesce(sum(weight) OVER below, 0.0)) AS lev
             FROM o{depth} WINDOW below AS ({group} ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b{depth} AS (SELECT {keys}, least(CAST(supply AS DOUBLE), max(lev) OVER ({group}) * weight) AS given FROM v{depth})"""


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, CAST(len({_WORDS_SQL}) AS BIGINT) AS tokens,
                  'd' || coalesce(TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})', 1) AS INTEGER) % 4, 0) AS l0,
                  coalesce(lang, '(none)') AS l1, coalesce(source, '(none)') AS l2 FROM documents),
leaves AS (SELECT l0, l1, l2, CAST(sum(tokens) AS BIGINT) AS tokens FROM d WHERE tokens > 0 GROUP BY ALL),
total AS (SELECT least(floor(sum(tokens) * {SHARE}), sum(tokens) * {EPOCHS}) AS given FROM leaves),
{_level_sql(1)}, {_level_sql(2)}, {_level_sql(3)},
s AS (SELECT doc_id, l0, l1, l2, tokens, epoch, floor(given) AS budget,
             sum(tokens) OVER (PARTITION BY l0, l1, l2 ORDER BY epoch, md5(concat_ws(':', {SEED}, epoch, doc_id))) - tokens AS before
      FROM d JOIN b3 USING (l0, l1, l2), (SELECT unnest(range({EPOCHS})) AS epoch) WHERE tokens > 0)
SELECT doc_id, concat_ws('/', l0, l1, l2) AS leaf, CAST(epoch AS INTEGER) AS epoch, tokens AS n_tokens,
       CAST(least(tokens, budget - before) AS BIGINT) AS n_taken FROM s WHERE before < budget
"""

OP2_SQL = rf"""
WITH w AS (SELECT doc_id, {_WORDS_SQL} AS ws, coalesce(text, '') AS text FROM documents),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS five FROM e),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM win WHERE len(five) = 5),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
ls AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w JOIN ls USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, CAST(
        (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END)
        + (CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 32 ELSE 0 END)
        AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures,
       failures & 3 <> 0 AS base_failed, failures = 0 AS kept FROM f
"""

def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    known = F.col("secrets.known")
    return found.select(
        "doc_id",
        *[secrets.count_of(known, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.digest(known), 256).alias("base_sha256"),
        secrets.digest(F.col("secrets.spans")).alias("spans"),
    )


def _places_sql(name: str, pattern: str) -> str:
    """doc_id, n, match, start, end of the matches."""
    pattern = pattern.replace("'", "''")
    return f"""
{name} AS (
  SELECT doc_id, n, m, CAST(sum(length(piece) + coalesce(length(before), 0)) OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS s
  FROM (SELECT doc_id, n, m, piece, lag(m) OVER (PARTITION BY doc_id ORDER BY n) AS before
        FROM (SELECT doc_id, unnest(ms) AS m, unnest(ps[:len(ms)]) AS piece, generate_subscripts(ms, 1) AS n
              FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM t))))"""


def _inner_sql(name: str, source: str, pattern: str, between: bool) -> str:
    """The matches of a pattern inside the strings ``m`` at ``s`` of ``source``, or what lies between them."""
    pattern = pattern.replace("'", "''")
    pieces = f"string_split_regex(m, '{pattern}')"
    found = f"regexp_extract_all(m, '{pattern}')"
    # Piece k follows match k - 1.
    lists = f"{pieces} AS ps, list_prepend('', {found}) AS ms" if between else f"{found} AS ps, {pieces} AS ms"
    end = "CAST(sum(length(p) + length(b)) OVER (PARTITION BY doc_id, s ORDER BY k) AS INTEGER)"
    return f"""
{name} AS (
  SELECT doc_id, p AS m, s + {end} - length(p) AS s
  FROM (SELECT doc_id, s, unnest(ps) AS p, unnest(ms[:len(ps)]) AS b, generate_subscripts(ps, 1) AS k FROM (SELECT doc_id, s, {lists} FROM {source})))"""


def _entropy_sql(group: secrets.CharClass, rank: int) -> str:
    wanted = [f"NOT regexp_matches(m, '{group.excludes}')"] + [f"regexp_matches(m, '{p}')" for p in group.needs]
    w = group.window
    return f"""
      SELECT doc_id, '{group.kind}' AS kind, {rank} AS r, min(s + o) AS s, max(s + o) + {w} AS e FROM (
        SELECT doc_id, s, o, map_values(list_histogram(string_split(substr(m, CAST(o + 1 AS BIGINT), {w}), ''))) AS cs
        FROM (SELECT *, unnest(range(0, length(m) - {w} + 1)) AS o FROM {group.kind}_parts WHERE {" AND ".join(wanted)}))
      WHERE log2({w}) - list_sum(list_transform(cs, lambda c: c * log2(c))) / {w} >= {group.threshold} GROUP BY doc_id, s"""


def _parts_sql(group: secrets.CharClass) -> str:
    if group.run:
        return _inner_sql(f"{group.kind}_parts", "parts", group.run, between=False)
    return f"{group.kind}_parts AS (SELECT * FROM parts)"


OP10_SQL = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), "
    + ", ".join(_places_sql(k.kind, k.pattern) for k in secrets.KNOWN)
    + ", "
    + _places_sql("candidates", secrets.CLASSES[0].pattern)
    + ", "
    + _inner_sql("parts", "candidates", "|".join(f"(?:{p})" for p in secrets.ALLOWED), between=True)
    + "".join(", " + _parts_sql(c) for c in secrets.CLASSES)
    + ", base AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{k.kind}' AS kind, {r} AS r, s, s + length(m) AS e FROM {k.kind}"
        + (" WHERE length(regexp_extract(m, '{}', {})) >= {}".format(k.pattern.replace("'", "''"), k.group, k.least))
        for r, k in enumerate(secrets.KNOWN)
    )
    + "), every AS (SELECT doc_id, kind, r, s, e FROM base"
    + "".join(" UNION ALL " + _entropy_sql(c, len(secrets.KNOWN) + r) for r, c in enumerate(secrets.CLASSES))
    + """), b AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, r) AS spans FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, r) AS spans FROM every GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(a.spans, '') AS spans
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""
)


def op11_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.remove_factors(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


OP11_SQL = rf"""
WITH w AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM x) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS words
         FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(words, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.prefix_trie(conversations.with_shared_heads(conversations.sequences(turns)))


#: crc32 of the decimal id, bit by bit.
_CRC_SQL = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                             lambda x, z: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))))"""
OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC_SQL} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, pos, said FROM c JOIN t ON t.conv_id = base WHERE pos <= h
      UNION ALL SELECT conv_id, 1, pos, said FROM c JOIN t USING (conv_id) WHERE pos > h),
s AS MATERIALIZED (SELECT conv_id, coalesce(seq, []) AS seq
      FROM c LEFT JOIN (SELECT conv_id, list(said ORDER BY own, pos) AS seq FROM r GROUP BY conv_id) USING (conv_id)),
n AS MATERIALIZED (
  SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM (SELECT conv_id, seq[1:depth] AS k, depth, len(seq) = depth AS ends
        FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS depth FROM s)) GROUP BY ALL),
kids AS (SELECT k[1:depth - 1] AS k, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k, depth)),
below AS (
  SELECT k[1:a] AS k, a AS depth, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves,
         sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(k[depth].text) END)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS a FROM m) GROUP BY ALL)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN below USING (k, depth) LEFT JOIN n p ON m.depth > 0 AND p.depth = m.depth - 1 AND p.k = m.k[1:m.depth - 1]
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return vector_codes.with_label_error(coded).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(vector_codes.books_sha256(books)).alias("codebooks_sha256")
    )


def _nearest_sql(step: int) -> str:
    """Distance and entry of each part's nearest entry, in one number."""
    return f"""
a{step} AS MATERIALIZED (
  SELECT vec_id, p.part, min(256 * list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT + b.entry) AS m
  FROM p JOIN b{step} b ON p.part = b.part GROUP BY ALL)"""


def _books_sql(step: int) -> str:
    """The entries after a round; unused ones stay."""
    return f"""
b{step + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM b{step} b LEFT JOIN (
    SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY place) AS x FROM (
      SELECT part, entry, place, sum(y)::BIGINT AS s, count(*) AS c FROM (
        SELECT p.part, m % 256 AS entry, unnest(x) AS y, generate_subscripts(x, 1) AS place FROM p JOIN a{step} USING (vec_id, part))
      GROUP BY ALL) GROUP BY ALL) n ON b.part = n.part AND b.entry = n.entry)"""


OP13_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS x FROM k, (SELECT unnest(range(4)) AS part)),
b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p
  WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256)),
{",".join(_nearest_sql(r) + "," + _books_sql(r) for r in range(4))},
{_nearest_sql(4)},
books AS (SELECT sha256(string_agg(y, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (
  SELECT part, entry, unnest(x)::VARCHAR AS y, generate_subscripts(x, 1) AS place FROM b4)),
coded AS (
  SELECT vec_id, string_agg(printf('%02x', m % 256), '' ORDER BY part) AS code, sum(m // 256)::BIGINT AS error FROM a4 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN k USING (vec_id), books
"""

QUERIES = {
    "op1_mixture": op1_mixture,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_main_text": op5_main_text,
    "op6_repeats": op6_repeats,
    "op7_language": op7_language,
    "op8_simhash": op8_simhash,
    "op9_licences": op9_licences,
    "op10_secret_scan": op10_secret_scan,
    "op11_factors": op11_factors,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_vector_codes": op13_vector_codes,
}
SQL = {"op1_mixture": OP1_SQL, "op2_quality_rules": OP2_SQL, "op10_secret_scan": OP10_SQL, "op11_factors": OP11_SQL, "op12_conversation_trie": OP12_SQL, "op13_vector_codes": OP13_SQL}
