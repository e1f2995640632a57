"""Top-k retrieval of chunks by terms or by vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.stopwords import ENGLISH
from ..session import stage
from .text import spread, term_counts

CHUNK = ["source", "chunk_no"]
DEFAULT_K = 4
K_BOUNDS = (1, 8)
# No more terms than this go to every task.
FREQUENT_LIMIT = 300_000
QUERY_TERM_LIMIT = 300_000
# Sums of doubles depend on their order; rounded scores let equal chunks tie in every run.
SCORE_DIGITS = 10
# Neighbouring chunks that are scored together and share one maximum per term.
BLOCK_CHUNKS = 1024
# Bounds and scores are sums in different orders, and scores are rounded.
BOUND_SLACK = 1e-9
# Queries that go to every task; more than that meet the vectors in cells.
QUERY_BLOCK = 2048
# Vectors of one cell, and how many queries and vectors are multiplied at a time.
CELL_ROWS = 1 << 17
QUERY_SLICE = 256
VECTOR_SLICE = 8192


def bounded_k(k: int) -> int:
    """The number of results a caller may ask for."""
    low, high = K_BOUNDS
    if not low <= k <= high:
        raise ValueError(f"k must lie between {low} and {high}")
    return k


def top_k_per_query(scored: DataFrame, query: Sequence[str], k: int, order: Sequence[Column]) -> DataFrame:
    """The first ``k`` rows per query, with ``rank`` from 1.

    Spark limits each group inside the map tasks before the shuffle, so a query that matches every
    chunk sends k rows per task.
    """
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*query).orderBy(*order))).where(F.col("rank") <= k)


class TermIndex:
    """Term statistics of chunks, staged because every search reads them.

    ``chunks`` has the texts and ``block``, the number of ``BLOCK_CHUNKS`` neighbours; ``postings (block, source, chunk_no,
    term, tf)``, ``idf (term, df, idf)`` with ``idf = ln((1 + n) / (1 + df)) + 1`` for ``n`` chunks, and ``norms (block,
    source, chunk_no, norm)``, the length of a chunk's vector ``tf * idf``. Terms in ``cutoff`` chunks or more are the
    frequent ones.
    """

    def __init__(self, chunks: DataFrame, postings: DataFrame, idf: DataFrame, n: int, cutoff: float, stop_words: Sequence[str]):
        self.chunks, self.postings, self.idf = chunks, postings, idf
        self.n, self.cutoff, self.stop_words = n, cutoff, stop_words
        self.norms = stage(vector_lengths(self.weigh(postings), ["block", *CHUNK]), "norms")

    @property
    def frequent(self) -> DataFrame:
        return self.idf.where(F.col("df") >= F.lit(self.cutoff)).select("term", "idf")

    @property
    def rare(self) -> DataFrame:
        return self.idf.where(F.col("df") < F.lit(self.cutoff)).select("term", "idf")

    def weigh(self, counts: DataFrame) -> DataFrame:
        """Add ``w = tf * idf`` to rows with ``term`` and ``tf``; terms unknown to the index are left out.

        Frequent terms go to every task, so a term held by a third of all chunks never meets in one
        task; the rest is an ordinary join on keys that each have few rows.
        """
        small = F.broadcast(self.frequent)
        joined = counts.join(small, "term")
        if self.cutoff > 1:
            joined = joined.unionByName(counts.join(small.select("term"), "term", "left_anti").join(self.rare, "term"))
        return joined.withColumn("w", F.col("tf") * F.col("idf"))

    def weights(self) -> DataFrame:
        """Unit-length weights ``(source, chunk_no, term, weight)``."""
        rows = self.weigh(self.postings).join(self.norms, ["block", *CHUNK])
        return rows.select(*CHUNK, "term", (F.col("w") / F.col("norm")).alias("weight"))


def vector_lengths(weighed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return weighed.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def frequency_cutoff(idf: DataFrame) -> float:
    """Smallest cutoff tried that leaves few enough frequent terms to send to every task.

    With ``p`` postings at most ``p / cutoff`` terms reach a cutoff, so the search ends and a term below
    it holds a tiny share of the postings. A small vocabulary is frequent as a whole.
    """
    cutoff = 1.0
    while idf.where(F.col("df") >= F.lit(cutoff)).count() > FREQUENT_LIMIT:
        cutoff *= 4
    return cutoff


def build_term_index(chunks: DataFrame, stop_words: Sequence[str] = ENGLISH) -> TermIndex:
    """Index ``chunks (source, chunk_no, text)``.

    Blocks are neighbours in the order in which the chunks are written. Whole blocks are spread then: one shuffle of the
    texts, after which a chunk's terms are counted where they are.
    """
    chunks = stage(chunks.withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK_CHUNKS)), "chunks")
    postings = stage(term_counts(spread(chunks, "text", ["block"]), ["block", *CHUNK], "text", stop_words), "postings")
    n = chunks.count()
    idf = stage(
        postings.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("idf", F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1),
        "idf",
    )
    return TermIndex(chunks, postings, idf, n, frequency_cutoff(idf), stop_words)


def query_terms(index: TermIndex, queries: DataFrame, query: str, text: str) -> DataFrame:
    """Unit-length weights of the queries' known terms ``(query, term, idf, factor)``, staged."""
    weighed = index.weigh(term_counts(queries, [query], text, index.stop_words))
    unit = weighed.join(vector_lengths(weighed, [query]), query)
    return stage(unit.select(query, "term", "idf", (F.col("w") / F.col("norm")).alias("factor")), "query-terms")


def _few(wanted: DataFrame) -> bool:
    return wanted.limit(QUERY_TERM_LIMIT + 1).count() <= QUERY_TERM_LIMIT


def tfidf_scores(index: TermIndex, queries: DataFrame, query: str, text: str) -> DataFrame:
    """Cosine of every query and chunk that share a term ``(query, source, chunk_no, score)``.

    As many rows as there are such pairs: ``tfidf_search`` finds the best of them without building the rest.
    """
    return _pair_scores(index, query_terms(index, queries, query, text), query)


def _pair_scores(index: TermIndex, wanted: DataFrame, query: str) -> DataFrame:
    pairs = index.postings.join(F.broadcast(wanted), "term") if _few(wanted) else _salted_join(index.postings, wanted)
    sums = pairs.groupBy(query, *CHUNK).agg(F.sum(F.col("tf") * F.col("idf") * F.col("factor")).alias("s"))
    return sums.join(index.norms, CHUNK).select(query, *CHUNK, F.round(F.col("s") / F.col("norm"), SCORE_DIGITS).alias("score"))


class BlockSearch:
    """A task's share of a search: blocks of chunks against a bounded set of queries.

    A block's postings lie by term, with the largest impact of each. The highest score a block can give a query is the
    sum of its terms' maxima; a block below the query's threshold is passed over, and inside a block terms are added in
    the order of their maxima until no chunk can reach the threshold any more. The threshold is the ``k``-th score found so
    far and rises from block to block. ``pairs`` counts the sums that were built, ``skipped`` the blocks passed over.
    """

    def __init__(self, starts: np.ndarray, terms: np.ndarray, factors: np.ndarray, k: int):
        self.starts, self.terms, self.factors, self.k = starts, terms, factors, k
        self.best = np.full((len(starts) - 1, k), -np.inf)
        self.pairs = self.skipped = 0

    def block(self, place: np.ndarray, term: np.ndarray, impact: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, place and score of the chunks that may be among the best; earlier places win ties."""
        order = np.argsort(term, kind="stable")
        place, term, impact = place[order], term[order], impact[order]
        held, first = np.unique(term, return_index=True)
        last = np.append(first[1:], len(term))
        top = np.maximum.reduceat(impact, first)
        at = np.searchsorted(held, self.terms)
        known = held[np.minimum(at, len(held) - 1)] == self.terms
        bounds = np.where(known, top[np.minimum(at, len(held) - 1)] * self.factors, 0.0)
        total = np.add.reduceat(np.append(bounds, 0.0), self.starts[:-1]) * (np.diff(self.starts) > 0)
        open_ = (total > 0) & (total + BOUND_SLACK >= self.best[:, -1])
        self.skipped += int((~open_ & (total > 0)).sum())
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for q in np.flatnonzero(open_).tolist():
            a, b = self.starts[q], self.starts[q + 1]
            mine = a + np.argsort(-bounds[a:b], kind="stable")
            low, rest, sums = self.best[q, -1], total[q], np.zeros(n)
            for j in mine[bounds[mine] > 0].tolist():
                if rest + BOUND_SLACK < low and sums.max() + rest + BOUND_SLACK < low:
                    break
                x, y = first[at[j]], last[at[j]]
                sums[place[x:y]] += impact[x:y] * self.factors[j]
                self.pairs += int(y - x)
                rest -= bounds[j]
            scores = np.round(sums, SCORE_DIGITS)
            few = min(self.k, n)
            limit = max(np.partition(scores, n - few)[n - few], low, 0.0)
            hits = np.flatnonzero((scores >= limit) & (sums > 0))
            hits = hits[np.argsort(-scores[hits], kind="stable")][: self.k]
            if len(hits):
                found.append((q, hits, scores[hits]))
                self.best[q] = -np.sort(-np.concatenate([self.best[q], scores[hits]]))[: self.k]
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.float64)
        return np.repeat([f[0] for f in found], [len(f[1]) for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])


def best_chunks(index: TermIndex, wanted: DataFrame, query: str, k: int) -> DataFrame:
    """At least the ``k`` best scored chunks of each query ``(query, source, chunk_no, score)``.

    The postings of wanted terms move once, to their block's task, where queries are scored against whole blocks: pairs of
    query and chunk are never rows. More query terms than may go to every task are joined and summed instead.
    """
    asked = wanted.limit(QUERY_TERM_LIMIT + 1).toArrow()
    if asked.num_rows > QUERY_TERM_LIMIT:
        return top_k_per_query(_pair_scores(index, wanted, query), [query], k, _order()).drop("rank")
    asked = asked.sort_by(query).combine_chunks()
    ids, starts = _runs(asked[query].combine_chunks())
    coded = asked["term"].combine_chunks().dictionary_encode()
    factors, terms = asked["factor"].to_numpy(), coded.indices.to_numpy()
    _, one = np.unique(terms, return_index=True)
    names = pa.table({"term": coded.dictionary, "tid": pa.array(np.arange(len(coded.dictionary)), pa.int32()), "idf": asked["idf"].take(pa.array(one))})
    kinds = [index.norms.schema[c] for c in CHUNK]
    schema = T.StructType([wanted.schema[query], *kinds, T.StructField("score", T.DoubleType())])

    # A chunk's length comes as a row of its own before its terms.
    hits = index.postings.join(F.broadcast(wanted.sparkSession.createDataFrame(names)), "term").select("block", *CHUNK, "tid", (F.col("tf") * F.col("idf")).alias("w"))
    rows = hits.union(index.norms.select("block", *CHUNK, F.lit(-1), "norm"))
    blocks = rows.repartition("block").sortWithinPartitions("block", F.desc("source"), F.desc("chunk_no"), "tid")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, held, block = BlockSearch(starts, terms, factors, k), [], None

        def scored() -> Iterator[pa.RecordBatch]:
            own = pa.Table.from_batches(held).combine_chunks()
            tid, w = own["tid"].to_numpy(), own["w"].to_numpy()
            place = np.cumsum(tid < 0) - 1
            heads = np.flatnonzero(tid < 0)
            posting = tid >= 0
            if posting.any():
                q, at, score = search.block(place[posting], tid[posting], w[posting] / w[heads][place[posting]], len(heads))
                chunk = pa.array(heads[at])
                keys = [own[c].combine_chunks().take(chunk) for c in CHUNK]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), *keys, pa.array(score)], names=schema.names)

        for batch in batches:
            numbers = batch["block"].to_numpy()
            edges = np.flatnonzero(numbers[1:] != numbers[:-1]) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)]):
                if held and numbers[a] != block:
                    yield from scored()
                    held = []
                block = numbers[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from scored()

    return blocks.mapInArrow(of, schema)


def _runs(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a sorted column once each, and where their runs start and the last one ends."""
    runs = pc.run_end_encode(values)
    return runs.values, np.concatenate([[0], runs.run_ends.to_numpy()]).astype(np.int64)


def _order() -> list[Column]:
    return [F.desc("score"), F.desc("source"), F.desc("chunk_no")]


def tfidf_search(index: TermIndex, queries: DataFrame, query: str, text: str, k: int = DEFAULT_K) -> DataFrame:
    """The ``k`` chunks most similar to each query ``(query, rank, source, chunk_no, score)``.

    Only chunks that share a term are scored, and of these only blocks that can reach the best ``k``. Of equal scores the
    later chunk comes first; a query with fewer than ``k`` scored chunks is filled with the last chunks at score 0.
    """
    best = best_chunks(index, query_terms(index, queries, query, text), query, k)
    # The best few per query are read twice below, so they are written once.
    found = stage(top_k_per_query(best, [query], k, _order()).drop("rank"), "hits")
    # At most k - 1 of the last 2k chunks can be scored already when a query needs filling.
    last = index.chunks.select(*CHUNK).orderBy(F.desc("source"), F.desc("chunk_no")).limit(2 * k)
    filler = (
        queries.select(query, last.agg(F.collect_list(F.struct(*CHUNK))).scalar().alias("last"))
        .select(query, F.explode("last").alias("c"))
        .select(query, "c.*", F.lit(0.0).alias("score"))
        .join(found.select(query, *CHUNK), [query, *CHUNK], "left_anti")
    )
    return top_k_per_query(found.unionByName(filler), [query], k, _order()).select(query, "rank", *CHUNK, "score")


def _salted_join(postings: DataFrame, wanted: DataFrame, salts: int = 64) -> DataFrame:
    """Join on term with each posting list spread over ``salts`` tasks."""
    spread = postings.withColumn("salt", F.pmod(F.xxhash64(*CHUNK), F.lit(salts)))
    copies = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(copies, ["term", "salt"]).drop("salt")


def normalise(vector: Column | str) -> Column:
    """Unit-length vector as ``array<double>``; a zero vector stays as it is."""
    vector = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(length > 0, F.transform(vector, lambda x: x / length)).otherwise(vector)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(length > 0, length, 1.0)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Unit-length rows of an Arrow list column."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit_rows(flat.reshape(len(lists), -1))


def _best_places(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and score of the ``k`` best vectors per query; of equal scores the earlier vector comes first.

    Products are made in slices, and only a slice's best ``k`` with their ties are looked at again.
    """
    rows, places, scores = [], [], []
    for at in range(0, len(vectors), VECTOR_SLICE):
        part = np.round(queries @ vectors[at : at + VECTOR_SLICE].T, SCORE_DIGITS)
        few = min(k, part.shape[1])
        low = np.partition(part, part.shape[1] - few, axis=1)[:, part.shape[1] - few]
        row, col = np.nonzero(part >= low[:, None])
        rows.append(row)
        places.append(col + at)
        scores.append(part[row, col])
    row, place, score = np.concatenate(rows), np.concatenate(places), np.concatenate(scores)
    order = np.lexsort((place, -score, row))
    row, place, score = row[order], place[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], place[rank < k], score[rank < k]


def _found(names: Sequence[str], qids: pa.Array, queries: np.ndarray, ids: pa.Array, vectors: np.ndarray, k: int) -> pa.RecordBatch:
    row, place, score = _best_places(queries, vectors, k)
    return pa.RecordBatch.from_arrays([qids.take(pa.array(row)), ids.take(pa.array(place)), pa.array(score)], names=list(names))


def _later_first(ids: pa.Array) -> pa.Array:
    return pc.array_sort_indices(ids, order="descending")


def _few_queries(vectors: DataFrame, queries: list, names: Sequence[str], schema: T.StructType, k: int) -> DataFrame:
    """The best ``k`` of each batch of vectors for a bounded list of queries, which goes to every task."""
    matrix = _unit_rows(np.asarray([q[1] for q in queries], dtype=np.float64))
    qids = [q[0] for q in queries]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = _later_first(batch[0])
                asked = pa.array(qids, to_arrow_type(schema[0].dataType))
                yield _found(names, asked, matrix, batch[0].take(order), _matrix(batch[1].take(order)), k)

    return vectors.mapInArrow(of, schema)


def _many_queries(vectors: DataFrame, queries: DataFrame, names: Sequence[str], schema: T.StructType, k: int) -> DataFrame:
    """The best ``k`` per query of every cell, a bounded share of the vectors.

    Vectors are written once with a number and dealt to cells by it; every query goes to every cell. A task holds one
    cell at a time, which comes before its queries, and lets them pass in batches.
    """
    numbered = stage(vectors.toDF("vid", "v").withColumn("n", F.monotonically_increasing_id()), "vectors")
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = max(width, -(-numbered.count() // CELL_ROWS))
    none = lambda field: F.lit(None).cast(field.dataType)
    held = numbered.select(F.pmod(F.xxhash64("n"), F.lit(cells)).alias("cell"), F.lit(0).alias("side"), none(schema[0]).alias("qid"), "vid", "v")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long")))
    asked = queries.toDF("qid", "v").select(every.alias("cell"), F.lit(1).alias("side"), "qid", none(schema[1]).alias("vid"), "v")
    dealt = held.unionByName(asked).repartition(cells, "cell").sortWithinPartitions("cell", "side")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, ids, matrix = None, [], None, None
        for batch in batches:
            cells_, sides = batch["cell"].to_numpy(), batch["side"].to_numpy()
            edges = np.flatnonzero((cells_[1:] != cells_[:-1]) | (sides[1:] != sides[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(cells_)]):
                piece = batch.slice(a, b - a)
                if cells_[a] != cell:
                    cell, waiting, ids, matrix = cells_[a], [], None, None
                if sides[a] == 0:
                    waiting.append((piece["vid"], _matrix(piece["v"])))
                    continue
                if waiting:
                    ids = pa.concat_arrays([w[0] for w in waiting])
                    order = _later_first(ids)
                    ids, matrix, waiting = ids.take(order), np.concatenate([w[1] for w in waiting])[order.to_numpy()], []
                if matrix is None:
                    continue
                wanted = _matrix(piece["v"])
                for at in range(0, len(wanted), QUERY_SLICE):
                    yield _found(names, piece["qid"].slice(at, QUERY_SLICE), wanted[at : at + QUERY_SLICE], ids, matrix, k)

    return dealt.mapInArrow(of, schema)


def vector_search(
    vectors: DataFrame, vec_id: str, vec: str, queries: DataFrame, query: str, query_vec: str, k: int = DEFAULT_K
) -> DataFrame:
    """The ``k`` vectors of largest inner product per query, all vectors scaled to unit length.

    Exact: products are made in blocks of queries and vectors inside the tasks, which hand on only the best ``k`` per
    query. Up to ``QUERY_BLOCK`` queries go to the vectors; more than that are a table which meets the vectors in cells.
    The vectors are read once for any number of queries. Rows without a vector are left out; of equal scores the
    vector of the larger id comes first.
    """
    ours = vectors.where(F.col(vec).isNotNull()).select(vec_id, F.col(vec).cast("array<double>"))
    asked = queries.where(F.col(query_vec).isNotNull()).select(query, F.col(query_vec).cast("array<double>"))
    fields = [queries.schema[query], vectors.schema[vec_id]]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("score", T.DoubleType())])
    names = schema.names
    few = asked.limit(QUERY_BLOCK + 1).collect()
    if not few:
        return vectors.sparkSession.createDataFrame([], schema).select(query, F.lit(1).alias("rank"), vec_id, "score")
    best = _few_queries(ours, few, names, schema, k) if len(few) <= QUERY_BLOCK else _many_queries(ours, asked, names, schema, k)
    return top_k_per_query(best, [query], k, [F.desc("score"), F.desc(vec_id)]).select(query, "rank", vec_id, "score")
