"""Exact top-k inner-product search by columnar branch-and-bound.

Vectors are quantised to integers, floor(scale * x).  Candidates are dealt by
hash into shards, queries into blocks; each (shard, block) pair meets in one
task, where the shard lies in vertical layout, a row for each dimension.
Scores accumulate block of dimensions by block.  After each, the mass that
remains (the norms of the dimensions not yet seen) bounds every partial score
from above by Cauchy-Schwarz and from below likewise; a candidate whose upper
bound is below the k-th best lower bound of a query is out, and when enough are
out the survivors are compacted.  Dimensions are taken by descending mass, so
bounds close early.  Each task sends the best k of its shard for each query,
and the best k of these are kept.

Shards and blocks have a largest size, so a task's memory does not grow with the
tables; their number does.  A candidate is sent once for each block of queries, a
query once for each shard: n * q / 16,384 rows at least, or 3 times the table at a
million vectors of which one in 50 asks.  The only broadcast is one short row for each length
of vectors (n lengths take a table of at least n * n / 2 components).

Scores are exact 64-bit integers.  Vectors with a norm of ``LARGE`` or more, whose
scores might not be, meet all others outside the bounds: the product of the two
norms, or else Python integers, tell which scores fit.

Edge cases: vectors that are null, empty or hold null or non-finite components
take no part, nor do those whose quantised components leave 64 bits, nor pairs
whose score does; only vectors of equal length are compared; repeated rows (same id, same vector) count once; of several vectors
with one id each asks for itself, and none is another's candidate; ties go to the smaller id; a null id is no candidate; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most rows of a shard of candidates and of a block of queries, so that a task
#: holds 32 MB of 64 dimensions; queries that are scored together.
SHARD, BLOCK, TOGETHER = 32_768, 32_768, 64
#: Fewest rows of a shard that is cut off to give every partition of a shuffle work.
LEAST_SHARD = 8_192
#: Dimensions added between two rounds of bounds.
STEP = 16
#: Two norms below this have a product, and so every partial score, below 2^62.
LARGE = 2.0**31


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v, dims): integer vectors of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double") * scale)
    good = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    small = F.forall("v", lambda x: F.abs(x) < 2.0**63)
    return (vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & good)
            .select("vec_id", v.alias("v")).where(small)
            .select("vec_id", F.transform("v", lambda x: F.floor(x).cast("bigint")).alias("v"), F.size("v").alias("dims")))


class Shard:
    """Candidates in vertical layout."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """vectors: a row for each candidate, in ascending order of ids."""
        self.ids, n_dims = ids, vectors.shape[1]
        mass = (vectors.astype(float) ** 2).sum(0)
        self.order = np.argsort(-mass, kind="stable")           # heaviest dimensions first
        self.columns = np.ascontiguousarray(vectors.T[self.order])
        self.cuts = [*range(0, n_dims, STEP), n_dims]
        #: Norm of the dimensions from each cut on, for each candidate.
        tail = np.cumsum((self.columns.astype(float) ** 2)[::-1], axis=0)[::-1]
        self.rest = [np.sqrt(tail[c]) if c < n_dims else np.zeros(len(ids)) for c in self.cuts]
        # Sums below 2^53 are exact in floating point, where products are fast; a score and a bound are half of that each.
        self.largest = float(np.abs(vectors).max(initial=0))

    def best(self, own: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Query's row, ids and scores of its best k here."""
        exact = self.largest * float(np.abs(queries).max(initial=0)) * queries.shape[1] < 2**52
        kind = np.float64 if exact else np.int64
        columns, q = self.columns.astype(kind, copy=False), queries[:, self.order].astype(kind)
        for lo in range(0, len(q), TOGETHER):
            some = q[lo:lo + TOGETHER]
            tail = np.cumsum((some.astype(float) ** 2)[:, ::-1], axis=1)[:, ::-1]
            alive, part, held = np.arange(len(self.ids)), np.zeros((len(some), len(self.ids)), kind), columns
            mine = own[lo:lo + TOGETHER][:, None] == self.ids[None, :]
            for at, to in zip(self.cuts, self.cuts[1:]):
                part += some[:, at:to] @ held[at:to]
                if to < queries.shape[1] and len(alive) > 4 * k:
                    # Whole numbers, so that the bounds of large sums aren't rounded.
                    slack = np.ceil(np.sqrt(tail[:, to])[:, None] * self.rest[self.cuts.index(to)][alive][None, :] * (1 + 1e-9) + 1).astype(kind)
                    low = np.where(mine[:, alive], -np.inf if exact else np.iinfo(np.int64).min, part - slack)
                    bar = np.partition(low, len(alive) - k, axis=1)[:, len(alive) - k]
                    stay = (part + slack >= bar[:, None]).any(0)
                    if stay.mean() < 0.75:
                        alive, part, held = alive[stay], part[:, stay], np.ascontiguousarray(held[:, stay])
            score = part.astype(np.int64)
            for i in range(len(some)):
                others = np.nonzero(~mine[i, alive])[0]
                s = score[i, others]
                if len(s) > k:      # all that reach the k-th best score; ids ascend, so a stable sort settles ties
                    reach = np.nonzero(s >= np.partition(s, len(s) - k)[len(s) - k])[0]
                    others, s = others[reach], s[reach]
                first = np.argsort(-s, kind="stable")[:k]
                yield lo + i, self.ids[alive[others[first]]], s[first]


def best_of(ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As ``Shard.best``, for vectors of any norm; a query may come twice, with
    its best k of ordinary candidates and of others."""
    norms, asked = (np.sqrt((x.astype(float) ** 2).sum(1)) for x in (vectors, queries))
    plain, asks = np.nonzero(norms < LARGE)[0], np.nonzero(asked < LARGE)[0]
    if len(plain) and len(asks):
        for i, found, score in Shard(ids[plain], vectors[plain]).best(own[asks], queries[asks], k):
            yield asks[i], found, score
    large = np.nonzero(norms >= LARGE)[0]
    for i in range(len(queries)):
        some = large if asked[i] < LARGE else np.arange(len(ids))
        if not len(some):
            continue
        score = vectors[some] @ queries[i]                      # modulo 2^64, so right where the score fits
        fits = ids[some] != own[i]
        q = queries[i].tolist()
        for j in np.nonzero(fits & (norms[some] * asked[i] >= 2.0**62))[0]:
            fits[j] = -2**63 <= sum(a * b for a, b in zip(vectors[some[j]].tolist(), q)) < 2**63
        some, score = some[fits], score[fits]
        first = np.argsort(~score, kind="stable")[:k]           # ~ descends and, unlike -, never overflows
        yield i, ids[some[first]], score[first]


def _vectors(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def top_k(vectors: DataFrame, query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id,
    embedding) that ``query`` selects, its k best other rows."""
    rows = quantised(vectors, scale).distinct()
    counts = rows.groupBy("dims").agg(F.count("*").alias("n"), F.count_if(query).alias("q"))
    rows = rows.join(F.broadcast(counts), "dims")
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = F.greatest(F.ceil(F.col("n") / SHARD), F.least(F.lit(partitions), F.ceil(F.col("n") / LEAST_SHARD)))
    blocks = F.ceil(F.col("q") / BLOCK)
    mark = F.xxhash64("vec_id", "v")

    def to(side: Column, shard: Column, block: Column) -> Column:
        return F.struct(F.struct("dims", shard.alias("shard"), block.alias("block")).alias("task"), side.alias("asks"))

    # Every candidate goes to its shard for each block of queries, every query to its block for each shard.
    as_candidate = F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1), lambda b: to(F.lit(False), F.pmod(mark, shards), b))
    as_query = F.transform(F.sequence(F.lit(0).cast("bigint"), shards - 1), lambda s: to(F.lit(True), s, F.pmod(mark, blocks)))
    dealt = (rows.where("q > 0")
             .select("vec_id", "v", F.explode(F.when(query, F.concat(as_candidate, as_query)).otherwise(as_candidate)).alias("to"))
             .select(F.col("to.task").alias("task"), F.col("to.asks").alias("asks"), "vec_id", mark.alias("mark"), "v"))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("vec_id", "ascending")])
        asks = table.column("asks").to_numpy()
        ids = table.column("vec_id").to_numpy()
        v = _vectors(table.column("v").combine_chunks(), key[0].as_py()["dims"])
        marks = table.column("mark").to_numpy()[asks]
        found = list(best_of(ids[~asks], v[~asks], ids[asks], v[asks], k)) if asks.any() and not asks.all() else []
        at = np.repeat(np.array([x[0] for x in found], int), [len(x[1]) for x in found])
        columns = [ids[asks][at], marks[at], *(np.concatenate([x[i] for x in found]) if found else np.zeros(0, int) for i in (1, 2))]
        return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(("query_id", "mark", "vec_id", "score"), columns)})

    best = dealt.groupBy("task").applyInArrow(run, "query_id bigint, mark bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
