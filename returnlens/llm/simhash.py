"""SimHash near-duplicates by vantage-point trees over Hamming distance.

1. ``fingerprints``: 64-bit SimHash of every whole text over word shingles.
2. ``links``: exact pairs of distinct fingerprints at most ``max_bits`` apart,
   found by vantage-point trees.  The 64 bits are cut into parts so that a
   linked pair is at most one bit apart in one of them; each part has a tree.
   A level of a tree takes the Hamming distance of one block of bits to a
   vantage point, and each distance is a branch.  Block distances add up, so
   by the triangle inequality the branches of a linked pair differ in at most
   one level and there by one ring: every other branch is pruned.  The leaves
   are the shards: a fingerprint lives in its own and is also sent, as a
   query, to the neighbouring shard of each level that its ball overlaps
   (only outward, so each pair of shards meets once).  In a shard
   all remaining pairs are compared exactly.
3. ``components``: connected components of the links, by alternating large
   and small stars; every round is a table in the shared folder.

Only distinct fingerprints are compared, a shard sends a spanning star of
each of its groups and never all pairs, and copies meet only in aggregates and
joins on the fingerprint.  The number of levels follows the number of
fingerprints, so shards keep their size as the corpus grows.

Edge cases: null and empty texts have fingerprint zero and are linked like any
other; texts shorter than a shingle are one shingle; repeated rows give
repeated result rows; a null doc_id is smaller than none (a component of null
ids only has a null id); an empty table gives no rows; extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, unused

SEED = 42
#: Fingerprints that a shard should hold on average, queries included.
SHARD = 4096
#: A vantage point with so many linked fingerprints is handled as one group.
DENSE = 32
VANTAGE = 0x9E3779B97F4A7C15


def simhash(text: str, shingle: int) -> int:
    """Bit i is set if set in over half of the shingles' hashes."""
    words = text.encode().lower().split()       # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle))))]
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        bits = np.array(hashes[lo:lo + (1 << 16)], "<u8").view(np.uint8)
        counts += np.unpackbits(bits, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` (its last column is the text) and ``fp``."""
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py() or "", shingle) for t in batch.columns[-1]], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=schema.names)

    return docs.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed bigint."""
    return with_fingerprint(docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text"), shingle, ["doc_id"])


class Tree:
    """Shard keys in one part of the bits, ``width`` bits a level."""

    def __init__(self, low: int, bits: int, width: int, radius: int) -> None:
        self.blocks = [(low + at, min(width, bits - at)) for at in range(0, bits, width)]
        self.radius = radius

    def keys(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and shard keys: first each fingerprint's own shard, then the
        next outer ring of each level."""
        key, step, rings = np.zeros(len(fps), np.int64), 1, []
        for at, n in self.blocks:
            block = ((fps ^ np.uint64(VANTAGE)) >> np.uint64(at)) & np.uint64((1 << n) - 1)
            ring = np.bitwise_count(block).astype(np.int64)
            rings.append((ring, n, step))
            key += ring * step
            step *= n + 1
        yield np.arange(len(fps)), key
        if self.radius:
            for ring, n, step in rings:
                at = np.nonzero(ring < n)[0]
                yield at, key[at] + step


def trees(count: int, max_bits: int) -> list[Tree]:
    """One tree for each part of the bits.  With (max_bits + 1) / 2 parts, one
    part of a linked pair holds at most one differing bit."""
    parts = max(1, (max_bits + 1 + 1) // 2)
    cuts = [64 * i // parts for i in range(parts + 1)]
    radius = min(1, max_bits)
    for width in (8, 4, 2, 1):
        bits = cuts[1]
        levels = -(-bits // width)
        shards = {8: 5.1, 4: 3.66, 2: 2.67, 1: 2.0}[width] ** levels    # 1 / the chance of two random blocks on one ring
        if count * (1 + levels * radius) <= SHARD * shards:
            break
    return [Tree(a, b - a, width, radius) for a, b in zip(cuts, cuts[1:])]


class Groups:
    """Union-find over the rows of a shard; a root is its smallest member."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Union of all pairs (a, b): smallest labels spread until stable."""
        while len(a):
            root = self.roots()
            ra, rb = root[a], root[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def shard_links(fps: np.ndarray, home: np.ndarray, max_bits: int) -> np.ndarray:
    """Root of each fingerprint in the graph of all pairs at most ``max_bits``
    apart of which at least one lives here.  ``home``: lives in this shard."""
    groups = Groups(len(fps))
    alive = home.copy()                 # rows whose pairs are still to be looked for
    rng = np.random.default_rng(len(fps))
    for v in rng.choice(len(fps), min(16, len(fps)), replace=False) if len(fps) > 8 * DENSE else ():
        away = np.bitwise_count(fps ^ fps[v])
        ball = np.nonzero(alive & (away <= max_bits))[0]
        if len(ball) < DENSE or not home[v]:
            continue
        # All of the ball is linked to v; what links to the ball is, by the
        # triangle bound, at most max_bits farther out.
        groups.join(ball, np.full(len(ball), v))
        near = np.nonzero(away <= 2 * max_bits)[0]
        _compare(fps, ball, near, max_bits, groups)
        alive[ball] = False
    rows = np.nonzero(alive)[0]
    _compare(fps, rows, np.nonzero(alive | ~home)[0], max_bits, groups)
    return groups.roots()


def _compare(fps: np.ndarray, rows: np.ndarray, others: np.ndarray, max_bits: int, groups: Groups) -> None:
    step = max(1, (1 << 21) // max(1, len(others)))
    for lo in range(0, len(rows), step):
        some = rows[lo:lo + step]
        i, j = np.nonzero(np.bitwise_count(fps[some][:, None] ^ fps[others][None, :]) <= max_bits)
        groups.join(some[i], others[j])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of each run of rows that agree in the first column."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cuts = np.nonzero(np.diff(columns[0]))[0] + 1
        pieces = list(zip(*(np.split(c, cuts) for c in columns))) if batch.num_rows else []
        for piece in pieces:
            if held and held[-1][0][0] != piece[0][0]:
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
            held.append(piece)
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def links(distinct: DataFrame, count: int, max_bits: int = 3) -> DataFrame:
    """(a, b): spanning links of the graph on the distinct fingerprints
    ``distinct`` (fp), ``count`` of them.  Each linked pair is connected by
    links of its shard; no link is between unlinked groups."""
    forest = trees(count, max_bits)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for t, tree in enumerate(forest):
                for own, (rows, keys) in enumerate(tree.keys(fps)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys * len(forest) + t), pa.array(np.full(len(rows), own == 0)), pa.array(fps[rows].view(np.int64))],
                        names=["shard", "home", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, home, fp in _runs(batches):
            fps = fp.view(np.uint64)
            if len(fps) < 2 or not home.any():
                continue
            root = shard_links(fps, home, max_bits)
            at = np.nonzero(root != np.arange(len(fps)))[0]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[root[at]])], names=["a", "b"])

    return (distinct.select("fp").mapInArrow(scatter, "shard bigint, home boolean, fp bigint")
            .repartition("shard").sortWithinPartitions("shard")
            .mapInArrow(search, "a bigint, b bigint"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge but the roots themselves;
    edges (a, b).  Large and small stars take turns until nothing moves."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """Hang the neighbours (larger ones, or those not larger) of each node
        on the smallest of node and neighbours."""
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = pairs.join(least, "u")
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else \
            hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    state, seen = stored(down, "stars"), None
    while (now := mark(state)) != seen:
        seen = now
        both = state.unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        state = stored(star(both, True), "stars")
        state = stored(star(state, False), "stars")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(fp, root, component_id, n_docs) for each distinct fingerprint of
    ``fps`` (doc_id, fp): its component's smallest fingerprint, the smallest
    doc_id that links reach from it, and its number of rows."""
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_docs")), "fingerprints")
    edges = stored(links(distinct, distinct.count(), max_bits), "links")
    roots = components(edges).withColumnRenamed("root", "linked")
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first_id", "n_docs", F.coalesce("linked", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id", "n_docs")


def deduplicated(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row
    stays, that of its smallest doc_id (null last; of rows that share the id,
    the one with the smallest text hash).  Columns as in ``docs``."""
    id_, hash_ = unused([*docs.columns, "doc_id", "fp", "root", "first"], "id", "hash")
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), hash_: F.xxhash64("text", F.isnull("doc_id"))})
    marked = stored(with_fingerprint(keyed.selectExpr("CAST(doc_id AS BIGINT) doc_id", f"`{id_}`", f"`{hash_}`", "text"), shingle,
                                     ["doc_id", id_, hash_]), "marked")
    classes = near_duplicates(marked.select("doc_id", "fp"), max_bits).select("fp", "root")
    first = F.min(F.struct(F.isnull("doc_id"), id_, hash_)).alias("first")
    keep = marked.join(classes, "fp").groupBy("root").agg(first).select(f"first.{id_}", f"first.{hash_}")
    # The join has put rows with one id and text together; repeated ones go.
    return keyed.join(keep, [id_, hash_], "left_semi").dropDuplicates([id_, hash_]).select(*docs.columns)
