"""MinHash near-duplicates: universal hash minima, bands, verification, stars.

1. ``sketches``: the distinct word shingles of every whole text, their number, a
   128-bit key of the set and its signature, the minima of ``HASHES`` functions
   a * x + b modulo 2^64 (upper 32 bits) over the shingles' hashes.  Equal sets
   are one node from here on, however many documents hold them.
2. ``buckets``: a signature is cut into bands of ``ROWS`` minima; nodes that agree
   in a band share its bucket.  With 32 bands of 4 a pair at similarity 0.85 meets
   in none with a chance of 6e-11.
3. First every member of a bucket is a candidate with the bucket's smallest node,
   the same one in most bands.  Candidates are verified by the signatures
   (``floor_of`` leaves out a pair at the threshold with a chance of 1e-10), then on
   the full sets.  Confirmed links make components; a bucket within one is done.
4. Members of buckets still open are candidates with a medoid, the node most like
   the others: in a cloud of near copies it is the text that they were made from,
   and joins most of them.
5. In buckets that are open even then, those outside the bucket's main component
   are compared with all its members, by signature and full set, in blocks.  A pair
   is compared in its first common band only, and only links leave the task.  So
   every pair that shares a bucket is linked, refuted or within one component.
6. ``components``: alternating large and small stars, tables in the shared folder.

Members of a bucket, or of a pivot, are dealt into groups of about ``group``, so no
bucket lands in one task.

Edge cases: null and empty texts, and those without words, have the empty set, no
links and themselves as component; fewer words than a shingle are one shingle;
repeated rows give repeated result rows; a null doc_id is larger than any (a
component of null ids only has a null id); an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .simhash import components

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
#: Parameters of the hash functions: odd factors and summands from a fixed seed.
FACTORS, SUMMANDS = np.random.default_rng(20).integers(0, 2**64, (2, HASHES), dtype=np.uint64)
FACTORS |= np.uint64(1)
#: Stands for a null id, larger than any.
NO_ID = 2**63 - 1
#: Shingles hashed by all functions at once.
BLOCK = 2_048
#: Members of a bucket or of a pivot that meet in one group.
GROUP = 256
#: Members of a group that the others are likened to when its medoid is chosen.
LIKENED = 64


def shingles(text: str | None, size: int) -> set[bytes]:
    """Distinct shingles of the words, A-Z lower-cased."""
    words = (text or "").encode().lower().split()       # bytes: only A-Z and ASCII white space
    if len(words) <= size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def hash_set(text: str | None, size: int) -> np.ndarray:
    """Ascending hashes of the distinct shingles."""
    found = shingles(text, size)
    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets have ``percent`` of their union in common."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of all functions over ``hashes`` (64 bits each)."""
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for lo in range(0, len(hashes), BLOCK):
        some = hashes[lo:lo + BLOCK]
        np.minimum(least, (FACTORS[:, None] * some[None, :] + SUMMANDS[:, None]).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, key, sig) of every row of ``docs`` (doc_id,
    text); key and sig are null where there are no shingles."""
    columns = ["doc_id", "text_hash", "n_shingles", "key", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, sigs = [], [], []
            for text in batch.column(2):
                hashes = hash_set(text.as_py(), size)
                counts.append(len(hashes))
                keys.append(xxhash.xxh3_128_digest(hashes) if len(hashes) else None)
                sigs.append(signature(hashes).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()),
                                              pa.array(sigs, pa.binary())], names=columns)

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
            .mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, key binary, sig binary"))


def buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, band, key): the bands of ``nodes`` (key, sig)."""
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    return nodes.select("key", "sig", band).select(
        F.xxhash64("band", F.expr(f"substring(sig, {4 * ROWS} * band + 1, {4 * ROWS})")).alias("bucket"), "band", "key")


def floor_of(percent: int) -> int:
    """Equal minima, of ``HASHES``, that a pair at the threshold fails to reach
    with a chance of 1e-10 at most."""
    p, below = percent / 100, 0.0
    for k in range(HASHES + 1):
        below += math.comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k)
        if below > 1e-10:
            return k
    return HASHES


def _minima(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint32).reshape(-1, HASHES)


def plausible(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The ``pairs`` (a, b) whose signatures agree in ``least`` minima."""
    left = nodes.select(F.col("key").alias("a"), F.col("sig").alias("sig_a"))
    right = nodes.select(F.col("key").alias("b"), F.col("sig").alias("sig_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_minima(batch.column(2).to_pylist()) == _minima(batch.column(3).to_pylist())).sum(1)
                yield batch.select([0, 1]).filter(pa.array(same >= least))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from (tuple(x.as_py() for x in row) for row in zip(*batch.columns))


def _pairs(found: Iterator[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """(a, b) in batches."""
    while some := list(islice(found, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*some)], names=["a", "b"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, group: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets, from ``sets`` (key, set), have at
    least ``percent`` of their union in common."""
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / group).alias("salts"))
    hosts = salts.join(sets.select(F.col("key").alias("b"), "set"), "b").select(
        "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("binary").alias("a"), "set")
    guests = pairs.join(sets.select(F.col("key").alias("a"), "set"), "a").join(salts, "b").select(
        "b", F.pmod(F.xxhash64("a"), "salts").alias("salt"), "a", "set")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
        host = None
        for b, _, a, found in _rows(batches):
            if a is None:                   # sorts first: the pivot, before its members
                host = np.frombuffer(found, np.uint64)
            elif linked(host, np.frombuffer(found, np.uint64), percent):
                yield a, b

    dealt = hosts.unionByName(guests).repartition("b", "salt").sortWithinPartitions("b", "salt", F.asc_nulls_first("a"))
    return dealt.mapInArrow(lambda batches: _pairs(compare(batches)), "a binary, b binary")


def first_pairs(bands: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket of ``bands`` and the bucket's smallest node."""
    pivots = bands.groupBy("bucket").agg(F.min("key").alias("b"))
    return bands.join(pivots, "bucket").where(F.col("key") != F.col("b")).select(F.col("key").alias("a"), "b").distinct()


def open_members(bands: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, band, n, main, rest, key, label): members, with their components,
    of the buckets of more than two that hold several components; of these the
    most frequent and the number of members outside it."""
    members = bands.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select(
        "bucket", "band", "key", F.coalesce("root", "key").alias("label"))
    labels = members.groupBy("bucket", "label").count()
    still = labels.groupBy("bucket").agg(F.sum("count").alias("n"), F.max(F.struct("count", "label")).alias("most"), F.count("*").alias("labels")).where(
        "labels > 1 AND n > 2").select("bucket", "n", F.col("most.label").alias("main"), (F.col("n") - F.col("most.count")).alias("rest"))
    return members.join(still, "bucket").select("bucket", "band", "n", "main", "rest", "key", "label")


def medoid_pairs(members: DataFrame, nodes: DataFrame, least: int, group: int) -> DataFrame:
    """(a, b): plausible pairs of a member of a group of an open bucket and the
    group's medoid ``b``, of another component."""
    dealt = members.join(nodes.select("key", "sig"), "key").select(
        "bucket", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / group)).alias("salt"), "key", "label", "sig")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
        for _, rows in groupby(_rows(batches), key=lambda row: row[:2]):
            keys, labels, sigs = (list(x) for x in list(zip(*rows))[2:])
            minima = _minima(sigs)
            like = sum((minima == other).sum(1) for other in minima[:LIKENED])
            at = int(like.argmax())         # of equal ones the smallest key
            for i in np.flatnonzero((minima == minima[at]).sum(1) >= least).tolist():
                if labels[i] != labels[at]:
                    yield keys[i], keys[at]

    return dealt.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "key").mapInArrow(
        lambda batches: _pairs(choose(batches)), "a binary, b binary").distinct()


def remaining_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, least: int, percent: int, group: int) -> DataFrame:
    """(a, b): links of the members outside an open bucket's main component with
    all members of other components.  Of a component one link is enough."""
    guest_blocks, host_blocks = F.ceil(F.col("rest") / group), F.ceil(F.col("n") / group)
    rows = members.join(nodes.select("key", "sig"), "key").join(sets, "key").withColumn("outside", F.col("label") != F.col("main"))

    def every(blocks: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))

    def put(guest: Column, host: Column, is_host: bool) -> DataFrame:
        return rows.where("true" if is_host else "outside").select(
            "bucket", guest.alias("guest"), host.alias("host"), F.lit(is_host).alias("is_host"), "band", "outside", "key", "label", "sig", "set")

    hosts = put(every(guest_blocks), F.pmod(F.xxhash64("key"), host_blocks), True)
    guests = put(F.pmod(F.xxhash64("key", F.lit(3)), guest_blocks), every(host_blocks), False)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
        for _, block in groupby(_rows(batches), key=lambda row: row[:3]):
            held: list[tuple] = []
            for _, _, _, is_host, band, outside, key, label, sig, found in block:
                if is_host:                 # sorts first
                    held.append((key, label, outside, sig, np.frombuffer(found, np.uint64)))
                    continue
                if not held:
                    break
                if len(held[0]) == 5:
                    keys, labels, outsides, sigs, sets_ = zip(*held)
                    minima, labels, outsides, keys = _minima(sigs), np.array(labels, object), np.array(outsides), np.array(keys, object)
                    held = [()]
                mine = np.frombuffer(sig, np.uint32)
                equal = minima == mine
                same = equal.sum(1)
                # Two members outside meet twice: the smaller one asks.
                good = np.flatnonzero((same >= least) & (labels != label) & (~outsides | (keys > key)))
                first = equal[good].reshape(-1, BANDS, ROWS).all(2).argmax(1)
                good = good[first == band]
                own, joined = np.frombuffer(found, np.uint64), set()
                for i in good[np.argsort(-same[good], kind="stable")].tolist():
                    if labels[i] not in joined and linked(sets_[i], own, percent):
                        joined.add(labels[i])
                        yield key, keys[i]

    dealt = hosts.unionByName(guests).repartition("bucket", "guest", "host").sortWithinPartitions("bucket", "guest", "host", F.desc("is_host"))
    return dealt.mapInArrow(lambda batches: _pairs(compare(batches)), "a binary, b binary")


def sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(key, set): the full set of each node of ``nodes`` (key, first: doc_id and
    text's hash of one of its documents)."""
    named = nodes.select("key", F.col("first.doc").alias("doc"), F.col("first.text_hash").alias("hash"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([hash_set(t.as_py(), size).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["key", "set"])

    # The join has put rows with one id and text together; repeated ones go.
    one = rows.join(named, ["doc", "hash"]).dropDuplicates(["doc", "hash"])
    return one.select("key", "text").mapInArrow(run, "key binary, set binary")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 85, group: int = GROUP) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id,
    text).  Documents link whose sets of shingles have at least ``percent`` of
    their union in common; ``kept``: the id is its component's."""
    sketch = stored(sketches(docs, shingle), "sketches")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text_hash")).alias("first")
    nodes = stored(sketch.where("key IS NOT NULL").groupBy("key").agg(first, F.min("doc_id").alias("least_id"), F.any_value("sig").alias("sig")), "nodes")
    every = buckets(nodes)
    shared = every.groupBy("bucket").count().where("count > 1").select("bucket")
    bands = stored(every.join(shared, "bucket"), "bands")
    live = stored(nodes.join(bands.select("key").distinct(), "key", "left_semi"), "live")
    sets = stored(sets_of(docs, live, shingle), "sets")
    least = floor_of(percent)

    def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
        """Components of the ``links`` and of those that made ``roots``."""
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(links) if roots is not None else links
        return components(stored(known, "links"))

    def left(roots: DataFrame) -> DataFrame | None:
        members = stored(open_members(bands, roots), "open")
        return members if members.limit(1).count() else None

    roots = joined(None, confirmed(stored(plausible(first_pairs(bands), live, least), "pairs"), sets, percent, group))
    if (members := left(roots)) is not None:
        roots = joined(roots, confirmed(stored(medoid_pairs(members, live, least, group), "pairs"), sets, percent, group))
        if (members := left(roots)) is not None:
            roots = joined(roots, remaining_links(members, live, sets, least, percent, group))
    label = nodes.join(roots, nodes.key == roots.node, "left").select("key", "least_id", F.coalesce("root", "key").alias("root"))
    least_id = label.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = label.join(least_id, "root").select("key", "component_id")
    return sketch.select("doc_id", "n_shingles", "key").join(classes, "key", "left").withColumn(
        "component_id", F.when(F.isnull("key"), F.col("doc_id")).otherwise(F.col("component_id"))).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM words),
nodes AS (SELECT row_number() OVER () AS node, s, len(s) AS n, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT node, n, unnest(s) AS x FROM nodes),
links AS (SELECT a.node AS a, b.node AS b FROM items a JOIN items b ON a.x = b.x AND a.node <> b.node AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
classes AS (SELECT node, s, least(least, coalesce((SELECT min(m.least) FROM reach JOIN nodes m ON m.node = reach.b WHERE reach.a = nodes.node), least)) AS component_id FROM nodes)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM sets LEFT JOIN classes ON classes.s = sets.s
"""
