"""Spelling variants by permuterm rotations.

A word is marked with a terminator; all rotations of the marked word are sorted.
The edited character of a replacement, insertion or deletion is the last one of
some rotation, so near words agree in a rotation but for that character: the
key of a rotation is what stands before it (*skip*), or all of it (*whole*, a
word that has no character there).  Rows of one key are neighbours:

* two skips are one replacement apart, at one place: each pair in one key only;
* the whole and a skip are one insertion apart.  Where the character is one of
  a run of equal ones, only the run's first counts (*lead*), so such a pair, too,
  meets in one key only.

So no pair is sent or counted twice: a scan over the sorted keys emits for each
row the number of its neighbours there and the best, one row each.  A key has at
most one whole and a skip for each letter of the alphabet, hence no hot group.

Keys longer than ``TEXT_KEY`` are replaced by 95 bits of fingerprints, so that a
run of a million letters has rows in proportion to its length.  Words carry an id
that ascends in code-point order; texts are joined at the end.

Edge cases: null and empty texts have no words; a null doc_id reads as the empty
text; repeated rows count again; a run of any length is a word; a table without
words gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .rolling import Prefixes, mixed

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MARK = "$"
TEXT_KEY = 64
#: Distinct words that a task holds before it sends its counts, rotations that it sends at once.
HELD, SENT = 200_000, 50_000
WHOLE, SKIP, LEAD = 0, 1, 2


def damaged(doc_id: int | None, run: str, every: int) -> str:
    """``run`` without one of its characters, for one in ``every`` (document, run)."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3, damage_every: int | None = None) -> DataFrame:
    """(word, n) of the runs of letters in (doc_id, text), A-Z lower-cased;
    ``damage_every``: see ``damaged`` (null: none is)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                runs = Counter(RUN.findall((text.as_py() or "").encode().lower().decode()))
                doc_id = doc.as_py()
                for word, n in runs.items():
                    if damage_every:
                        word = damaged(doc_id, word, damage_every)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield send()
        if held:
            yield send()

    counted = docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def rotation_keys(word: str) -> Iterator[tuple[list[str], list[int]]]:
    """Pieces of (keys, kinds) of a word's rotations."""
    size, ring = len(word), word + MARK + word
    lead = [SKIP if i and word[i] == word[i - 1] else LEAD for i in range(size)]
    for length, first, kinds in ((size, 1, lead), (size + 1, 0, [WHOLE] * (size + 1))):
        if length <= TEXT_KEY:
            yield [ring[first + i:first + i + length] for i in range(len(kinds))], kinds
            continue
        prefixes = Prefixes(np.frombuffer(ring.encode("utf-32-le"), "<u4"))
        for lo in range(0, len(kinds), SENT):
            starts = first + np.arange(lo, min(lo + SENT, len(kinds)))
            fps, checks = mixed(prefixes.fingerprints(starts, starts + length)), prefixes.checks(starts, starts + length)
            yield [f"#{length}:{f:x}:{c:x}" for f, c in zip(fps.tolist(), checks.tolist())], kinds[lo:lo + SENT]


def rotations(words: DataFrame) -> DataFrame:
    """(key, kind, id, n) of all rotations of ``words`` (id, word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[str] = []
        kinds: list[int] = []
        owners: list[tuple[int, int, int]] = []

        def send() -> pa.RecordBatch:
            ids, ns, times = (np.array(x, np.int64) for x in zip(*owners))
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.int8()), pa.array(np.repeat(ids, times)),
                                              pa.array(np.repeat(ns, times))], names=["key", "kind", "id", "n"])
            for x in (keys, kinds, owners):
                x.clear()
            return out

        for batch in batches:
            for id_, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for some, of in rotation_keys(word):
                    keys.extend(some)
                    kinds.extend(of)
                    owners.append((id_, n, len(some)))
                    if len(keys) >= SENT:
                        yield send()
        if keys:
            yield send()

    return words.select("id", "word", "n").mapInArrow(run, "key string, kind tinyint, id bigint, n bigint")


def _neighbours(kinds: list[int], ids: list[int], ns: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(id, near, best_n, best) of each row of one key with neighbours; rows by
    descending n, ascending id."""
    skips = [i for i, k in enumerate(kinds) if k != WHOLE]
    wholes = [i for i, k in enumerate(kinds) if k == WHOLE]
    leads = [i for i in skips if kinds[i] == LEAD]
    for i in wholes:
        if leads:
            yield ids[i], len(leads), ns[leads[0]], ids[leads[0]]
    for i in skips:
        others = skips[:2] if skips[0] != i else skips[1:2]     # the best other is among the first two
        near, best = len(skips) - 1, [x for x in others if x != i][:1]
        if wholes and kinds[i] == LEAD:
            near, best = near + 1, sorted(best + wholes)[:1]
        if near:
            yield ids[i], near, ns[best[0]], ids[best[0]]


def neighbours(keys: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best): for each word of ``rotations`` that has near
    words their number, and the one of largest n (ties: smallest id)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
            out: list[tuple[int, int, int, int]] = []
            sizes = np.diff(bounds)
            many = np.nonzero(sizes > 1)[0]
            rows = np.repeat(bounds[many], sizes[many]) + np.arange(sizes[many].sum()) - np.repeat(np.cumsum(sizes[many]) - sizes[many], sizes[many])
            kind, id_, n = (table.column(c).take(pa.array(rows)).to_pylist() for c in ("kind", "id", "n"))
            lo = 0
            for size in sizes[many].tolist():
                out.extend(_neighbours(kind[lo:lo + size], id_[lo:lo + size], n[lo:lo + size]))
                lo += size
            columns = zip(*out) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["id", "near", "best_n", "best"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
            key = table.column("key").combine_chunks() if table.num_rows else None
            change = np.nonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False))[0] + 1 if table.num_rows > 1 else np.zeros(0, int)
            last = int(change[-1]) if len(change) else 0        # the last key may go on in the next batch
            if last:
                yield groups(table, np.concatenate(([0], change)))
            rest = table.slice(last).combine_chunks()
        if rest is not None:
            yield groups(rest, np.array([0, rest.num_rows]))

    found = (keys.repartition("key").sortWithinPartitions("key", F.desc("n"), "id")
             .mapInArrow(scan, "id bigint, near bigint, best_n bigint, best bigint"))
    return found.groupBy("id").agg(F.sum("near").alias("n_near"),
                                   F.max(F.struct("best_n", (-F.col("best")).alias("last"))).alias("top")).select(
        "id", "n_near", F.col("top.best_n").alias("best_n"), (-F.col("top.last")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) for each row of ``forms`` (id, form): the end of the chain
    from form to form.  Pointers double, so a chain of k takes log2 k rounds."""
    hops = stored(forms.select("id", F.col("form").alias("root")), "hops")
    while True:
        next_ = hops.select(F.col("id").alias("via"), F.col("root").alias("far"))
        moved = hops.join(next_, hops.root == next_.via, "left")
        hops = stored(moved.select("id", F.coalesce("far", "root").alias("root"), F.isnotnull("far").alias("moved")), "hops")
        if not hops.where("moved").limit(1).count():
            return hops.select("id", "root")
        hops = hops.select("id", "root")


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each distinct word of ``words``
    (word, n).  Its form is the near word of largest n, if that is ``ratio`` times
    its own n or more."""
    ordered = words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
    named = stored(ordered.withColumn("id", F.monotonically_increasing_id()), "words")
    near = stored(neighbours(rotations(named)), "near")
    forms = stored(named.join(near, "id").where(F.col("best_n") >= ratio * F.col("n")).select("id", F.col("best").alias("form"), F.col("best_n").alias("form_n")), "forms")
    ends = roots(forms)
    text = named.select(F.col("id").alias("text_id"), F.col("word").alias("text"))
    known = (forms.join(ends, "id").join(text, F.col("form") == F.col("text_id")).select("id", F.col("text").alias("form"), "form_n", "root")
             .join(text, F.col("root") == F.col("text_id")).select("id", "form", F.col("text").alias("root"), "form_n"))
    return named.join(near.select("id", "n_near"), "id", "left").join(known, "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


VARIANTS_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, COUNT(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs GROUP BY ALL),
crcs AS (
  SELECT run, n, xor(4294967295, list_reduce(range(0, (len(h) // 2)::INT),
    lambda c, k: xor(c >> 8, t[(xor(c, ('0x' || substr(h, 2 * k + 1, 2))::BIGINT) & 255) + 1]), 4294967295)) AS crc FROM counted, tab),
damaged AS (SELECT CASE WHEN crc % 97 = 0 THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM crcs),
words AS (SELECT word, SUM(n)::BIGINT AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING SUM(n) >= 3),
less AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT less.word, w.word FROM less JOIN words w ON less.rest = w.word
  UNION SELECT w.word, less.word FROM less JOIN words w ON less.rest = w.word),
ranked AS (SELECT near.word, other, w.n AS other_n, COUNT(*) OVER (PARTITION BY near.word) AS n_near,
  row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, encode(other)) AS place FROM near JOIN words w ON w.word = other),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * words.n THEN other END AS form,
  CASE WHEN other_n >= 2 * words.n THEN other_n END AS form_n FROM words LEFT JOIN ranked ON ranked.word = words.word AND place = 1),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.at WHERE forms.form IS NOT NULL),
ends AS (SELECT chain.word, chain.at AS root FROM chain JOIN forms ON forms.word = chain.at WHERE forms.form IS NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN ends ON ends.word = forms.word
"""
