"""Phrase collocations from Rabin-Karp fingerprints of all n-grams.

1. A task writes its lower-cased texts as words with one space between them and
   hashes every n-gram of them by prefix polynomials (``rolling.py``): 64 bits
   that stand for the n-gram and its language, and an independent check.  It
   counts equal ones and sends fingerprint, count, check and a pointer to one
   occurrence: language and text's hash, place in the text.  No text is shuffled.
2. The shuffle adds counts per fingerprint and keeps one pointer and the least and
   largest check.  What reaches ``min_count`` is stored.
3. Orders go up: an n-gram can be frequent only if both its (n-1)-grams are.  The
   stored fingerprints of each order set bits of a *sieve*, a bit array of fixed
   size, which the next order's tasks look up: it lets some others pass, so it
   saves rows and never loses one.
4. Only frequent phrases are materialised, from the text at their pointers; the
   text's fingerprint must be the pointer's.
5. Fingerprints of different checks have collided.  These are counted again by
   the text of every occurrence, and replace what step 2 counted.

Scores, cuts and containment are joins and aggregates on the frequent phrases,
with exact decimals.

Edge cases: null and empty texts have no words, a null lang is ``und``; the
doc_id is not read, so null or repeated ones don't matter and repeated rows count
again; texts of any length are read in windows with the words that follow; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .rolling import Prefixes, mixed

#: What cuts pieces, and what cuts words inside pieces.
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)], KIND[list(BREAKS)] = 1, 2
WORD = rb"[^\x20\x09.,;:!?\x0a-\x0d]+"
WORD_END = re.compile(rb"[\x20\x09.,;:!?\x0a-\x0d]")
UNKNOWN = "und"
#: Bits of a sieve and the number of its slices, as powers of two: 16 MB.
SIEVE, SLICES = 27, 6


class Settings(NamedTuple):
    """Of a task; results don't depend on them."""

    #: Bytes hashed together; n-grams held before they are counted and sent.
    window: int = 1 << 20
    held: int = 2_000_000
    #: Bits that fingerprints keep; tests keep few to make them collide.
    kept: int = (1 << 64) - 1


class Sieve:
    """Which n-grams may be frequent."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def passes(self, fps: np.ndarray) -> np.ndarray:
        at = fps >> np.uint64(64 - SIEVE)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def sieve_of(fps: DataFrame) -> np.ndarray:
    """Bits of the fingerprints ``fps`` (fp), set in tasks, a slice each."""
    size = 1 << (SIEVE - SLICES - 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - SIEVE)
            where = (at >> np.uint64(SIEVE - SLICES)).astype(np.int64)
            for s in np.unique(where).tolist():
                inside = at[where == s] & np.uint64((1 << (SIEVE - SLICES)) - 1)
                bits = slices.setdefault(s, np.zeros(size, np.uint8))
                np.bitwise_or.at(bits, (inside >> np.uint64(3)).astype(np.int64), np.uint8(1) << (inside & np.uint64(7)).astype(np.uint8))
        for s, bits in slices.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["slice", "bits"])

    dealt = fps.select("fp").repartition(1 << SLICES, F.shiftrightunsigned("fp", 64 - SLICES))
    out = np.zeros(size << SLICES, np.uint8)
    for row in dealt.mapInArrow(run, "slice int, bits binary").collect():     # 64 rows at most, each of fixed size
        out[row.slice * size:(row.slice + 1) * size] |= np.frombuffer(row.bits, np.uint8)
    return out


def lang_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 11)


def windows(docs: Iterator[tuple[int, str, bytes]], follow: int, window: int) -> Iterator[list[tuple[int, str, int, bytes, int]]]:
    """Groups of about ``window`` bytes of (doc, lang, offset, bytes, own): own
    bytes of a text, and up to ``follow`` words that follow them."""
    group: list[tuple[int, str, int, bytes, int]] = []
    held = 0
    more = re.compile(rb"(?:[\x20\x09]+%s){0,%d}" % (WORD, follow))
    for doc, lang, text in docs:
        at = 0
        while at < len(text):
            cut = WORD_END.search(text, at + window) if len(text) - at > window else None
            own = cut.start() if cut else len(text)
            end = more.match(text, own).end()
            group.append((doc, lang, at, text[at:end], own - at))
            held += end - at
            at = own
            if held >= window:
                yield group
                group, held = [], 0
    if group:
        yield group


class Grams:
    """All n-grams of the words of a group of windows."""

    def __init__(self, group: list[tuple[int, str, int, bytes, int]], kept: int) -> None:
        self.kept = np.uint64(kept)
        sizes = np.array([len(g[3]) + 1 for g in group])
        first = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"\n".join(g[3] for g in group) + b"\n", np.uint8)
        kind = KIND[data]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], kind == 0)).astype(np.int8)))
        self.raw_starts, raw_ends = edges[::2], edges[1::2]                   # the last byte is a break
        self.piece = np.cumsum(kind == 2)[self.raw_starts]
        self.window = np.searchsorted(first, self.raw_starts, "right") - 1
        place = self.raw_starts - first[self.window]
        self.own = place < np.array([g[4] for g in group])[self.window]
        self.at = place + np.array([g[2] for g in group])[self.window]
        self.docs = np.array([g[0] for g in group], np.int64)
        self.langs = np.array([g[1] for g in group], object)
        self.seeds = np.array([lang_seed(g[1]) for g in group], np.uint64)
        # Words with one space after each.
        keep = kind == 0
        keep[raw_ends] = True
        spaced = data[keep].copy()
        lengths = raw_ends - self.raw_starts
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        spaced[self.ends] = 32
        self.text = spaced
        self.prefixes = Prefixes(spaced)

    def fingerprints(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the phrases from word ``first`` to word ``last``."""
        fps = self.prefixes.fingerprints(self.starts[first], self.ends[last])
        return mixed(fps + self.seeds[self.window[first]]) & self.kept

    def of(self, order: int, sieve: Sieve | None) -> tuple[np.ndarray, np.ndarray]:
        """First words and fingerprints of the n-grams of ``order`` whose parts
        pass the sieve of the order below."""
        first = np.arange(max(0, len(self.starts) - order + 1))
        last = first + order - 1
        good = (self.piece[first] == self.piece[last]) & self.own[first]
        if sieve is not None:
            below = np.arange(max(0, len(self.starts) - order + 2))
            may = sieve.passes(self.fingerprints(below, below + order - 2)) if len(below) else np.zeros(0, bool)
            good &= may[:-1] & may[1:]
        first = first[good]
        return first, self.fingerprints(first, first + order - 1)


def grams(rows: Iterator[pa.RecordBatch], follow: int, how: Settings) -> Iterator[Grams]:
    """``rows``: batches of (doc, lang, text)."""

    def texts() -> Iterator[tuple[int, str, bytes]]:
        for batch in rows:
            for doc, lang, text in zip(*batch.columns):
                if text.is_valid:
                    yield doc.as_py(), lang.as_py(), text.as_py().encode().lower()

    return (Grams(group, how.kept) for group in windows(texts(), follow, how.window))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, lang, text): doc is a hash of language and text, so it names a text
    and not a row."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    return docs.select(F.xxhash64(lang, "text").alias("doc"), lang.alias("lang"), "text").where("text <> ''")


def counted(rows: DataFrame, order: int, sieve: np.ndarray | None, how: Settings = Settings()) -> DataFrame:
    """(fp, n, doc, at, least, most): number, one pointer, and least and largest
    check of each fingerprint of ``order``-grams of ``rows`` (doc, lang, text)."""
    bits = None if sieve is None else rows.sparkSession.sparkContext.broadcast(sieve)    # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        total = 0

        def send() -> pa.RecordBatch:
            fps, docs, where = (np.concatenate(x) for x in zip(*held))
            held.clear()
            by = np.argsort(fps)
            fps, where = fps[by], where[by]
            check = where & 0x7FFFFFFF
            new = np.flatnonzero(np.concatenate(([True], (fps[1:] != fps[:-1]) | (check[1:] != check[:-1]))))
            n = np.diff(np.append(new, len(fps)))
            return pa.RecordBatch.from_arrays([pa.array(fps[new].view(np.int64)), pa.array(n), pa.array(docs[by[new]]), pa.array(where[new])],
                                              names=["fp", "n", "doc", "place"])

        some = Sieve(bits.value) if bits is not None else None
        for g in grams(batches, order - 1, how):
            first, fps = g.of(order, some)
            if not len(first):
                continue
            checks = g.prefixes.checks(g.starts[first], g.ends[first + order - 1]).astype(np.int64)
            held.append((fps, g.docs[g.window[first]], g.at[first] << 31 | checks))
            total += len(fps)
            if total >= how.held:
                yield send()
                total = 0
        if held:
            yield send()

    sent = rows.mapInArrow(run, "fp bigint, n bigint, doc bigint, place bigint")
    check = F.col("place").bitwiseAND(F.lit(0x7FFFFFFF))
    # A task has counted its own, so rows go to the shuffle as they are: dealt first, Spark adds up behind it only.
    return sent.repartition("fp").groupBy("fp").agg(
        F.sum("n").alias("n"), F.min(F.struct("doc", "place")).alias("first"), F.min(check).alias("least"), F.max(check).alias("most")).select(
        "fp", "n", F.col("first.doc").alias("doc"), F.shiftright("first.place", 31).alias("at"), "least", "most")


def materialised(rows: DataFrame, frequent: DataFrame, how: Settings = Settings()) -> DataFrame:
    """(lang, phrase, size, n) of ``frequent`` (fp, size, n, doc, at), read from
    the texts of ``rows``.  A text that many rows share is read once a task."""
    pointers = frequent.groupBy("doc").agg(F.collect_list(F.struct("fp", "size", "n", "at")).alias("wanted"))    # at most as many as the text has n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, str] | None = None
        for batch in batches:
            out: list[tuple[int, str, str, int, int]] = []
            for doc, lang, text, wanted in zip(*batch.columns):
                now = doc.as_py(), lang.as_py()
                if now == last:
                    continue
                last = now
                data = text.as_py().encode().lower()
                for p in wanted.as_py():
                    phrase = phrase_at(data, p["at"], p["size"])
                    if phrase is not None and fingerprint(phrase, now[1], how.kept) == p["fp"]:
                        out.append((p["fp"], now[1], phrase.decode(), p["size"], p["n"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, SCHEMA.types)], names=SCHEMA.names)

    found = rows.join(pointers, "doc").select("doc", "lang", "text", "wanted").mapInArrow(run, "fp bigint, lang string, phrase string, size int, n bigint")
    return found.groupBy("fp", "size").agg(F.min(F.struct("lang", "phrase", "n")).alias("x")).select("x.lang", "x.phrase", "size", "x.n")


SCHEMA = pa.schema([("fp", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("n", pa.int64())])


def phrase_at(data: bytes, at: int, size: int) -> bytes | None:
    """``size`` words from byte ``at`` on, joined by spaces; None if there are none."""
    found = re.compile(rb"%s(?:[\x20\x09]+%s){%d}" % (WORD, WORD, size - 1)).match(data, at)
    return b" ".join(re.findall(WORD, found[0])) if found else None


def fingerprint(phrase: bytes, lang: str, kept: int) -> int:
    """Of one phrase, as a signed bigint."""
    symbols = np.frombuffer(phrase, np.uint8)
    fp = Prefixes(symbols).fingerprints(np.array([0]), np.array([len(symbols)])) + np.uint64(lang_seed(lang))
    return int((mixed(fp) & np.uint64(kept)).view(np.int64)[0])


def recounted(rows: DataFrame, collided: DataFrame, how: Settings = Settings()) -> DataFrame:
    """(lang, phrase, size, n) of all phrases whose fingerprints are in
    ``collided`` (fp, size), counted by their text."""
    bits = {size: rows.sparkSession.sparkContext.broadcast(sieve_of(collided.where(F.col("size") == size)))
            for size in sorted(r["size"] for r in collided.select("size").distinct().collect())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grams(batches, max(bits) - 1, how):
            for size, held in bits.items():
                first, fps = g.of(size, None)
                hit = Sieve(held.value).passes(fps)
                first, fps = first[hit], fps[hit]
                phrase = [g.text[a:b].tobytes().decode() for a, b in zip(g.starts[first], g.ends[first + size - 1])]
                lang = g.langs[g.window[first]]
                yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(lang, pa.string()), pa.array(phrase, pa.string()),
                                                  pa.array(np.full(len(first), size), pa.int32()), pa.array(np.ones(len(first), np.int64))], names=SCHEMA.names)

    every = rows.mapInArrow(run, "fp bigint, lang string, phrase string, size int, n bigint")
    by_text = every.groupBy("fp", "lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return by_text.join(collided, ["fp", "size"], "left_semi").select("lang", "phrase", "size", "n")


def frequent_phrases(rows: DataFrame, max_words: int, min_count: int, how: Settings = Settings()) -> DataFrame:
    """(lang, phrase, size, n): all phrases of up to ``max_words`` words that
    occur ``min_count`` times or more in a language of ``rows`` (doc, lang, text)."""
    levels, sieve = [], None
    for size in range(1, max_words + 1):
        level = stored(counted(rows, size, sieve, how).where(F.col("n") >= min_count), "grams")
        levels.append(level.withColumn("size", F.lit(size)))
        sieve = sieve_of(level) if size < max_words else None
    every = levels[0]
    for level in levels[1:]:
        every = every.unionAll(level)
    sound = every.where(F.col("least") == F.col("most"))
    phrases = stored(materialised(rows, sound, how), "phrases")
    if phrases.count() != sound.count():
        raise RuntimeError("a pointer leads to another text: the documents have changed while they were read")
    collided = every.where(F.col("least") != F.col("most")).select("fp", "size")
    if collided.limit(1).count():
        phrases = phrases.unionAll(recounted(rows, collided, how).where(F.col("n") >= min_count))
    return phrases


def word_totals(rows: DataFrame) -> DataFrame:
    """(lang, total): number of words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for batch in batches:
            counts: dict[str, int] = {}
            for lang, text in zip(batch.column(0), batch.column(1)):
                counts[lang.as_py()] = counts.get(lang.as_py(), 0) + len(word.findall(text.as_py().encode()))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "total"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, total bigint").groupBy("lang").agg(F.sum("total").alias("total"))


def slice_of(words: Column, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of the phrases of two words or more
    of ``phrases`` (lang, phrase, size, n): their lowest-scoring cut."""
    part = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    words = F.split("phrase", " ")
    cuts = phrases.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "*", slice_of(words, F.lit(1), F.col("k")).alias("left"), slice_of(words, F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    with_l = cuts.join(part.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    with_r = with_l.join(part.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])

    def wide(c: str) -> str:
        return f"CAST({c} AS DECIMAL(15, 0))"

    score = F.expr(f"CAST(1000000 * ({wide('a')} * {wide('a')}) AS DECIMAL(38, 0)) DIV ({wide('l')} * {wide('r')})")
    least = with_r.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "size")).alias("x"))
    return least.select("lang", "phrase", "x.size", "x.a", "x.l", "x.r", "x.score")


def not_absorbed(candidates: DataFrame, max_words: int, percent: int) -> DataFrame:
    """``candidates`` without those whose words lie inside a longer one with at
    least ``percent`` of their occurrences."""
    words = F.split("phrase", " ")
    inside = [slice_of(words, F.lit(first), F.lit(size)) for size in range(2, max_words) for first in range(1, max_words)]
    sizes = [(first, size) for size in range(2, max_words) for first in range(1, max_words)]
    if not inside:
        return candidates
    parts = F.array(*[F.when((F.lit(first + size - 1) <= F.col("size")) & (F.lit(size) < F.col("size")), part) for part, (first, size) in zip(inside, sizes)])
    longest = (candidates.where("size > 2").select("lang", "a", F.explode(F.array_distinct(F.array_compact(parts))).alias("phrase"))
               .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    return candidates.join(longest, ["lang", "phrase"], "left").where(F.isnull("longer") | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def first_of_each(phrases: DataFrame, top: int) -> DataFrame:
    """Rank of the best ``top`` of each language.  Salted groups choose theirs
    first, so no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salts = int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, absorb_percent: int = 50, top: int = 2000,
                 how: Settings = Settings()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each
    language of ``docs`` (lang, text)."""
    rows = keyed(docs)
    phrases = stored(frequent_phrases(rows, max_words, min_count, how), "phrases")
    candidates = stored(scored(phrases), "candidates")
    best = first_of_each(not_absorbed(candidates, max_words, absorb_percent), top)
    totals = word_totals(rows)
    return best.join(F.broadcast(totals), "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT unnest([1, 2, 3]) AS size),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM words, sizes WHERE len(w) >= size),
f AS (SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
cuts AS (SELECT lang, phrase, size, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
         FROM cand, (SELECT unnest([1, 2]) AS k) WHERE k < size),
scored AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.k, fl.n AS l, fr.n AS r,
         ((1000000::HUGEINT * c.a * c.a) // (fl.n::HUGEINT * fr.n))::BIGINT AS score
  FROM cuts c JOIN f fl ON fl.lang = c.lang AND fl.phrase = c.lp JOIN f fr ON fr.lang = c.lang AND fr.phrase = c.rp),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, part, max(a) AS longer FROM (
  SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM cand WHERE size = 3) GROUP BY ALL),
kept AS (SELECT least.* FROM least LEFT JOIN inside ON inside.lang = least.lang AND inside.part = least.phrase
         WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, totals.n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""
