"""URL filters: rules first, then word segmentation and naive Bayes.

1. Host and path are cut from the URL; the longest rule whose host is the URL's
   host or a parent of it, and whose path starts the URL's path, decides.
2. Other URLs: host labels and path pieces are segmented into words by Viterbi
   under a unigram model (words of page titles, paths and hyphenated hosts over all
   pages; the labels of distinct hosts, cut and counted again in a few rounds; an
   unknown word's chance falls tenfold a letter).  Percent escapes are decoded.
3. Multinomial naive Bayes scores the words of host and path.  Its classes are
   taught by seed words: a URL whose host has one is blocked, all others allowed;
   the word counts of both classes run over all pages, and every word is scored
   by its counts.

Counts are pre-aggregated Spark jobs; what tasks get is the ``max_words`` most
frequent words of each model, a stated bound.  The class counts of all other
words are stored and joined with the rows that hold them.  Segmentation is
row-local with a bounded cache, so a host with a third of all pages is cut once
a worker.

Edge cases: a null URL, or one without ``://``, has an empty host and path, no
rule and the class of the larger prior; repeated rows are judged each; pages
without title only lack its words; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import stored

#: Words of hosts that teach what to block: gambling, drugs, adult, advertising, scams.
SEEDS = ["adult", "ads", "adserver", "bet", "bets", "betting", "casino", "porn", "sex", "xxx", "poker", "pills", "pharma",
         "viagra", "spam", "loans", "lottery", "jackpot", "warez", "malware", "phishing", "scam"]
LETTERS = re.compile(r"[a-z]+|[0-9]+")
LONGEST = 24
#: Share of all words that a seed word has at least, so that segmentation knows
#: it however many pages there are: it is not cut into two words, such as se and
#: x, whose shares have a smaller product.
SEED_SHARE = 1e-4


def parsed(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    cut = r"(?s)^.*?://([^/?#]*)([^?#]*)"

    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract("url", cut, i), F.lit(""))

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return pages.withColumns({"host": F.translate(part(1), upper, upper.lower()), "path": part(2)})


def by_rule(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule, a string like ``example.com/en/``,
    that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):        # the last one tried is the longest
        host, slash, rest = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _first(top: DataFrame) -> list[Row]:
    """The rows of an ordered limit.  Stored first: collected as it is, each
    partition would send as many rows to the driver as all are to have."""
    return stored(top, "url-top").collect()


class Unigrams:
    """Word segmentation under a unigram model."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.total = max(1, sum(counts.values()))
        self.log = {w: math.log(n / self.total) for w, n in counts.items()}
        self.cut = lru_cache(100_000)(self._cut)

    def chance(self, word: str) -> float:
        known = self.log.get(word)
        return known if known is not None else math.log(10 / self.total) - len(word) * math.log(10)

    def _cut(self, text: str) -> tuple[str, ...]:
        """The likeliest words of a run of letters; equal chances: fewer words."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            best.append(max((best[start][0] + self.chance(text[start:end]), start) if start else (self.chance(text[:end]), 0)
                            for start in range(max(0, end - LONGEST), end)))
        words, end = [], len(text)
        while end:
            start = best[end][1]
            words.append(text[start:end])
            end = start
        return tuple(reversed(words))

    def words(self, text: str) -> list[str]:
        out = []
        for run in LETTERS.findall(text):
            out += ["0"] if run[0].isdigit() else self.cut(run) if len(run) <= 256 else \
                [w for i in range(0, len(run), 256) for w in self.cut(run[i:i + 256])]
        return out

    def tokens(self, host: str, path: str) -> list[str]:
        return [f"h:{w}" for w in self.words(host)] + [f"p:{w}" for w in self.words(unquote(path).lower())]


def with_seeds(counts: dict[str, int], seeds: list[str]) -> dict[str, int]:
    """``counts``, with at least ``SEED_SHARE`` of them for each seed word."""
    least = math.ceil(SEED_SHARE * max(1, sum(counts.values())))
    return counts | {s: max(counts.get(s, 0), least) for s in seeds}


def unigrams(pages: DataFrame, seeds: list[str], max_words: int, rounds: int = 2) -> Unigrams:
    """Model from the titles and URLs of ``pages`` (url, html).  Titles, paths and
    what hyphens have cut in hosts are words.  A run of letters in a host may be
    several: first it counts as one word for each further host that has it; then
    ``rounds`` times all distinct runs are cut by the model so far, and their
    words, counted once a host, make the next one."""
    parts = parsed(pages)
    hyphened = F.array_join(F.regexp_extract_all("host", F.lit("(?<=-)[a-z]+|[a-z]+(?=-)|[a-z]+$"), F.lit(0)), " ")
    title = F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)", 1)
    text = F.concat_ws(" ", hyphened, "path", F.coalesce(title, F.lit("")))
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))
    base = stored(parts.select(words.alias("w")).where(F.length("w") <= LONGEST).groupBy("w").agg(F.count("*").alias("n")), "url-counts")
    runs = F.explode(F.regexp_extract_all("host", F.lit("(?<![a-z-])[a-z]+(?![a-z-])"), F.lit(0)))
    labels = stored(parts.select("host").distinct().select(runs.alias("w")).where(F.length("w") <= 256).groupBy("w").agg(F.count("*").alias("n")), "url-labels")

    def model(of_labels: DataFrame) -> Unigrams:
        every = base.unionAll(of_labels.where(F.length("w") <= LONGEST)).groupBy("w").agg(F.sum("n").alias("n")).where("n > 0")
        return Unigrams(with_seeds({r.w: r.n for r in _first(every.orderBy(F.desc("n"), "w").limit(max_words))}, seeds))

    found = model(labels.select("w", (F.col("n") - 1).alias("n")))
    for _ in range(rounds):
        found = model(cut_labels(labels, found))
    return found


def cut_labels(labels: DataFrame, model: Unigrams) -> DataFrame:
    """(w, n): the words of ``labels`` (w, n) under ``model``."""
    shipped = _Shipped(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(w, n) for label, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in shipped.unigrams().cut(label)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=["w", "n"])

    return labels.mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


class Bayes:
    """Multinomial naive Bayes with add-one smoothing; classes allow, block.
    It holds the counts of the most frequent words; those of others come with
    the row that is scored."""

    def __init__(self, counts: dict[str, tuple[int, int]], sums: tuple[int, int], n_words: int, docs: tuple[int, int]) -> None:
        bottom = [math.log(s + n_words + 1) for s in sums]
        prior = [math.log((d + 1) / (sum(docs) + 2)) for d in docs]
        #: Log odds of block over allow.
        self.prior = prior[1] - prior[0]
        self.unseen = bottom[0] - bottom[1]
        self.odds = {w: self.log_odds(a, b) for w, (a, b) in counts.items()}

    def log_odds(self, a: int, b: int) -> float:
        return math.log(b + 1) - math.log(a + 1) + self.unseen

    def score(self, tokens: list[str], rare: Iterable[dict] = ()) -> float:
        """``rare``: (w, a, b) of the tokens that the model doesn't hold."""
        others = {r["w"]: self.log_odds(r["a"], r["b"]) for r in rare}
        return self.prior + math.fsum(self.odds[t] if t in self.odds else others.get(t, self.unseen) for t in tokens)


def with_tokens(urls: DataFrame, model: Unigrams) -> DataFrame:
    """``urls`` (page_id, host, path) and their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model_.tokens(h.as_py(), p.as_py()) for h, p in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))],
                                             names=["page_id", "host", "path", "tokens"])

    model_ = _Shipped(model)
    return urls.selectExpr("CAST(page_id AS BIGINT) page_id", "host", "path").mapInArrow(
        run, "page_id bigint, host string, path string, tokens array<string>")


class _Shipped:
    """A unigram model that travels without its cache."""

    def __init__(self, model: Unigrams) -> None:
        self.log, self.total, self._model = model.log, model.total, None

    def __getstate__(self):
        return {"log": self.log, "total": self.total, "_model": None}

    def unigrams(self) -> Unigrams:
        if self._model is None:
            self._model = Unigrams({})
            self._model.log, self._model.total = self.log, self.total
        return self._model

    def tokens(self, host: str, path: str) -> list[str]:
        return self.unigrams().tokens(host, path)


def taught(tokens: DataFrame, seeds: list[str]) -> DataFrame:
    """``tokens`` and whether seed words of the host teach the row as block."""
    return tokens.withColumn("bad", F.arrays_overlap("tokens", F.lit([f"h:{s}" for s in seeds])).cast("int"))


def word_counts(tokens: DataFrame, seeds: list[str]) -> DataFrame:
    """(w, a, b): how often each word of (tokens) is in allow and in block."""
    return taught(tokens, seeds).select("bad", F.explode("tokens").alias("w")).groupBy("w").agg(
        F.count_if(F.col("bad") == 0).alias("a"), F.count_if(F.col("bad") == 1).alias("b"))


def most_frequent(counts: DataFrame, max_words: int) -> DataFrame:
    return counts.orderBy(F.desc(F.col("a") + F.col("b")), "w").limit(max_words)


def fit_bayes(tokens: DataFrame, seeds: list[str], max_words: int, counts: DataFrame | None = None) -> Bayes:
    """Model from (tokens) of all URLs, taught by the seed words of hosts;
    ``counts``: their ``word_counts``, where these are stored."""
    counts = word_counts(tokens, seeds) if counts is None else counts
    docs = taught(tokens, seeds).agg(F.count_if(F.col("bad") == 0), F.count_if(F.col("bad") == 1)).first()
    sums = counts.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0)), F.count("*")).first()
    top = _first(most_frequent(counts, max_words))
    return Bayes({r.w: (r.a, r.b) for r in top}, (sums[0], sums[1]), sums[2], (docs[0], docs[1]))


def rare_counts(rows: DataFrame, counts: DataFrame, max_words: int) -> DataFrame:
    """(row, rare): the counts of each row's words beyond the ``max_words`` most
    frequent.  Such a word is at most one in ``max_words`` of all tokens, so no
    key of the join is hot; the broadcast is ``max_words`` short rows."""
    words = rows.select("row", F.explode(F.array_distinct("tokens")).alias("w"))
    return (words.join(F.broadcast(most_frequent(counts, max_words).select("w")), "w", "left_anti").join(counts, "w")
            .groupBy("row").agg(F.collect_list(F.struct("w", "a", "b")).alias("rare")))


def judge(pages: DataFrame, rules: list[tuple[str, str]], seeds: list[str] = SEEDS, max_words: int = 50_000) -> DataFrame:
    """(page_id, host, path, rule, verdict, words, score) of each page
    (page_id, url, html).  ``score``: log odds of block over allow."""
    words = unigrams(pages, seeds, max_words)
    rows = stored(with_tokens(parsed(pages.select("page_id", "url")), words).withColumn("row", F.monotonically_increasing_id()), "url-tokens")
    counts = stored(word_counts(rows, seeds), "url-words")
    bayes = fit_bayes(rows, seeds, max_words, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, rare = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([" ".join(t[2:] for t in x) for x in tokens], pa.string()),
                 pa.array(np.array([bayes.score(x, r or ()) for x, r in zip(tokens, rare)], float))],
                names=["page_id", "host", "path", "words", "score"])

    scored = rows.join(rare_counts(rows, counts, max_words), "row", "left").select("page_id", "host", "path", "tokens", "rare").mapInArrow(
        run, "page_id bigint, host string, path string, words string, score double")
    rule, verdict = by_rule(rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "words", "score")
