"""Token counts by a map-side two-tier lookup of pre-token lengths.

Tier one is a compact table of frequent pre-tokens and their token counts,
found over all documents and broadcast (its size is bounded by ``table_words``
entries of at most ``WORD_CHARS`` characters).  Tier two is a cache in each
Python worker: misses of a piece of text are encoded in one call of the
tokenizer library and remembered.  No pre-token is ever shuffled: each task
sends only a bounded summary of its frequent pre-tokens.

Texts are cut as the tokenizer's own normalizer and splitter do.  A text with
characters outside ``PLAIN`` (most alphabets, Chinese, Japanese, Korean, symbols;
no combining marks), or with a special token's string, is encoded as a whole by
the library, so special strings, composed characters and rare white space are
handled as its defaults do.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are
counted each; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_of

#: Characters that NFC leaves alone beside any other of them, that lower-case one
#: by one and that Python and the tokenizer library hold for the same kind (letter,
#: number, white space, other): Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic,
#: Devanagari, Thai, Georgian; punctuation and symbols; Chinese, Japanese, Korean;
#: emoji.  Combining marks, capital sigma and numbers that aren't digits are out.
PLAIN = re.compile(
    r"[\t-\r\x20-\x7f\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f"
    r"\u0370-\u0373\u0375-\u037d\u037f-\u0386\u0388-\u03a2\u03a4-\u03ff\u0400-\u0482\u0488-\u052f\u0531-\u058f"
    r"\u05d0-\u05ea\u060c-\u060f\u061b-\u064a\u0660-\u066f\u0671-\u06d5\u06ee-\u06ff"
    r"\u0904-\u093b\u093d-\u094c\u094e-\u0950\u0955-\u0957\u0960-\u097f\u0e01-\u0e37\u0e3b-\u0e47\u0e4c-\u0e5b\u10d0-\u10ff\u1e00-\u1eff"
    r"\u2002-\u206f\u20a0-\u20bf\u2100-\u2125\u2127-\u2129\u212c-\u214f\u2190-\u2328\u232b-\u23ff\u2500-\u2775\u2794-\u27bf"
    r"\u3000-\u3006\u3008-\u3020\u3030-\u3037\u303b-\u3098\u309b-\u30ff\u3400-\u4db5\u4e00-\u9fa5\uac00-\ud7a3"
    r"\ufe0e\ufe0f\uff01-\uff9f\U0001f300-\U0001f6ff\U0001f900-\U0001f9ff]*\Z")
WORD_CHARS = 64
#: Pre-tokens that a task keeps while it counts, and that it reports.
SUMMARY_WORDS, REPORTED = 60_000, 2_048
CACHE_WORDS = 250_000


class PreTokens:
    """The pre-tokens of a text, and how many tokens each gives."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [x["pattern"]["Regex"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        #: Only a lower-casing tokenizer with one splitting pattern is cut here; others go through the library.
        self.cuts = kinds == ["NFC", "Replace", "Lowercase"] and len(splits) == 1
        if self.cuts:
            pattern = splits[0].replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"[\p{L}]", r"[^\W\d_]").replace(r"[\p{N}]", r"\d")
            self.cuts = r"\p" not in pattern
            self._find = re.compile(pattern).findall if self.cuts else None
        special = [re.escape(x["content"]) for x in spec["added_tokens"]]
        self._special = re.compile("|".join(special)) if special else None

    def words(self, text: str) -> list[str] | None:
        """Pre-tokens, or None where only the library cuts exactly."""
        if not self.cuts or not PLAIN.match(text) or (self._special and self._special.search(text)):
            return None
        return self._find(text.lower())

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=4)
def pretokens(path: str) -> PreTokens:
    return PreTokens(path)


def _trim(seen: Counter) -> Counter:
    """A frequent-items summary: take off the median count and what falls to
    0, so a pre-token whose share is over the reciprocal size survives."""
    cut = sorted(seen.values())[len(seen) // 2]
    return Counter({w: n - cut for w, n in seen.items() if n > cut})


def frequent_pretokens(docs: DataFrame, path: str, table_words: int = 16_384) -> DataFrame:
    """(word, n): the most frequent pre-tokens over all documents, from one
    bounded summary for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, seen = pretokens(path), Counter()
        for batch in batches:
            for _, texts in rows_of(batch, 0):
                seen.update(w for w in chain.from_iterable(pre.words(t) or () for t in texts) if len(w) <= WORD_CHARS)
                while len(seen) > SUMMARY_WORDS:
                    seen = _trim(seen)
        top = seen.most_common(REPORTED)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
                                         names=["word", "n"])

    return (docs.select("text").mapInArrow(run, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "word").limit(table_words))


class CompactTable:
    """Frequent pre-tokens and their lengths as two flat buffers."""

    def __init__(self, words: list[str], lengths: list[int]) -> None:
        self.words = "\n".join(words).encode()
        self.lengths = np.array(lengths, np.uint16).tobytes()       # up to 4 a character

    def unpacked(self) -> dict[str, int]:
        return dict(zip(self.words.decode().split("\n"), np.frombuffer(self.lengths, np.uint16).tolist())) if self.lengths else {}


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, table_words: int = 16_384) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row (doc_id, text)."""
    spark = docs.sparkSession
    words = [r.word for r in frequent_pretokens(docs, path, table_words).collect()]     # at most table_words rows
    table = spark.sparkContext.broadcast(CompactTable(words, pretokens(path).lengths(words) if words else []))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, frequent = pretokens(path), table.value.unpacked()
        known = dict(frequent)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for _, texts in rows_of(batch, 1):
                cut = [pre.words(t) for t in texts]
                if len(known) > CACHE_WORDS:
                    known = dict(frequent)
                missing = list(set(chain.from_iterable(w or () for w in cut)).difference(known))
                found = dict(zip(missing, pre.lengths(missing))) if missing else {}
                long = {w: n for w, n in found.items() if len(w) > WORD_CHARS}
                known.update(found)
                n_tokens += [sum(map(known.__getitem__, w)) if w is not None else pre.lengths([t])[0]
                             for w, t in zip(cut, texts)]
                for w in long:
                    del known[w]
                n_bytes += [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                                             names=schema.names)

    counted = docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
