"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can end that prefix's BPE
encoding.  ``Prefixes`` stores this last token per prefix: the encoding of any
prefix is read by walking back over the last tokens, an append extends the
table without touching what is there, and an edit recomputes only from the
first changed byte on, stopping where the new table meets the old one again.

A candidate token t (a suffix of the prefix) is the valid one if it is
compatible with the last token p of what remains: BPE on the bytes of p and t
gives exactly [p, t].  That is decided by undoing the merges at the border,
highest rank first (the published compatibility test for BPE prefixes), with
no merge run over the text.

Edge cases: a null text is the empty text; the empty text has no tokens and
decodes to no bytes; repeated rows are encoded each; other columns of the
input are not read, so names may clash; empty tables give empty results.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: White space as the Unicode property White_Space lists it.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                          0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Texts of these characters only are split alike by the standard library's
#: faster ``re`` and by Unicode categories.
PLAIN = re.compile(r"[\x00-\x1b\x20-\x7f\u00c0-\u017f\u2010-\u2027]*\Z")
#: Pre-tokens that a worker remembers (twice, in two generations), the longest
#: one remembered, and the borders between tokens it remembers.
CACHE_WORDS, CACHE_CHARS, BORDERS = 250_000, 64, 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """A rank table with what the border test needs."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = [0] * 256      # longest token by its last byte
        for b in ranks:
            self.longest[b[-1]] = max(self.longest[b[-1]], len(b))
        self._split: dict[int, tuple[int, int] | None] = {}
        self.fits = Borders(self)

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for one byte."""
        if token not in self._split:
            parts = [bytes([x]) for x in self.bytes_of[token]]
            while len(parts) > 2:
                _, at = min((self.ranks.get(a + b, token), i)
                            for i, (a, b) in enumerate(zip(parts, parts[1:])))
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self._split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._split[token]


class Borders(dict):
    """(left, right) to whether BPE leaves the two tokens apart when they meet."""

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.merges = merges

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) > BORDERS:
            self.clear()
        self[pair] = apart = self._apart(*pair)
        return apart

    def _apart(self, a: int, b: int) -> bool:
        # ``before``: the border may be crossed only by a merge that runs
        # earlier than the last one undone.  On equal rank the left one ran first.
        m = self.merges
        before = len(m.ranks) + 1
        while True:
            made = m.ranks.get(m.bytes_of[a] + m.bytes_of[b])
            if made is not None and made < before:
                return False
            sa, sb = m.split(a), m.split(b)
            if sa is None and sb is None:
                return True
            if sb is None or (sa is not None and a > b):
                before, a = a, sa[1]
            else:
                before, b = b + 1, sb[0]


class Prefixes:
    """Last token of every prefix of a growing byte string."""

    def __init__(self, merges: Merges, data: bytes = b"") -> None:
        self.merges, self.data, self.last = merges, b"", []
        self.append(data)

    def _grow(self, ends: Iterable[int]) -> None:
        """Find the last tokens of the prefixes of ``ends`` bytes, the next ones
        in order.  Mostly a last token goes on where the one of the prefix before
        began; else suffixes are tried from the shortest on (only one can be
        valid)."""
        data, last, m = self.data, self.last, self.merges
        get, fits, longest, bytes_of = m.ranks.get, m.fits, m.longest, m.bytes_of
        for end in ends:
            begin = end - 1 - len(bytes_of[last[-1]]) if last else 0
            token = get(data[begin:end])
            if token is None or (begin and not fits[last[begin - 1], token]):
                for begin in range(end - 1, max(-1, end - 1 - longest[data[end - 1]]), -1):
                    token = get(data[begin:end])
                    if token is not None and (not begin or fits[last[begin - 1], token]):
                        break
                else:
                    raise ValueError("the ranks lack a token of one byte")
            last.append(token)

    def append(self, more: bytes) -> None:
        self.data += more
        self._grow(range(len(self.last) + 1, len(self.data) + 1))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace bytes ``start:stop`` and return how many last tokens were
        worked out anew.  A last token depends on the bytes and last tokens
        of at most the longest token before it, so after that many equal
        last tokens in a row the old table holds again."""
        tail = self.last[stop:]
        self.data = self.data[:start] + new + self.data[stop:]
        del self.last[start:]
        done, same, window = 0, 0, max(self.merges.longest)
        for end in range(start + 1, len(self.data) + 1):
            self._grow((end,))
            done += 1
            old = end - 1 - start - len(new)
            same = same + 1 if old >= 0 and tail[old] == self.last[-1] else 0
            if same >= window:
                self.last += tail[old + 1:]
                break
        return done

    def tokens(self, end: int | None = None) -> list[int]:
        """Encoding of the prefix of ``end`` bytes (default: all)."""
        end = len(self.data) if end is None else end
        out = []
        while end:
            out.append(self.last[end - 1])
            end -= len(self.merges.bytes_of[out[-1]])
        return out[::-1]


class ByteBPE:
    """Encode texts piece by piece as the pattern cuts them; decode ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.merges = Merges(ranks)
        self._known = Known(self.merges)
        self._token_bytes = None
        strict = pattern.replace(r"[^\s", rf"[^{WHITE}").replace(r"\S", rf"[^{WHITE}]").replace(r"\s", rf"[{WHITE}]")
        self._any = regex.compile(strict).findall
        fast = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self._plain = None if r"\p" in fast else re.compile(fast).findall

    def pieces(self, text: str) -> list[str]:
        plain = self._plain is not None and PLAIN.match(text)
        return self._plain(text) if plain else self._any(text)

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        return b"".join(map(self._known.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.merges.bytes_of.__getitem__, ids))

    def decode_lists(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids (null: none)."""
        if self._token_bytes is None:
            self._token_bytes = pa.array([self.merges.bytes_of.get(i) for i in range(max(self.merges.bytes_of) + 1)], pa.binary())
        tokens = self._token_bytes.take(ids.flatten())
        ends = np.append(0, np.cumsum(np.nan_to_num(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)))
        _, offsets, data = tokens.buffers()
        starts = np.frombuffer(offsets, np.int32)[tokens.offset + ends] if len(tokens) else np.zeros(len(ids) + 1, np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(starts.astype(np.int32)), data or pa.py_buffer(b"")])


class Known(dict):
    """Pre-token to its ids, worked out when first met.  Two generations: when
    the young one is full it becomes the old one, so frequent ones stay."""

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.merges, self.old = merges, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", Prefixes(self.merges, piece.encode()).tokens()).tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> ByteBPE:
    """One codec for each Python worker and vocabulary."""
    return ByteBPE(load_ranks(path), pattern)


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                        T.StructField("decoded", T.BinaryType())])


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row of ``docs`` (doc_id, text): the
    token ids of the whole text and the bytes that the ids decode to.

    Row-local: no shuffle; a worker keeps the vocabulary and a bounded cache
    of pre-tokens, a retry computes the same rows again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                packed = [bpe.packed(t.as_py() or "") for t in some.column(1)]
                ends = np.append(0, np.cumsum([len(x) // 4 for x in packed])).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(0), ids, bpe.decode_lists(ids)], names=ENCODED.names)

    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(run, ENCODED)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded) of stored ids (doc_id, ids); null ids are none."""
    schema = T.StructType([ENCODED["doc_id"], ENCODED["decoded"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), bpe.decode_lists(batch.column(1))], names=schema.names)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)
