"""Operators 3, 5 and 10 against the tokenizer libraries."""

from __future__ import annotations

import glob
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from returnlens.llm import bpe, queries, tokencounts, tokenfiles

from ..conftest import SF_SMALL
from .helpers import AWKWARD, docs_of

RANKS = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")


def test_bpe_ids_equal_the_library_and_round_trip(spark, small):
    for df in (small, docs_of(spark, AWKWARD)):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        got = bpe.encode_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
        assert len(got) == len(texts)
        for r in got:
            assert list(r.ids) == REFERENCE.encode_ordinary(texts[r.doc_id]), texts[r.doc_id][:80]
            assert bytes(r.decoded) == texts[r.doc_id].encode()


def test_bpe_other_vocabulary_and_random_bytes():
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    ref = tiktoken.Encoding("multi", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.ByteBPE(ranks, P.PATTERN)
    rng = random.Random(3)
    for n in (1, 2, 5, 20, 200):
        for _ in range(60):
            text = "".join(rng.choice("abethions ’éß日本🙂\n\t 12'_-") for _ in range(n))
            assert own.encode(text) == ref.encode_ordinary(text), text


def test_prefixes_append_and_edit_are_exact():
    merges, rng = bpe.Merges(RANKS), random.Random(5)
    for _ in range(120):
        data = bytearray("".join(rng.choice("theandison ing") for _ in range(rng.randrange(0, 400))).encode())
        table = bpe.Prefixes(merges, bytes(data))
        more = "".join(rng.choice("ther") for _ in range(9)).encode()
        table.append(more)
        data += more
        assert table.last == bpe.Prefixes(merges, bytes(data)).last
        a = rng.randrange(0, len(data) + 1)
        b = rng.randrange(a, min(len(data), a + 6) + 1)
        new = "".join(rng.choice("thein") for _ in range(rng.randrange(0, 6))).encode()
        data[a:b] = new
        table.edit(a, b, new)
        assert bytes(table.data) == bytes(data) and table.last == bpe.Prefixes(merges, bytes(data)).last
        assert b"".join(merges.bytes_of[t] for t in table.tokens()) == bytes(data)


def test_edit_recomputes_only_near_the_edit():
    merges = bpe.Merges(RANKS)
    table = bpe.Prefixes(merges, b"the quick brown fox " * 500)
    assert table.edit(100, 101, b"X") < 1000


def test_bpe_empty_table(spark):
    assert bpe.encode_documents(docs_of(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_op10_digests(spark, small):
    texts = {r.doc_id: r.text for r in small.collect()}
    for r in queries.op10_byte_bpe(spark, SF_SMALL).collect():
        ids = REFERENCE.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_token_counts_equal_the_library(spark, small):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for df in (small, docs_of(spark, AWKWARD)):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        for words in (0, 50, 16_384):
            got = tokencounts.count_tokens(df, P.path("word_bpe_49k.json"), limit=100, table_words=max(words, 1)).collect()
            assert len(got) == len(texts)
            for r in got:
                n = len(lib.encode(texts[r.doc_id], add_special_tokens=False).ids)
                assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 100)
    assert tokencounts.count_tokens(docs_of(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_frequent_table_is_a_bounded_summary(spark, monkeypatch):
    from collections import Counter
    seen = Counter({"a": 50, "b": 20, "c": 1, "d": 1})
    assert set(tokencounts._trim(seen)) == {"a"} or set(tokencounts._trim(seen)) == {"a", "b"}
    df = docs_of(spark, ["the cat the dog"] * 10 + ["the sun"] * 5)
    top = tokencounts.frequent_pretokens(df, P.path("word_bpe_49k.json"), 2).collect()
    assert [(r.word, r.n) for r in top] == [("the", 25), ("cat", 10)]


def _expected_files(texts):
    lib, start, out = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0, {}
    for doc in sorted(texts):
        ids = lib.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        out[doc] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_op5_reads_back_what_the_library_gives(spark, small):
    want = _expected_files({r.doc_id: r.text for r in small.collect()})
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op5_token_files(spark, SF_SMALL).collect()}
    assert got == want


def test_token_files_awkward_texts_layout_and_selective_reads(spark, tmp_path):
    df = docs_of(spark, AWKWARD)
    out = tokenfiles.write_token_files(df, P.path("byte_bpe_50k.json"), P.PATTERN, out=str(tmp_path / "t"))
    files = tokenfiles.read_token_files(spark, out)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.placed(tokenfiles.checksums(files)).collect()}
    assert got == _expected_files(dict(enumerate(AWKWARD)))
    part = sorted(glob.glob(os.path.join(out, "*.parquet")), key=os.path.getsize)[-1]
    group = pq.ParquetFile(part).metadata.row_group(0)
    columns = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
    assert any("DICTIONARY" in e for e in columns["ids"].encodings)
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    plan = files.where("doc_id BETWEEN 3 AND 5").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "GreaterThanOrEqual(doc_id,3)" in plan


def test_token_files_empty_table_and_repeats(spark, tmp_path):
    out = tokenfiles.write_token_files(docs_of(spark, []), P.path("byte_bpe_50k.json"), P.PATTERN, out=str(tmp_path / "e"))
    assert tokenfiles.placed(tokenfiles.read_token_files(spark, out)).count() == 0
    df = spark.createDataFrame([(5, "b"), (5, "b"), (None, "n"), (1, None)], "doc_id bigint, text string")
    out = tokenfiles.write_token_files(df, P.path("byte_bpe_50k.json"), P.PATTERN, out=str(tmp_path / "r"))
    got = sorted((r.start, -1 if r.doc_id is None else r.doc_id) for r in
                 tokenfiles.placed(tokenfiles.read_token_files(spark, out)).collect())
    assert got == [(0, -1), (2, 1), (3, 5), (5, 5)]


def test_other_alphabets_are_looked_up_and_counted_as_the_library_does(spark):
    pre = tokencounts.pretokens(P.path("word_bpe_49k.json"))
    plain = [c for i in range(0x20000) if not 0xd800 <= i < 0xe000 and tokencounts.PLAIN.match(c := chr(i))]
    texts = [f"a{c}b1{c}2 {c}{c}!{c}'s" for c in plain]
    rng = random.Random(7)
    texts += ["".join(rng.choices(plain, k=40)) + " é" for _ in range(5_000)]
    said = ["Привет, «мир» № 5!", "καλημέρα κόσμε", "שלום עולם", "مرحبا بالعالم", "日本語、テスト。한국어 中文", "a\u00a0b 20 €", "🙂" * 64]
    cut = [pre.words(t) for t in texts + said]
    assert None not in cut and len(plain) > 40_000
    known = dict(zip(words := sorted({w for c in cut for w in c}), pre.lengths(words)))
    assert [sum(known[w] for w in c) for c in cut] == pre.lengths(texts + said)
    got = tokencounts.count_tokens(docs_of(spark, said * 3), P.path("word_bpe_49k.json"))
    assert {r.doc_id: r.n_tokens for r in got.collect()} == dict(enumerate(pre.lengths(said) * 3))
    assert {r.word for r in tokencounts.frequent_pretokens(docs_of(spark, said), P.path("word_bpe_49k.json")).collect()} >= {"привет", "κόσμε", "€"}
