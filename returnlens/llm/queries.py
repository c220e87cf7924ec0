"""The registered ``opN_*`` queries: thin calls of the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import bpe, chat, collocations, merkle, minhash, mixing, simhash, spelling, tokencounts, tokenfiles, topk, toxicity, urlfilter
from .common import documents, on_workers, stored


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_edits(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", ["doc_id", "toxic"]), sample_each=4_000)
    return toxicity.score(docs, model)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
    return urlfilter.judge(table(spark, sf_dir, "pages", ["page_id", "url", "html"]), rules)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfiles.write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                                          public_tokenizers.PATTERN, end_id=0)
    files = tokenfiles.read_token_files(spark, folder)
    place = tokenfiles.placed(tokenfiles.checksums(files))
    return place.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    return mixing.mix(docs, weights=[5, 2, 1], share=1.0, cap=3.0).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = stored(simhash.fingerprints(documents(spark, sf_dir), shingle=3), "fingerprints")
    classes = simhash.near_duplicates(fps, max_bits=3)
    return fps.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]).unionByName(extra)
    return chat.read_back(stored(chat.format_chats(turns), "chats"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                            public_tokenizers.PATTERN))


def bpe_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents", ["lang", "text"]), max_words=3, min_count=10, absorb_percent=50, top=2000)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), shingle=5, percent=85)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(documents(spark, sf_dir), least_length=5, least_count=3, damage_every=97)
    return spelling.spelling_variants(words, ratio=2)


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_url_filter": op4_url_filter,
    "op5_token_files": op5_token_files,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_chat": op8_chat,
    "op9_top_k": op9_top_k,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_collocations": op11_collocations,
    "op12_minhash": op12_minhash,
    "op13_spelling": op13_spelling,
}
QUERIES = {name: on_workers(query) for name, query in QUERIES.items()}

ORACLE: dict[str, str] = {
    "op1_fingerprints": merkle.FINGERPRINT_SQL,
    "op8_chat": chat.CHATS_SQL,
    "op9_top_k": topk.TOP_K_SQL,
    "op11_collocations": collocations.COLLOCATIONS_SQL,
    "op12_minhash": minhash.NEAR_DUPLICATES_SQL,
    "op13_spelling": spelling.VARIANTS_SQL,
}
