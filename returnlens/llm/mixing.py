"""Mixing sources to target weights by entropy balancing.

Targets: sources share the given part of all words by weight; no target is
above ``cap`` times its source's size, the excess goes to the others by weight.

Rates: among all document rates r in 0..cap that give each source its words,
entropy balancing takes those nearest to 1 in relative entropy,
r = min(cap, exp(lambda_source * size / mean size)).  The convex dual has one
lambda for each source; its gradient is words taken minus target.  Newton's
steps for all sources run together: each step is one aggregate over documents
counted by (source, size), kept inside a bracket that halves where a step
leaves it.

Copies: rates are rounded to whole copies in small blocks of a source's
documents (by a hash), from the largest to the smallest, carrying the words
owed; what is still owed then is made up by turning one or two documents.

A source's documents are never gathered: sums are pre-aggregated, blocks have
about ``BLOCK`` documents however large the source.  Runs repeat exactly.

Edge cases: a null or empty text has size 0 and stays once; a null source is
the last one; a source without words has target 0; repeated rows are separate
documents; an empty table gives no rows; other columns are not read (``mixed``
keeps them).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stored, unused

WORDS = r"[^\x20\x09-\x0D]+"
BLOCK = 1000
#: Relative miss of a target that ends Newton's steps, and their number.
MISS, STEPS = 1e-6, 60


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, key, source, hash, size): ``key`` is the source, never null."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("key"),
        "source", F.xxhash64("text", "source").alias("hash"),
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("bigint").alias("size"))


def exact_sum(x: Column) -> Column:
    """Sum of doubles in millionths, the same in whatever order rows come:
    reruns must agree to the last digit, since rates are rounded."""
    return F.sum(F.round(x, 6).cast("decimal(38,6)")).cast("double")


def targets(sizes: DataFrame, weights: list[float], share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """(key, source_size, n_docs, mean, target) of each source; ``weights``
    repeat over the sources in code point order, null last."""
    spark = sizes.sparkSession
    sources = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    schema = T.StructType([*sources.schema.fields, T.StructField("place", T.LongType())])
    ranked = sources.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    table = stored(spark.createDataFrame(ranked, schema).withColumn(
        "weight", F.get(F.lit([float(w) for w in weights]), (F.col("place") % len(weights)).cast("int"))), "sources")
    limit = F.col("source_size") * cap
    all_words = table.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    while level != before:              # words for each unit of weight; rises until no more source is capped
        before = level
        over = F.col("weight") * level > limit
        full, free = table.agg(exact_sum(F.when(over, limit).otherwise(0.0)), exact_sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if free:
            level = max(level, (share * all_words - full) / free)
    return table.select("key", "source_size", "n_docs", (F.col("source_size") / F.col("n_docs")).alias("mean"),
                        F.least(limit.cast("double"), F.col("weight") * level).alias("target"))


def rate(lam: Column, size: Column, mean: Column, cap: float) -> Column:
    return F.when(size == 0, 1.0).otherwise(F.least(F.lit(cap), F.exp(F.least(lam * size / mean, F.lit(math.log(cap))))))


def duals(sizes: DataFrame, goals: DataFrame, cap: float = 3.0) -> DataFrame:
    """``goals`` with each source's ``lam``."""
    cells = stored(sizes.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")), "cells")
    # At ``low`` even a document of one word, the least tilted, has a rate next
    # to 0; at ``high`` even that one is at the cap.
    top = F.col("mean") * (math.log(cap) + 1)
    state = goals.where("source_size > 0 AND target > 0").select(
        "key", "mean", "target", "source_size", F.lit(0.0).alias("lam"), (-F.col("mean") * 50).alias("low"), top.alias("high"),
        F.lit(False).alias("done"))
    state = stored(state.withColumns({"lam": F.when(F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), F.col("high")).otherwise(0.0),
                                      "done": F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)}), "duals")
    for _ in range(STEPS):
        if not state.where("NOT done").take(1):
            break
        r = rate(F.col("lam"), F.col("size"), F.col("mean"), cap)
        words = F.col("n") * F.col("size") * r
        sums = cells.join(state.where("NOT done").select("key", "lam", "mean"), "key").groupBy("key").agg(
            exact_sum(words).alias("words"), exact_sum(F.when(r < cap, words * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        step = F.col("lam") - (F.col("words") - F.col("target")) / F.col("slope")
        moved = state.join(sums, "key", "left").withColumns({
            "low": F.when(F.col("words") < F.col("target"), F.col("lam")).otherwise(F.col("low")),
            "high": F.when(F.col("words") > F.col("target"), F.col("lam")).otherwise(F.col("high"))})
        inside = (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high"))
        now_done = F.col("done") | F.coalesce(F.abs(F.col("words") - F.col("target")) <= MISS * F.col("target"), F.lit(True))
        state = stored(moved.withColumn("done", now_done).withColumn(
            "lam", F.when(F.col("done"), F.col("lam")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2))
            .select(*state.columns), "duals")
    return stored(goals.join(state.select("key", "lam"), "key", "left"), "rates")


def rounded(rates: np.ndarray, sizes: np.ndarray, cap: float) -> np.ndarray:
    """Whole copies, the rates rounded down or up, that take nearly as many
    words as the rates do; rows by descending size."""
    whole = np.floor(rates).astype(np.int64)
    parts = rates - whole
    free = np.nonzero((parts > 1e-9) & (sizes > 0) & (whole + 1 <= cap))[0]
    up, owed = np.zeros(len(rates), bool), 0.0
    for i in free.tolist():
        owed += parts[i] * sizes[i]
        if owed >= sizes[i] / 2:
            owed -= sizes[i]
            up[i] = True
    taken = whole + up
    # Few or large documents may leave much: then take one more or one less of
    # the one or two documents that come nearest, as long as that helps.
    goal, sized = float(rates @ sizes), np.nonzero(sizes > 0)[0]
    while abs(owed) > 0.001 * goal:
        more, less = sized[taken[sized] + 1 <= cap], sized[taken[sized] > 0]
        row = np.concatenate([more, less, [-1]])
        change = np.concatenate([sizes[more], -sizes[less], [0]]).astype(float)
        order = np.argsort(change, kind="stable")
        near = np.clip(np.searchsorted(change[order], owed - change), 1, len(order) - 1) if len(order) > 1 else np.zeros(1, int)
        pairs = np.stack([order[near - 1], order[near]])
        left = np.abs(owed - change[None, :] - change[pairs])
        left[row[pairs] == row[None, :]] = np.inf
        k, i = np.unravel_index(np.argmin(left), left.shape)
        if left[k, i] >= abs(owed) - 1e-9:
            break
        for j in (i, pairs[k, i]):
            taken[row[j]] += int(np.sign(change[j]))
            owed -= change[j]
    return taken


def copies(sizes: DataFrame, solved: DataFrame, cap: float = 3.0) -> DataFrame:
    """(doc_id, hash, size, source_size, target, copies) of each document."""
    rated = (sizes.join(solved, "key")
             .withColumn("rate", F.when((F.col("size") > 0) & (F.col("target") <= 0), 0.0)
                         .otherwise(rate(F.coalesce("lam", F.lit(0.0)), F.col("size"), F.col("mean"), cap)))
             .withColumn("order", F.xxhash64("doc_id", "hash"))
             .withColumn("block", F.pmod("order", F.ceil(F.col("n_docs") / BLOCK)))
             .select("key", "block", "doc_id", "hash", "order", "size", "source_size", "target", "rate"))
    schema = "doc_id string, hash bigint, size bigint, source_size bigint, target double, copies bigint"

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "order", "doc_id"], ascending=[False, True, True], kind="stable")
        block["copies"] = rounded(block["rate"].round(12).to_numpy(), block["size"].to_numpy(), cap)
        return block[["doc_id", "hash", "size", "source_size", "target", "copies"]]

    # Dealt anew by block: a join on the source has all of a source's blocks in one place.
    # doc_ids go through pandas as text: a column with nulls would be rounded to floats.
    return (rated.withColumn("doc_id", F.col("doc_id").cast("string")).repartition("key", "block")
            .groupBy("key", "block").applyInPandas(run, schema)
            .withColumn("doc_id", F.col("doc_id").cast("bigint")))


def mix(docs: DataFrame, weights: list[float], share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """Copies of every document (doc_id, source, text); see ``copies``."""
    sizes = stored(sized(docs), "sizes")
    goals = stored(targets(sizes, weights, share, cap), "targets")
    return copies(sizes, duals(sizes, goals, cap), cap)


def mixed(docs: DataFrame, weights: list[float], share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    id_, hash_, n, rows, at, times, copy = unused(docs.columns, "id", "hash", "copies", "rows", "place", "times", "copy")
    plan = mix(docs, weights, share, cap).groupBy(F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("hash").alias(hash_)) \
        .agg(F.sum("copies").alias(n), F.count("*").alias(rows))
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), hash_: F.xxhash64("text", "source")})
    # Rows that share id, text and source share their copies: the first ones get what doesn't divide.
    place = F.row_number().over(Window.partitionBy(id_, hash_).orderBy(F.lit(1)))
    often = F.floor(F.col(n) / F.col(rows)) + (F.col(at) <= F.col(n) % F.col(rows)).cast("int")
    return (keyed.join(plan, [id_, hash_]).withColumn(at, place).withColumn(times, often.cast("int"))
            .where(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns))
