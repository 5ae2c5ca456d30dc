"""Stored key filters: is a new row's key already in the history? Only partitions that may hold one of the new keys are read.

A filter is a Bloom filter of 64-bit words (Putze, Sanders and Singler, 2007): a key sets ``PROBES`` bits of one word, so testing a key against a
partition is one equality join on the word and a bit test. The filter of a partition has a word for every ``KEYS_PER_WORD`` keys, rounded up to
a power of two, and only words with a bit set are stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.operators.sets import union_by_name

PROBES = 5
KEYS_PER_WORD = 4


def _word_and_mask(keys: Sequence[str], words: Column) -> tuple[Column, Column]:
    """The word of a key in a filter of ``words`` words, and its bits there. NULL is a key of its own."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys] + [F.col(k).isNull().cast("string") for k in keys]
    where, which = F.xxhash64(F.lit("word"), *parts), F.xxhash64(F.lit("bits"), *parts)
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        # six bits of the hash choose one of 64
        bit = F.shiftrightunsigned(which, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return where.bitwiseAND(words.cast("long") - 1), mask


def key_filters(df: DataFrame, keys: Sequence[str], partition: str) -> DataFrame:
    """(partition, words, word, bits) of each partition's keys: a table to be stored next to the partition, one row for at least one key."""
    counted = df.groupBy(partition).agg(F.count(F.lit(1)).alias("__n"))
    size = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("__n") / KEYS_PER_WORD, F.lit(1.0))))).cast("int")
    sized = counted.select(F.col(partition).alias("__partition"), F.call_function("shiftleft", F.lit(1).cast("long"), size).alias("words"))
    # one row per partition
    rows = df.select(partition, *keys).join(F.broadcast(sized), F.col(partition).eqNullSafe(F.col("__partition")))
    word, mask = _word_and_mask(keys, F.col("words"))
    bits = rows.select("__partition", "words", word.alias("word"), mask.alias("mask"))
    out = bits.groupBy("__partition", "words", "word").agg(F.bit_or("mask").alias("bits"))
    return out.withColumnRenamed("__partition", partition)


def suspects(new: DataFrame, keys: Sequence[str], filters: DataFrame, partition: str) -> DataFrame:
    """(keys, partition): the old partitions that may hold a new row's key, and no other of the new keys' pairs. None is missed.

    A key probes one word per filter size, of which there are as many as there are powers of two among the partitions.
    """
    sizes = [r[0] for r in filters.select("words").distinct().collect()]
    distinct = new.select(*keys).distinct()
    probes = union_by_name([
        distinct.select(*keys, F.lit(n).alias("words"), word.alias("word"), mask.alias("mask")) for n in sizes for word, mask in [_word_and_mask(keys, F.lit(n))]
    ]) if sizes else distinct.select(*keys, F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("word"), F.lit(0).cast("long").alias("mask"))
    met = probes.join(filters, ["words", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return met.select(*keys, partition)


def known_keys(new: DataFrame, history: DataFrame, filters: DataFrame, keys: Sequence[str], partition: str) -> tuple[DataFrame, list]:
    """(keys, partition, n) of the new keys that the history holds, with the rows there, and the partitions that were read to find out.

    ``history`` should be stored by ``partition``: the list prunes its files. The driver holds one value per partition read.
    """
    suspected = suspects(new, keys, filters, partition)
    read = sorted((r[0] for r in suspected.select(partition).distinct().collect()), key=lambda v: (v is not None, v))
    within = F.col(partition).isin([v for v in read if v is not None])
    within = within | F.col(partition).isNull() if None in read else within
    old = history.where(within).select(*keys, partition)
    wanted = new.select(*[F.col(k).alias(f"__key_{k}") for k in keys]).distinct()
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return old.join(wanted, match, "left_semi").groupBy(*keys, partition).agg(F.count(F.lit(1)).alias("n")), read
