"""Mixing sources to target weights: whole repetitions plus one hash-seeded extra copy. DataFrame functions only.

A source's share of the mix follows its weight, but no source is repeated more than ``cap`` times; what a capped source
cannot take is reshared by weight. A source's rate is its target over its size. A document is emitted floor(rate) times,
plus once more if its hash-seeded uniform number is below the rate's fraction.

The uniform number is the document's hash, read through the distribution of its source: the share of the source's words
in documents with a smaller hash. It is uniform whatever the sizes, the extra copy has the fraction as its probability,
and a source's taken words come within half a bin of the target, where independent draws would miss it by
the few very long documents of a source. The distribution is kept per source in ``BINS`` bins of the hash, so the text
is scanned twice and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import numbered, running, small, words_count
from duelframe.storage import materialise

#: Bins of the hash per source: three hexadecimal digits. A bin is 1/4096 of a source, so rounding to bins misplaces at most half of that.
BINS = 1 << 12


def hash_bin(key: Column, seed: int) -> Column:
    """The leading bits of md5 of the key and the seed."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"/{seed}")))
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """Target words per source from (source, source_size).

    Sources take ``weights`` in turn, by code point with NULL last. Together they get ``share`` of all words. Targets
    are proportional to weights but stop at ``cap`` times the source's size. Filling up to one common level is the fixed
    point of resharing the excess: sources fill in order of cap over weight, those below the level are full.
    An empty source has target 0. An empty table gives an empty table.
    """
    total = sizes.agg(F.sum("source_size").cast("double")).first()[0] or 0.0
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = numbered(sizes, [F.col("source").isNull(), F.col("source")], "mix-sources", "_rank")
    ranked = ranked.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    ratio = F.col("_cap") / F.col("_weight")
    filled = running(ranked, [ratio, F.col("_rank")], {"_caps": "_cap", "_weights": "_weight"}, "mix-levels")
    weight_sum = ranked.agg(F.sum("_weight")).first()[0] or 0.0
    level_if_open = (F.lit(total * share) - F.col("_caps")) / (F.lit(weight_sum) - F.col("_weights"))
    filled = materialise(filled.withColumn("_full", level_if_open >= ratio), "mix-filled")
    full = filled.where("_full").agg(F.sum("_cap").alias("c"), F.sum("_weight").alias("w")).first()
    rest = weight_sum - (full["w"] or 0.0)
    level = (total * share - (full["c"] or 0.0)) / rest if rest > 0 else 0.0
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_weight") * F.lit(level)))
    return filled.select("source", "source_size", target.alias("target"))


def thresholds(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Add to each source its whole repetitions and the hash bin below which documents get the extra copy.

    ``docs`` has (source, _size, _bin). The threshold is the bin boundary where the words of smaller bins come nearest to
    the fraction of the source. Each source has at most ``BINS`` rows in the window.
    """
    bins = docs.where("_size > 0").groupBy("source", "_bin").agg(F.sum("_size").alias("_words"))
    by_hash = Window.partitionBy("source").orderBy("_bin")
    bins = bins.withColumn("_upto", F.sum("_words").over(by_hash))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("_rate", rate).withColumn("_whole", F.floor("_rate")).withColumn("_fraction", F.col("_rate") - F.col("_whole"))
    wanted = F.col("_fraction") * F.col("source_size")
    near = (
        bins.alias("b")
        .join(small(plan).alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
        .where(F.col("_upto") - F.col("_words") / 2 <= wanted)
        .groupBy(F.col("b.source").alias("_source"))
        .agg(F.max("_bin").alias("_last"))
    )
    joined = plan.join(near, F.col("source").eqNullSafe(F.col("_source")), "left")
    below = F.when(F.col("_fraction") > 0, F.coalesce(F.col("_last") + 1, F.lit(0))).otherwise(F.lit(0))
    return joined.select("source", "source_size", "target", "_whole", below.cast("long").alias("_below"))


def mix(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``; one row per row of ``docs``.

    * The size is the number of words; NULL and empty texts have 0 and count nowhere, but are repeated like the others.
    * NULL is a source of its own, last in the order. Rows with the same key share their draw; a NULL key counts as "".
    * A source of size 0 has target 0 and its rows get no copy. An empty table gives an empty table.
    * Other columns are kept; columns of ``docs`` named ``mix_...`` are replaced.
    Reruns agree: the result depends on keys, sizes, sources and ``seed`` only.
    """
    slim = materialise(
        docs.select(
            F.col(source).cast("string").alias("source"), words_count(F.col(text)).alias("_size"), hash_bin(F.col(key), seed).alias("_bin")
        ),
        "mix-sizes",
    )
    sizes = slim.groupBy("source").agg(F.sum("_size").alias("source_size"))
    plan = materialise(thresholds(slim, targets(sizes, list(weights), share, cap)), "mix-plan")
    plan = plan.select(
        F.col("source").alias("_mix_source"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        F.col("_whole").alias("_mix_whole"),
        F.col("_below").alias("_mix_below"),
    )
    kept = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    joined = kept.withColumn("mix_size", words_count(F.col(text))).join(
        small(plan), F.col(source).cast("string").eqNullSafe(F.col("_mix_source"))
    )
    extra = (hash_bin(F.col(key), seed) < F.col("_mix_below")).cast("long")
    return joined.withColumn("mix_copies", F.col("_mix_whole") + extra).drop("_mix_source", "_mix_whole", "_mix_below")


def emit(mixed: DataFrame) -> DataFrame:
    """The mixed documents themselves: each row as often as ``mix_copies`` says, in the columns it came with."""
    columns = [c for c in mixed.columns if not c.startswith("mix_")]
    copies = mixed.where("mix_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return copies.select(*columns)


def digest(spark, folder: str) -> DataFrame:
    """Query op7_mixing: the mix of all documents."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    out = mix(docs)
    return out.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.round("mix_target", 6).alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


SQL = r"""
WITH docs AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/7'), 1, 3) AS BIGINT) AS bin
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS weight
  FROM docs GROUP BY source),
filled AS (
  SELECT *, 2.0 * source_size AS cap,
    (SELECT 1.5 * sum(source_size) FROM sources)::DOUBLE AS total, (SELECT sum(weight) FROM sources) AS all_weight,
    coalesce(sum(2.0 * source_size) OVER o, 0)::DOUBLE AS caps, coalesce(sum(weight) OVER o, 0) AS weights
  FROM sources
  WINDOW o AS (ORDER BY 2.0 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, (total - caps) / (all_weight - weights) >= cap / weight AS fully FROM filled),
level AS (
  SELECT any_value(total) - coalesce(sum(cap) FILTER (fully), 0) AS words,
    any_value(all_weight) - coalesce(sum(weight) FILTER (fully), 0) AS weight FROM marked),
plan AS (
  SELECT source, source_size,
    CAST(CASE WHEN fully THEN cap ELSE least(cap, m.weight * l.words / l.weight) END AS DOUBLE) AS target
  FROM marked m, level l),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM plan),
bins AS (
  SELECT source, bin, words, sum(words) OVER (PARTITION BY source ORDER BY bin) AS upto
  FROM (SELECT source, bin, sum(size) AS words FROM docs WHERE size > 0 GROUP BY source, bin)),
below AS (
  SELECT b.source, max(bin) AS last FROM bins b JOIN rates r ON b.source IS NOT DISTINCT FROM r.source
  WHERE upto - words / 2 <= (rate - floor(rate)) * source_size GROUP BY b.source)
SELECT d.doc_id, d.size, r.source_size, round(r.target, 6) AS target,
  CAST(d.size * (floor(rate) + CASE WHEN rate > floor(rate) AND d.bin <= coalesce(w.last, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM docs d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN below w ON w.source IS NOT DISTINCT FROM r.source
"""
