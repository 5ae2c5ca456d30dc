"""A corpus pipeline: toxic documents go, one of each group of near copies stays, sources are mixed, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet into the shared folder and
rereads it as the next stage's ``docs``. All stages but the last return the columns of ``documents``. NULL and empty texts pass the filters and are packed
as their end token alone; an empty table gives an empty result. The other cases are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm import mixing, near_copies, packing, toxicity
from duelframe.storage import materialise


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the model learns from the labels that are not held out."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.judged(docs, model).where(F.col("toxic_score") < toxicity.THRESHOLD).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, a similarity of 0.8."""
    return near_copies.deduplicated(docs).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return mixing.emit(mixing.mix(docs)).select(*docs.columns)


#: Pieces of text that a packing task remembers, and bytes of text that it encodes at a time. The executors still hold what the earlier stages took, so less
#: than where packing runs alone.
REMEMBERED = 60_000
SLICE_BYTES = 2 << 20


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the documents with their sequence and offset."""
    return packing.pack_documents(docs, generation=REMEMBERED, slice_bytes=SLICE_BYTES)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

# SQL can express neither the fitted score nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
