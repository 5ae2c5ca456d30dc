"""Shared scratch storage: durable intermediate tables that outlive an executor.

The folder is the one the cluster names in ``spark.checkpoint.dir``; its owner decides
how long results are kept there. Only where that setting is missing in a local session
(one process: ``local`` or ``local[n]``) a temporary folder stands in, until the process ends.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this session."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that every executor can reach")
    return _local_folder().name


@cache
def _local_folder() -> tempfile.TemporaryDirectory:
    """A folder that goes when the process ends."""
    return tempfile.TemporaryDirectory(prefix="duelframe-", ignore_cleanup_errors=True)


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/duelframe/{label}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of a query go when it ends.
FREEING_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query are removed when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(FREEING_SETTING, None)
    spark.conf.set(FREEING_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREEING_SETTING)
        else:
            spark.conf.set(FREEING_SETTING, before)


def materialise(df: DataFrame, label: str, once: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    Columnar, so later readers still prune columns, and durable, so a lost
    executor costs a re-read instead of a recomputation of the lineage. With ``once``, what was shuffled for it is
    freed as soon as it is written.
    """
    path = new_path(df.sparkSession, label)
    with freed_shuffles(df.sparkSession) if once else nullcontext():
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
