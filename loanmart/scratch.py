"""Written intermediate tables, in a folder that driver and executors share.

The cluster names the folder in ``spark.checkpoint.dir``; where that is unset (tests,
the bench) the session's warehouse folder serves.  Every application writes below a
folder of its own, and :func:`clear` removes it when none of its frames is needed any more.
A written table cuts the lineage: an executor that is lost later costs no rework.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/loanmart-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path nothing was written to yet."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The frame, written once and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
COMPILED_BYTES = "8000"  # longer methods the JVM interprets, however often they run


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside have no generated method too long to be compiled; Spark cuts such projections into short ones."""
    before = spark.conf.get(HUGE_METHOD, None)
    spark.conf.set(HUGE_METHOD, COMPILED_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(HUGE_METHOD)
        else:
            spark.conf.set(HUGE_METHOD, before)


def clear(spark: SparkSession) -> bool:
    """Remove all this application wrote; frames read from it can't be used afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
