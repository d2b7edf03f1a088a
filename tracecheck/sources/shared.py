"""Places that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def base(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Only a local master may go without."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "/tmp/checkpoints"
    return place.rstrip("/")


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{base(spark)}/tracecheck-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again from there: what comes after doesn't depend on its making."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base(df.sparkSession))
    return df.checkpoint(eager=True)


def tasks(spark: SparkSession) -> int:
    """In how many parts work is dealt out that costs far more than its input's size tells."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out by their key: a small file of short rows is one task else, whatever is made of the rows. A number of parts
    that is asked for isn't lowered by adaptive plans."""
    return rows.repartition(tasks(rows.sparkSession), key)
