"""Where streams and iterative jobs put what they keep: the folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session names none, one under /tmp in local mode, and an error on a cluster."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"/tmp/checkpoints/{context.applicationId}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: plans stay short, and a lost executor loses nothing of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A result written as Parquet in the shared folder and read again: compressed, prunable, with known size."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, in the order in which they arrive."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern: a table is a file or a folder


def landed(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, and reads what it wrote; ``batch`` is the micro-batch of each row.

    A batch overwrites its own folder, so one that is run again after a failure leaves no row twice.
    """
    spark, path = stream.sparkSession, fresh(stream.sparkSession, name)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/out").withColumn("batch", F.col("batch").cast("long"))
