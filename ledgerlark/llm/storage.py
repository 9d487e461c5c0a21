"""Tables that outlive lost executors, kept in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table that is sent to every executor, in bytes of its values.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a local one is made, but only in local mode: executors of
    a cluster would each write to their own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not (spark.sparkContext.master or "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgerlark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerlark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent_if_small(df: DataFrame, extra: Column | None = None) -> DataFrame:
    """df, marked to be sent to all executors if its rows hold BROADCAST_BYTES at most: 16 bytes a column, and ``extra``
    for what a row's lists or strings hold. Else as it is, to be joined by a shuffle."""
    width = F.lit(16 * len(df.columns)) + (extra if extra is not None else F.lit(0))
    held = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes too, unless the session says so already: texts may be long."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "-1", "9223372036854775807", str(2**31 - 1)):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
