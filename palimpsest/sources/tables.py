"""Tables written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A session on one machine that names none gets a temporary folder; a cluster that names none is an error, since
    its executors would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Codec of written Parquet tables: denser than Spark's default. Fixed value.
CODEC = "zstd"


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), kind: str = "parquet") -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    out = df.write.partitionBy(*partition_by).format(kind)
    (out.option("compression", CODEC) if kind == "parquet" else out).save(path)
    return df.sparkSession.read.schema(df.schema).format(kind).load(path)
