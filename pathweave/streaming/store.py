"""A shared place for results that later steps read more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def shared_dir(spark) -> str:
    """The folder named in spark.checkpoint.dir. Without one, a temporary folder where driver and executors are one process, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="pathweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
