"""Steps of long plans as files, so that what several branches read is computed once and outlives a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet files in spark.checkpoint.dir: a few bytes a value, where a checkpoint's rows take eight and more, and
    branches read the columns that they need. Only a session whose executors are threads of the driver may go without that setting."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="leadlens-"))
    path = f"{sc.getCheckpointDir()}/step-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
