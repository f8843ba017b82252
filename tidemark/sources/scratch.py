"""A folder that the driver and all executors see, for what is written to be read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a temporary folder for a session whose executors run in the driver's process, and an error for any other."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not place:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def written_text(df: DataFrame, label: str) -> str:
    """Writes the one string column of ``df`` as text files and gives their folder; a value may hold several lines."""
    place = f"{scratch_dir(df.sparkSession)}/tidemark-{label}-{uuid.uuid4().hex}"
    df.write.text(place)
    return place


def written_table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read again."""
    place = f"{scratch_dir(df.sparkSession)}/tidemark-{label}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
