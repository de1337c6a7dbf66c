"""Tables written once to the folder that all executors share: later plans start from the files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; one of our own only where a local session names none (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="bytelens-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df``, written and read back; the files go when the JVM of the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/bytelens-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
