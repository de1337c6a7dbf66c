"""Sources and sinks: streams cut into blocks, JSON lines with checked keys, ordered CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("corpus", "coder", "config", "seed", "timestamp", "measured")


def blocks(streams: DataFrame, id_column: str, text: str, size: int, drop_last: bool = False) -> DataFrame:
    """(id, blk, block) of every stream; the last block may be short unless dropped."""
    if size <= 0:
        raise ValueError("block size must be positive")
    d = streams.select(F.col(id_column).cast("long").alias("id"), F.encode(F.col(text), "UTF-8").alias("b"))
    d = d.filter(F.octet_length("b") > 0).withColumn("blk", F.explode(F.expr(f"sequence(0L, CAST((octet_length(b) - 1) DIV {size} AS BIGINT))")))
    d = d.select("id", "blk", F.expr(f"substring(b, CAST(blk * {size} AS INT) + 1, {size})").alias("block"))
    return d.filter(F.octet_length("block") == size) if drop_last else d


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_records(df: DataFrame, path: str, required: tuple[str, ...] = REQUIRED) -> None:
    """Append JSON lines; records without a required key are refused before anything is written."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if required and df.filter(" OR ".join(f"`{c}` IS NULL" for c in required)).limit(1).count():
        raise ValueError("a required key is null")
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Stable column and row order, range-partitioned: files follow each other in that order."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)
