"""Block streams with Structured Streaming: per-block measures, state across a stream, and an idempotent sink.

Results go to Parquet, a folder a micro-batch: a batch that runs again overwrites its folder, so each counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelens.operators import bytecounts
from bytelens.sources.corpora import blocks
from bytelens.sources.scratch import shared_folder

_PI = Decimal("3.141592653589793238462643383279502884197169")
#: Bernoulli numbers over 2k(2k - 1), as fractions.
_STIRLING = ((1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188), (-691, 360360), (1, 156), (-3617, 122400))


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over what is there now and return its result: all rows, or the last batch's of a complete result."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/bytelens-{name}-{uuid.uuid4().hex}"
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
        last.append(number)

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema)
    return rows.parquet(f"{base}/rows/batch={max(last)}") if mode == "complete" else rows.option("recursiveFileLookup", True).parquet(f"{base}/rows")


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as a stream of files, be it one file or a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    # by a pattern: a stream takes a plain path for a folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")


def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts per event type; the state is one row a type."""
    counts = read_stream(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))
    return drain(counts, "event-counts", "complete")


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over event time behind a watermark (an extension: complete output)."""
    hours = read_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return drain(hours, "daily", "complete").select(F.col("window.start").alias("day"), "event_type", "n")


def dedupe_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At-least-once input, each key once in the result; keys are forgotten a day after their event."""
    events = read_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    twice = events.unionByName(events).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type")
    return drain(twice, "deduped", "append")


def stream_block_bits(spark: SparkSession, sf_dir: str, size: int = 1024) -> DataFrame:
    """Adaptive bits of every block of every document, each from empty state: nothing is held between rows of the stream."""
    cut = blocks(read_stream(spark, sf_dir, "documents"), "doc_id", "text", size).withColumnRenamed("block", "text")
    found = drain(bytecounts.adaptive(cut, ["id", "blk"]), "block-bits", "append")
    return found.select(F.col("id").alias("doc_id"), "blk", F.col("len").alias("bytes"), F.round("b0", 4).alias("bits"))


def _log_gamma(z: Decimal) -> Decimal:
    """ln of the gamma function, by Stirling's series from 40 on."""
    below = Decimal(1)
    while z < 40:
        below *= z
        z += 1
    series = sum(Decimal(a) / (b * z**k) for k, (a, b) in zip(range(1, 16, 2), _STIRLING))
    return (z - Decimal("0.5")) * z.ln() - z + (2 * _PI).ln() / 2 + series - below.ln()


def order0_bits(counts: np.ndarray) -> float:
    """Adaptive order-0 bits of a stream with these counts of bytes: each byte costs log2 of (256 + 32 bytes before) / (1 + 32 equal ones before).

    The sum does not depend on the order of the bytes; it is taken in 40 digits, so no stream is too long for its decimals.
    """
    with localcontext(prec=40):
        first = Decimal(1) / 32
        nats = _log_gamma(Decimal(int(counts.sum()) + 8)) - _log_gamma(Decimal(8))
        nats -= sum(_log_gamma(first + n) - _log_gamma(first) for n in counts[counts > 0].tolist())
        return float(nats / Decimal(2).ln())


def carried_bits(stream: DataFrame, key: str) -> DataFrame:
    """Adaptive order-0 bits of each key's texts so far; the state of a key is 256 counts. Keys without bytes give no row.

    Tasks count bytes batch by batch, so only counts meet by key, however long its texts are.
    """

    def count(batches):
        for b in batches:
            names = b.column(0).dictionary_encode(null_encoding="encode")
            data, off = bytecounts._flat(b.column(1))
            group = names.indices.to_numpy().astype(np.int64)
            for a in range(0, len(data), bytecounts.PIECE):
                x = data[a : a + bytecounts.PIECE]
                row = np.searchsorted(off, np.arange(a, a + len(x)), side="right") - 1
                found, c = bytecounts._tally(group[row] << 8 | x)
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(found >> 8)), pa.array(found & 255), pa.array(c)], [key, "x", "c"])

    def run(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        counts = np.array(state.get[0], np.int64) if state.exists else np.zeros(256, np.int64)
        for f in frames:
            np.add.at(counts, f["x"].to_numpy(), f["c"].to_numpy())
        state.update((counts.tolist(),))
        yield pd.DataFrame({key: [group[0]], "bits": [order0_bits(counts)], "bytes": [int(counts.sum())]})

    parts = stream.select(key, "text").mapInArrow(count, f"{key} string, x long, c long")
    return parts.groupBy(key).applyInPandasWithState(run, f"{key} string, bits double, bytes long", "counts array<bigint>", "update", "NoTimeout")


def stream_carried_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of each source as one stream whose counts go on from document to document."""
    got = drain(carried_bits(read_stream(spark, sf_dir, "documents").filter("source IS NOT NULL"), "source"), "carried-bits", "update")
    return got.groupBy("source").agg(F.max_by("bits", "bytes").alias("bits"), F.max("bytes").alias("bytes")).select("source", F.round("bits", 2).alias("bits"), "bytes")
