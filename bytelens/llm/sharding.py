"""Sharding by proportional stratified interleaving (operator 10).

Rows of each source are put in a seeded random order; row r of n gets the fractional rank
(2r+1)/2n. Sorted by that rank, any stretch of the order holds every source in proportion, so equal
cuts of it are shards that match the mixture. Both ranks are prefix sums over small buckets of
about ``BUCKET`` rows (counts per bucket, a running sum of the counts, a row number inside the bucket):
no source, however hot, and no global sort meets in one task.

Defined cases: a null text has 0 bytes; null sources are one source; null ids and repeated rows are
rows like any other; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import running, scratch, source_key, spread, table

BUCKET = 512


def interleave(rows: DataFrame, n_shards: int, order: list[str], stratum: str = "_src") -> DataFrame:
    """``rows`` with shard and slot. ``stratum`` is a non-null key, ``_h`` the 31-bit shuffled key.

    ``order`` breaks ties of the shuffled key. The law is ``rows``: counts differ by one at most.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    rows = scratch(rows, "shard-rows")
    total = rows.count()
    nb = max(1, -(-total // BUCKET))
    rows = rows.withColumn("_b", F.shiftright(F.col("_h") * F.lit(nb), 31))
    counts = rows.groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_c"))
    sizes = counts.groupBy(F.col(stratum).alias("_s3")).agg(F.sum("_c").alias("_n"))
    counts = running(counts, [stratum], "_b", "_c", "_before").select(F.col(stratum).alias("_s2"), F.col("_b").alias("_b2"), "_before")
    counts = counts.join(sizes, F.col("_s2") == F.col("_s3")).drop("_s3")
    inside = Window.partitionBy(stratum, "_b").orderBy("_h", *order)
    ranked = (
        rows.withColumn("_r", F.row_number().over(inside) - 1)
        .join(counts, (F.col(stratum) == F.col("_s2")) & (F.col("_b") == F.col("_b2")))
        .withColumn("_f", (2 * (F.col("_before") + F.col("_r")) + 1) / (2 * F.col("_n")))
        .withColumn("_g", F.floor(F.col("_f") * nb))
        .drop("_s2", "_b2", "_before", "_n", "_b")
    )
    ranked = scratch(ranked, "shard-ranks")
    cells = ranked.groupBy("_g").agg(F.count(F.lit(1)).alias("_c"))
    cells = running(cells, [], "_g", "_c", "_before").select(F.col("_g").alias("_g2"), "_before")
    place = Window.partitionBy("_g").orderBy("_f", stratum, "_h", *order, "_r")
    p = F.col("_before") + F.col("_r2")
    out = (
        ranked.withColumn("_r2", F.row_number().over(place) - 1)
        .join(cells, F.col("_g") == F.col("_g2"))
        .withColumn("_p", p)
        .withColumn("shard", F.expr(f"CAST((_p * {n_shards}) DIV {max(total, 1)} AS INT)"))
        .withColumn(
            "slot",
            F.expr(f"CAST(_p - (CAST(shard AS BIGINT) * {total} + {n_shards - 1}) DIV {n_shards} AS BIGINT)"),
        )
    )
    return out.drop("_g", "_g2", "_before", "_r", "_r2", "_p", "_f", "_h")


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 42, carry: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and the columns named in ``carry``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    carry = [c for c in carry or [] if c not in ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        source_key(F.col("source")).alias("_src"),
        spread(F.lit(seed), F.col("doc_id"), F.crc32(F.encode(text, "UTF-8"))).alias("_h"),
        *[F.col(c) for c in carry],
    )
    out = interleave(rows, n_shards, ["doc_id", "text_crc32", "size"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        *carry,
    )


def op10_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), n_shards=40)
