"""Mixing sources to target weights by a low-discrepancy schedule (operator 1).

Each source's documents are put in a seeded random order and their words cut into equal blocks.
Slot k of the schedule draws the point frac(k * golden ratio) (a Weyl sequence in 64-bit integers)
and the point's place among the cumulative target weights, in blocks of each source's own size, names the source; the slot's rank among
its source's slots names the block, wrapping into a second pass when a target exceeds the source.
Slots are ranked by counts per run of slots plus a rank inside the run, and positions of documents in
their source by bucketed prefix sums, so neither a hot source nor the schedule meets in one task.

Defined cases: a null text has 0 words, and no words are taken from a document without words;
null sources are one source, last in order; repeated rows are rows of their own; an empty table gives an
empty result; other columns are left alone. The number of sources is bounded by ``MAX_SOURCES``
(their sizes are gathered to set the targets); more raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, running, scratch, source_key, spread, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BUCKET = 512
RUN = 1 << 14
MAX_SOURCES = 100_000
MAX_SLOTS = 1_000_000
GOLDEN = 0x9E3779B97F4A7C15


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Water level: by weight, stopping at ``most`` times a size, the excess reshared by weight."""
    cap = [most * s for s in sizes]
    left, open_ = float(total), sorted(range(len(sizes)), key=lambda i: cap[i] / weights[i])
    out, weight = [0.0] * len(sizes), float(sum(weights))
    for i in open_:
        out[i] = min(cap[i], left * weights[i] / weight) if weight > 0 else 0.0
        left -= out[i]
        weight -= weights[i]
    return out


def block_sizes(sizes: list[int]) -> list[int]:
    """Words of a block of each source: a share of the source's own size, so that small sources meet their targets beside large ones."""
    most = max(1024, MAX_SLOTS // (2 * max(1, len(sizes))))
    return [max(1, -(-s // most)) for s in sizes]


def schedule(spark: SparkSession, sources: list[str], shares: list[float], n_slots: int) -> DataFrame:
    """(source, rank, slot): slot k's source, and how many slots before k the source has."""
    total = float(sum(shares))
    if n_slots <= 0 or total <= 0:
        return spark.createDataFrame([], "source string, rank long, slot long")
    edges = np.cumsum(np.asarray(shares, float)) / total
    edges[-1] = 2.0
    names = np.asarray(sources, object)

    def draw(k: np.ndarray) -> np.ndarray:
        point = (k.astype(np.uint64) * np.uint64(GOLDEN)).astype(np.float64) / 2.0**64
        return np.searchsorted(edges, point, side="right")

    def count(batches):
        for b in batches:
            for r in b.column(0).to_pylist():
                ks = np.arange(r * RUN, min((r + 1) * RUN, n_slots), dtype=np.int64)
                s, c = np.unique(draw(ks), return_counts=True)
                yield pa.RecordBatch.from_pydict({"run": np.full(len(s), r, np.int64), "s": s.astype(np.int64), "c": c.astype(np.int64)})

    def rank(batches):
        for b in batches:
            for r, ss, before in zip(b.column("run").to_pylist(), b.column("ss").to_pylist(), b.column("before").to_pylist()):
                ks = np.arange(r * RUN, min((r + 1) * RUN, n_slots), dtype=np.int64)
                s = draw(ks)
                order = np.argsort(s, kind="stable")
                first = np.searchsorted(s[order], s[order], side="left")
                start = np.zeros(len(names), np.int64)
                start[ss] = before
                yield pa.RecordBatch.from_pydict(
                    {
                        "source": pa.array(names[s[order]], pa.string()),
                        "rank": np.arange(len(ks)) - first + start[s[order]],
                        "slot": ks[order],
                    }
                )

    runs = -(-n_slots // RUN)
    per_task = max(1, min(runs, 4096))
    counts = spark.range(0, runs, 1, per_task).mapInArrow(count, "run long, s long, c long")
    counts = counts.withColumn("before", F.sum("c").over(Window.partitionBy("s").orderBy("run")) - F.col("c"))
    packed = counts.groupBy("run").agg(F.collect_list(F.struct("s", "before")).alias("x"))
    packed = packed.select("run", F.col("x.s").alias("ss"), F.col("x.before").alias("before"))
    return packed.mapInArrow(rank, "source string, rank long, slot long")


def mix(docs: DataFrame, seed: int = 42, weights=WEIGHTS, share: float = SHARE, carry: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, and the columns named in ``carry``."""
    spark = docs.sparkSession
    carry = [c for c in carry or [] if c not in ("doc_id", "source", "size", "source_size", "target", "taken")]
    base = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"),
        source_key(F.col("source")).alias("_src"),
        F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")).alias("_crc"),
        *carry,
    ).withColumn("_h", spread(F.lit(seed), F.col("doc_id"), F.col("_crc")))
    base = scratch(base, "mix-rows")
    per = base.groupBy("_src").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
    found = per.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted(found, key=lambda r: r["_src"])
    names, sizes = [r["_src"] for r in found], [int(r["n"]) for r in found]
    rows, total = sum(r["rows"] for r in found), sum(sizes)
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share * total) if names else []
    sized = block_sizes(sizes)
    per_source = [t / b for t, b in zip(want, sized)]
    slots = int(round(sum(per_source))) if total else 0
    goal = spark.createDataFrame(
        [(n, s, float(t), b) for n, s, t, b in zip(names, sizes, want, sized)], "_src string, source_size long, target double, _block long"
    )
    n_blocks = {n: -(-s // b) for n, s, b in zip(names, sizes, sized)}
    blocks = spark.createDataFrame([(n, b) for n, b in n_blocks.items() if b], "source string, n_blocks long")
    plan = schedule(spark, names, per_source, slots)
    times = (
        plan.join(F.broadcast(blocks), "source")  # one row a source, MAX_SOURCES at most
        .filter(F.col("rank") < MOST * F.col("n_blocks"))
        .groupBy(F.col("source").alias("_s3"), F.pmod("rank", "n_blocks").alias("_k3"))
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    nb = max(1, -(-rows // BUCKET))
    base = base.withColumn("_b", F.shiftright(F.col("_h") * F.lit(nb), 31))
    ahead = base.groupBy("_src", "_b").agg(F.sum("size").alias("_c"))
    ahead = running(ahead, ["_src"], "_b", "_c", "_ahead").select(F.col("_src").alias("_s2"), F.col("_b").alias("_b2"), "_ahead")
    inside = Window.partitionBy("_src", "_b").orderBy("_h", "doc_id", "_crc", "size")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        base.withColumn("_rn", F.row_number().over(inside))
        .withColumn("_in", F.sum("size").over(upto) - F.col("size"))
        .join(ahead, (F.col("_src") == F.col("_s2")) & (F.col("_b") == F.col("_b2")))
        .withColumn("_at", F.col("_ahead") + F.col("_in"))
        .drop("_s2", "_b2", "_ahead", "_in", "_crc", "_h")
    )
    some = placed.select("_src", "_b", "_rn", "_at", "size").filter("size > 0")
    some = some.join(F.broadcast(goal.select("_src", "_block")), "_src")  # one row a source, MAX_SOURCES at most
    parts = some.select(
        "*", F.explode(F.sequence(F.expr("_at DIV _block"), F.expr("(_at + size - 1) DIV _block"))).alias("_k")
    ).withColumn(
        "_words",
        F.least(F.col("_at") + F.col("size"), (F.col("_k") + 1) * F.col("_block")) - F.greatest(F.col("_at"), F.col("_k") * F.col("_block")),
    )
    took = (
        parts.join(times, (F.col("_src") == F.col("_s3")) & (F.col("_k") == F.col("_k3")))
        .groupBy("_src", "_b", "_rn")
        .agg(F.sum(F.col("_words") * F.col("_times")).alias("taken"))
    )
    return (
        placed.join(took, ["_src", "_b", "_rn"], "left")
        .join(F.broadcast(goal), "_src")  # one row a source, MAX_SOURCES at most
        .select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", *carry
        )
    )


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
