"""Queries around the block codec, replay and streams; SQL equivalents where the result is a plain aggregate."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelens.functions.dialect import duck_sql, spread
from bytelens.operators import codec, enumerative, mixing, phrases, replica, resample, twopass
from bytelens.sources.corpora import blocks
from bytelens.sources.scratch import settled
from bytelens.streaming import blocks as streams

BLOCK = 128


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spread(spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "item_id", "text", BLOCK)


def q70_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = codec.unpack(codec.pack(_blocks(spark, sf_dir)))
    return got.select(F.col("id").alias("item_id"), "blk", F.sha2("block", 256).alias("sha"), "intact")


def q71_archive_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = codec.pack(_blocks(spark, sf_dir))
    size = F.sum(F.octet_length("payload")).cast("long")
    return a.groupBy(F.col("id").alias("item_id")).agg((F.lit(48) + 32 * F.count(F.lit(1)) + size).alias("archive_bytes"), F.sum("size").alias("bytes"))


def q72_read_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = codec.read_range(codec.pack(_blocks(spark, sf_dir)), 100, 60, BLOCK)
    return got.select(F.col("id").alias("item_id"), F.sha2("data", 256).alias("sha"), "intact")


def q73_tamper_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = codec.pack(_blocks(spark, sf_dir)).withColumn("check", F.when(F.col("blk") == 0, F.lit(b"\0" * 8)).otherwise(F.col("check")))
    return codec.unpack(a).groupBy("intact").agg(F.count(F.lit(1)).alias("n"))


def q65c_compressor_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.mode_costs(_blocks(spark, sf_dir)).groupBy("mode").agg(F.sum("bits").alias("bits"), F.count(F.lit(1)).alias("n"))


def q114_lz78_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"item_id": b.column("id"), "blk": b.column("blk"), "bits": pa.array([codec.lz78_bits(x) for x in b.column("block").to_pylist()], pa.int64())})

    return _blocks(spark, sf_dir).mapInArrow(run, "item_id long, blk long, bits long")


def q87_lru_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("kind", F.crc32(F.encode("event_type", "UTF-8")))
    return resample.lru_replay(e, "user_id", "event_id", "kind", 3)


def q113_bca_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bca_by(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_mktsegment", "c_acctbal")


def _roundtrip(spark: SparkSession, sf_dir: str, width: int, predictor) -> DataFrame:
    got = codec.unpack(codec.pack(_blocks(spark, sf_dir), width, predictor), width, predictor)
    return got.select(F.col("id").alias("item_id"), "blk", F.sha2("block", 256).alias("sha"), "intact")


def q74_cm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, 3, mixing.Mixed)


def q75_hashed_cm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roundtrip(spark, sf_dir, 6, mixing.Hashed)


def q74b_cm_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes under the counting, the mixing and the hashed mixing predictor."""
    sizes = [codec.pack(_blocks(spark, sf_dir), w, p).select(F.lit(name).alias("predictor"), F.octet_length("payload").alias("n"), "size") for name, w, p in (("counts", 3, codec.Counts), ("mixed", 3, mixing.Mixed), ("hashed", 6, mixing.Hashed))]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2]).groupBy("predictor").agg(F.sum("n").cast("long").alias("coded"), F.sum("size").alias("bytes"))


def _kept(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    items = spread(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.lit("benchmark").alias("corpus"), "text"))
    return settled(twopass.prune(twopass.gram_counts(items, width), width), "kept")


def _frozen(spark: SparkSession, sf_dir: str, width: int, kept: DataFrame | None = None) -> DataFrame:
    kept = _kept(spark, sf_dir, width) if kept is None else kept.filter(F.col("ord") <= width)
    return twopass.pack_frozen(_blocks(spark, sf_dir).withColumn("corpus", F.lit("benchmark")), kept, width)


def q33_two_pass_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frozen(spark, sf_dir, 2).select(F.col("id").alias("item_id"), "blk", F.sha2("again", 256).alias("sha"))


def q33b_two_pass_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded bytes with the model against one adaptive pass; equal goes to the single pass."""
    two = _frozen(spark, sf_dir, 2).agg((F.sum(F.octet_length("payload")) + F.max("model_size") + 4).cast("long").alias("two_pass"))
    one = codec.pack(_blocks(spark, sf_dir)).agg(F.sum(F.octet_length("payload")).cast("long").alias("one_pass"))
    return one.crossJoin(two).select("*", F.when(F.col("two_pass") < F.col("one_pass"), "two-pass").otherwise("single-pass").alias("chosen"))


def q32_auto_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and payload of each width that memory allows; the smallest sum wins, the smaller width of equals."""
    size = spark.read.parquet(f"{sf_dir}/benchmark.parquet").agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    kept = _kept(spark, sf_dir, twopass.widest(size))
    rows = [_frozen(spark, sf_dir, w, kept).agg((F.sum(F.octet_length("payload")) + F.max("model_size")).cast("long").alias("bytes")).select(F.lit(w).alias("width"), "bytes") for w in twopass.WIDTHS if w <= twopass.widest(size)]
    all_ = reduce(DataFrame.unionByName, rows)
    best = all_.agg(F.min(F.struct("bytes", "width")).alias("b"))
    return all_.crossJoin(best).select("width", "bytes", (F.col("width") == F.col("b.width")).alias("chosen"))


def q144_block_width_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive bytes of each block size and context width: 32 for each block's entry, and its payload."""
    items = spread(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rows = []
    for size in (64, 256, 1024):
        cut = blocks(items, "item_id", "text", size)
        for width in (1, 2, 3):
            got = codec.pack(cut, width).agg((32 * F.count(F.lit(1)) + F.sum(F.octet_length("payload"))).cast("long").alias("bytes"), F.sum(F.col("raw").cast("long")).alias("stored"))
            rows.append(got.select(F.lit(size).alias("block"), F.lit(width).alias("width"), "bytes", "stored"))
    return reduce(DataFrame.unionByName, rows)


def q76_dictionary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for b in batches:
            plain = b.column("block").to_pylist()
            coded = [phrases.encode(x) for x in plain]
            back = [phrases.decode(*c) for c in coded]
            yield pa.RecordBatch.from_pydict({"item_id": b.column("id"), "blk": b.column("blk"), "again": pa.array(back, pa.binary())})

    got = _items(spark, sf_dir).mapInArrow(run, "item_id long, blk long, again binary")
    return got.select("item_id", "blk", F.sha2("again", 256).alias("sha"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spread(spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "item_id", "text", 1024)


def q77_parse_saving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, archive bits, and bits of the one parse against all parses."""

    def run(batches):
        for b in batches:
            out = {"item_id": b.column("id"), "blk": b.column("blk")}
            rows = []
            for x in b.column("block").to_pylist():
                p, _, payload = phrases.encode(x)
                rows.append((len(p), phrases.archive_bits(p, payload), *(round(v, 6) for v in phrases.parse_saving(x, p))))
            for i, (name, kind) in enumerate((("phrases", pa.int64()), ("archive_bits", pa.int64()), ("one_parse", pa.float64()), ("all_parses", pa.float64()))):
                out[name] = pa.array([r[i] for r in rows], kind)
            yield pa.RecordBatch.from_pydict(out)

    return _items(spark, sf_dir).mapInArrow(run, "item_id long, blk long, phrases long, archive_bits long, one_parse double, all_parses double")


def q88_tail_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [enumerative.tail_probability(spark, [0.5, 0.25, 0.15, 0.1], n, 2.2, 2000).select(F.lit(n).alias("steps"), F.round("tail", 9).alias("tail"), "hits") for n in (20, 40, 80)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def q111_set_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each part as a number; the set read back."""
    got = enumerative.set_ranks(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_partkey", "l_suppkey")
    return got.select("l_partkey", F.col("size").alias("n"), F.array_join(F.array_sort("back"), ",").alias("suppliers"))


def q112_huffman_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = enumerative.huffman_by(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "event_type")
    return got.select("user_id", "symbols", "n", F.round("mean_bits", 6).alias("mean_bits"))


def q130_grammar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of matched brackets by length; some are numbered and read back."""

    def run(batches):
        g = enumerative.Grammar(*enumerative.BRACKETS, 20)
        for b in batches:
            n = [i + 1 for i in b.column("id").to_pylist()]
            words = [g.words["S"][2 * k] for k in n]
            back = [all(g.rank("S", g.unrank("S", 2 * k, x)) == x for x in range(0, w, max(1, w // 50))) for k, w in zip(n, words)]
            yield pa.RecordBatch.from_pydict({"n": pa.array(n, pa.int64()), "words": pa.array(words, pa.int64()), "round_trip": back})

    return spark.range(0, 10).mapInArrow(run, "n long, words long, round_trip boolean")


def _traced(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    def run(batches):
        for b in batches:
            found = [mixing.trace(x, mixing.Mixed(3)) for x in b.column("block").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "blk": b.column("blk"), "bits": pa.array([f[0] for f in found], pa.float64()), "digest": pa.array([f[1] for f in found], pa.string())})

    return _blocks(spark, sf_dir).repartition(parts, "id", "blk").mapInArrow(run, "id long, blk long, bits double, digest string")


def q142_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of the mixing predictor on 8 and on 3 partitions: equal digests, and coded sizes next to the ideal ones."""
    coded = codec.pack(_blocks(spark, sf_dir), 3, mixing.Mixed).select("id", "blk", "raw", F.octet_length("payload").alias("n"))
    a, b = _traced(spark, sf_dir, 8), _traced(spark, sf_dir, 3).select("id", "blk", F.col("digest").alias("again"))
    met = a.join(b, ["id", "blk"]).join(coded, ["id", "blk"])
    near = (8 * F.col("n") <= F.col("bits") + 64) & ((8 * F.col("n") >= F.col("bits") - 16) | F.col("raw"))
    return met.select(F.col("id").alias("item_id"), "blk", (F.col("digest") == F.col("again")).alias("same"), near.alias("near_ideal"))


def q143_shipped_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights learned in two passes over each partition's blocks, averaged, shipped, and frozen while blocks are coded and read back."""

    def learn(batches):
        plain = [x for b in batches for x in b.column("block").to_pylist()]
        if plain:
            w = mixing.train_weights(plain[:8], 2)
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(w.size), pa.int32()), "w": pa.array(w.ravel())})

    got = _blocks(spark, sf_dir).mapInArrow(learn, "k int, w long").groupBy("k").agg(F.avg("w").alias("w")).collect()
    weights = np.zeros(3 * 256)
    for r in got:
        weights[r["k"]] = r["w"]
    shared = spark.sparkContext.broadcast(np.rint(weights).astype(np.int64).reshape(3, 256))
    return _roundtrip(spark, sf_dir, 2, lambda width: mixing.Frozen(width, shared.value))


def q145_distortion_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distortion up to which the simple rate of a chain of two states holds, found from eigenvalues."""
    cases = spark.range(1, 25).select(F.lit(2).alias("a"), (F.col("id") / 50).alias("p"))
    return replica.thresholds(cases).select("p", F.round("d_max", 9).alias("d_max"))


def q146_replica_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest ratio over angles for chains of two to four symbols."""
    cases = spark.range(0, 15).select((F.col("id") % 3 + 2).cast("int").alias("a"), (F.expr("id DIV 3 + 1") / 20).alias("p"))
    return replica.margins(cases).select("a", "p", "part", *(F.round(c, 9).alias(c) for c in ("d", "ratio", "angle")), (F.col("ratio") > 1.5).alias("clear"))


QUERIES = {f.__name__: f for f in (q70_codec_roundtrip, q71_archive_sizes, q72_read_verified, q73_tamper_detect, q65c_compressor_costs, q114_lz78_bits, q87_lru_hit_rate, q113_bca_interval,
    q74_cm_roundtrip, q75_hashed_cm_roundtrip, q74b_cm_sizes, q33_two_pass_roundtrip, q33b_two_pass_fallback, q32_auto_width, q76_dictionary_roundtrip, q77_parse_saving, q88_tail_importance, q111_set_ranks, q112_huffman_length, q130_grammar_words, q142_conformance, q143_shipped_weights, q144_block_width_grid, q145_distortion_thresholds, q146_replica_margins)}
QUERIES |= {"q89_stream_event_counts": streams.stream_event_counts, "q90_stream_daily": streams.stream_hourly, "q91_dedupe_sink": streams.dedupe_sink, "q140_stream_block_bits": streams.stream_block_bits, "q141_stream_carried_bits": streams.stream_carried_bits}
ORACLES = {
    "q70_codec_roundtrip": "WITH d AS (SELECT item_id, encode(text) AS b FROM benchmark), k AS (SELECT item_id, b, unnest(range((octet_length(b) + 127) // 128)) AS blk FROM d) SELECT item_id, blk, sha256(b[blk * 128 + 1 : blk * 128 + 128]) AS sha, true AS intact FROM k",
    "q72_read_verified": "SELECT item_id, sha256(encode(text)[101:160]) AS sha, true AS intact FROM benchmark WHERE octet_length(encode(text)) > 100",
    "q73_tamper_detect": "WITH k AS (SELECT unnest(range((octet_length(encode(text)) + 127) // 128)) AS blk FROM benchmark) SELECT blk > 0 AS intact, count(*) AS n FROM k GROUP BY 1",
    "q89_stream_event_counts": "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY event_type",
    "q90_stream_daily": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "q91_dedupe_sink": "SELECT DISTINCT event_id, user_id, event_type FROM events",
}
ORACLES["q74_cm_roundtrip"] = ORACLES["q75_hashed_cm_roundtrip"] = ORACLES["q70_codec_roundtrip"]
ORACLES["q76_dictionary_roundtrip"] = ORACLES["q70_codec_roundtrip"].replace(", true AS intact", "").replace("127", "1023").replace("128", "1024")
ORACLES["q33_two_pass_roundtrip"] = ORACLES["q70_codec_roundtrip"].replace(", true AS intact", "")
ORACLES["q111_set_ranks"] = "SELECT l_partkey, count(DISTINCT l_suppkey) AS n, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS suppliers FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY l_partkey"
ORACLES["q130_grammar_words"] = "SELECT n, CAST(factorial(CAST(2 * n AS INT)) // (factorial(CAST(n AS INT)) * factorial(CAST(n + 1 AS INT))) AS BIGINT) AS words, true AS round_trip FROM (SELECT unnest(range(1, 11)) AS n) t"
ORACLES["q142_conformance"] = "WITH k AS (SELECT item_id, unnest(range((octet_length(encode(text)) + 127) // 128)) AS blk FROM benchmark) SELECT item_id, blk, true AS same, true AS near_ideal FROM k"
ORACLES["q143_shipped_weights"] = ORACLES["q70_codec_roundtrip"]
ORACLES["q140_stream_block_bits"] = duck_sql("""WITH @BYTES, k AS (SELECT doc_id, i // 1024 AS blk, i % 1024 AS p, x FROM bb),
w AS (SELECT doc_id, blk, p, count(*) OVER (PARTITION BY doc_id, blk, x ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM k)
SELECT doc_id, blk, count(*) AS bytes, round(sum(log2(256 + 32 * p) - log2(1 + 32 * c)), 4) AS bits FROM w GROUP BY doc_id, blk""")
ORACLES["q141_stream_carried_bits"] = duck_sql("""WITH @BYTES, w AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS t, row_number() OVER (PARTITION BY source, x ORDER BY doc_id, i) - 1 AS c FROM bb)
SELECT source, round(sum(log2(256 + 32 * t) - log2(1 + 32 * c)), 2) AS bits, count(*) AS bytes FROM w WHERE source IS NOT NULL GROUP BY source""")
ORACLES["q87_lru_hit_rate"] = """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
p AS (SELECT *, lag(i) OVER (PARTITION BY user_id, event_type ORDER BY i) AS j FROM r),
d AS (SELECT p.user_id, p.i, count(DISTINCT b.event_type) AS others FROM p LEFT JOIN r b ON b.user_id = p.user_id AND b.i > p.j AND b.i < p.i WHERE p.j IS NOT NULL GROUP BY p.user_id, p.i)
SELECT p.user_id, count(*) AS requests, CAST(sum(CASE WHEN d.others < 3 THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM p LEFT JOIN d ON p.user_id = d.user_id AND p.i = d.i GROUP BY p.user_id"""
ORACLES["q112_huffman_length"] = """WITH RECURSIVE c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type),
h AS (SELECT user_id, list_sort(list(n)) AS w, CAST(0 AS BIGINT) AS cost FROM c GROUP BY user_id
  UNION ALL SELECT user_id, list_sort(list_append(w[3:], w[1] + w[2])) AS w, cost + w[1] + w[2] AS cost FROM h WHERE len(w) > 1),
k AS (SELECT user_id, count(*) AS symbols, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY user_id)
SELECT k.user_id, symbols, n, round(cost / n, 6) AS mean_bits FROM h JOIN k ON k.user_id = h.user_id WHERE len(w) = 1"""
ORACLES["q114_lz78_bits"] = """WITH RECURSIVE d AS (SELECT item_id, encode(text) AS b FROM benchmark),
k AS (SELECT item_id, b, unnest(range((octet_length(b) + 127) // 128)) AS blk FROM d),
t AS (SELECT item_id, blk, hex(b[blk * 128 + 1 : blk * 128 + 128]) AS h FROM k),
p AS (SELECT item_id, blk, h, CAST(0 AS BIGINT) AS i, [''] AS known, '' AS phrase, CAST(0 AS BIGINT) AS bits FROM t
  UNION ALL SELECT item_id, blk, h, i + 2, CASE WHEN found THEN known ELSE list_append(known, longer) END, CASE WHEN found THEN longer ELSE '' END,
    CASE WHEN found THEN bits ELSE bits + greatest(1, CAST(ceil(log2(len(known))) AS BIGINT)) + 8 END
  FROM (SELECT *, phrase || h[i + 1 : i + 2] AS longer, list_contains(known, phrase || h[i + 1 : i + 2]) AS found FROM p WHERE i < len(h)) s)
SELECT item_id, blk, bits + CASE WHEN phrase = '' THEN 0 ELSE greatest(1, CAST(ceil(log2(len(known))) AS BIGINT)) END AS bits FROM p WHERE i = len(h)"""
ORACLES["q145_distortion_thresholds"] = "SELECT p, round(0.5 * (1 - sqrt(1 - 2 * p) / (1 - p)), 9) AS d_max FROM (SELECT CAST(k AS DOUBLE) / 50 AS p FROM (SELECT unnest(range(1, 25)) AS k) r) t"
