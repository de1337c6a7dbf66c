"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame;
``run`` writes each result as Parquet in the shared folder and reads it again. Decisions are made on
narrow rows keyed by doc_id and a 64-bit hash of the text and brought back to the documents by one join; rows that agree in
both are interchangeable.

Defined cases: a null text or one without letters is rejected by the first stage; null ids are ids like any other, last in order; rows
that agree in id and text count as often as they stand in shards, are one row after the near-duplicate stage, and share the copies of the
mixture; ties go to the smaller doc_id; an empty table passes through empty; extra columns of any name are kept as they are, also in the
last stage, whose own columns take the place of those with the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytelens.llm import decontaminate, language, mixing, sharding, simhash
from bytelens.llm.common import scratch, table

#: A prediction below this posterior is rejected, as is a text without letters.
LEAST_POSTERIOR = 0.5
#: What a text's n-grams may be less likely than those of its language's own texts, in nats an n-gram, and n-grams that a text must have to be judged by it.
MOST_STRANGE, LEAST_GRAMS = 2.25, 300
#: What the last stage adds.
PLACED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _masked(docs: DataFrame, *plain: str) -> DataFrame:
    """``docs`` with every column but ``plain`` under a name that no operator uses."""
    return docs.toDF(*(c if c in plain else f"__column_{i}" for i, c in enumerate(docs.columns)))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__key", F.xxhash64("text"))


def _chosen(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents as often as (doc_id, __key, copies, several) says; ``several``: rows may agree in both, and one of them counts."""
    d = _keyed(_masked(docs, "doc_id", "text"))
    w = wanted.select(F.col("doc_id").alias("__id"), F.col("__key").alias("__k"), F.col("copies").alias("__copies"), F.col("several").alias("__several"))
    found = d.join(w, d["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")))
    found = found.filter(~F.col("__several")).unionAll(found.filter("__several").dropDuplicates(["doc_id", "__key"]))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    return found.withColumn("__copy", times).select(*_masked(docs, "doc_id", "text").columns).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters, without a clear language, or unlike the texts of every language that was learned."""
    d = _masked(docs, "text", "lang")
    found = language.predict(d, language.train(d), d.columns)
    strange = (F.col("grams") >= LEAST_GRAMS) & (F.col("strangeness") > MOST_STRANGE)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_POSTERIOR) & ~strange).select(*d.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-duplicates."""
    texts = simhash.similar_documents(docs)
    first = texts.groupBy("root").agg(F.min(F.struct("first", "key", "rows")).alias("x"))
    first = first.select(F.col("x.first.id").alias("doc_id"), F.col("x.key").alias("__key"), F.lit(1).cast("long").alias("copies"), (F.col("x.rows") > 1).alias("several"))
    return _chosen(docs, first)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window."""
    d = _masked(docs, "text")
    marked = decontaminate.mark(d, table(spark, sf_dir, "benchmark"), d.columns)
    return marked.filter(F.size("spans") == 0).select(*d.columns).toDF(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents: each as often, rounded, as the mix takes its words (none: once)."""
    mixed = mixing.mix(_keyed(docs.select("doc_id", "text", "source")), carry=["__key"])
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("long")
    wanted = mixed.select("doc_id", "__key", times.alias("c")).groupBy("doc_id", "__key").agg(F.sum("c").alias("copies"), (F.count(F.lit(1)) > 1).alias("several"))
    return _chosen(docs, wanted.filter("copies > 0"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each with its shard and slot."""
    places = sharding.shard_documents(_keyed(docs.select("doc_id", "text", "source")), n_shards=40, carry=["__key"])
    number = F.row_number()
    p = places.withColumn("__n", number.over(Window.partitionBy("doc_id", "__key").orderBy("shard", "slot")))
    p = p.select(F.col("doc_id").alias("__id"), F.col("__key").alias("__k"), F.col("__n").alias("__m"), *(F.col(c).alias(f"__{c}") for c in PLACED))
    d = _keyed(_masked(docs, "doc_id", "text"))
    d = d.withColumn("__n", number.over(Window.partitionBy("doc_id", "__key").orderBy(F.lit(0))))
    # rows that agree in id and text meet each other's places: as many as the mixture made, so the numbers need no shuffle of their own
    met = d.join(p, d["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")) & (F.abs(F.col("__n") - F.col("__m")) == 0))
    masked = dict(zip(docs.columns, _masked(docs, "doc_id", "text").columns))
    rest = [F.col(masked[c]).alias(c) for c in docs.columns if c not in (*PLACED, "doc_id")]
    return met.select("doc_id", *(F.col(f"__{c}").alias(c) for c in PLACED), *rest)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: Naive Bayes over hashed n-grams and hashed fingerprints have no DuckDB equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
