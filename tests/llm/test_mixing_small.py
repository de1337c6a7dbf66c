"""A small source beside a large one still meets its target."""

from pyspark.sql import functions as F

from bytelens.llm import mixing


def test_small_source_beside_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SLOTS", 1000)
    rows = [(i, "w " * 10, "small") for i in range(10)] + [(100 + i, "w " * 2000, "vast") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w")).collect()
    assert len(got) == 2 and all(abs(r["t"] - r["w"]) <= 0.05 * r["w"] for r in got), got
