"""Corpora listed in a manifest: which there are, and where their bytes lie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "name string, `class` string, file string, source_url string, license_note string, qualifies_for array<string>, deferred boolean, bytes long, sha256 string"


class MissingPayload(FileNotFoundError):
    """A corpus has no payload file."""


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a corpus of a JSON manifest (``corpora``: a list of entries); a malformed manifest is an error."""
    whole = spark.read.schema(f"corpora array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return whole.select(F.explode("corpora").alias("c")).select("c.*").withColumn("deferred", F.coalesce("deferred", F.lit(False)))


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(file, path, length) of every file of a folder; bytes are read only when asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", "length")


def corpus_names(manifest: DataFrame, files: DataFrame, include_deferred: bool = False) -> DataFrame:
    """Corpora in order; deferred ones that have no payload are left out unless asked for."""
    there = manifest.join(files.select("file", F.lit(True).alias("there")), "file", "left")
    return (there if include_deferred else there.filter(~F.col("deferred") | F.col("there"))).select("name", "class", "file").orderBy("name")


def payload_path(manifest: DataFrame, files: DataFrame, name: str) -> str:
    """The path of one corpus; an error that says why if there is none."""
    row = manifest.filter(F.col("name") == name).join(files, "file", "left").select("deferred", "path").first()
    if row is None:
        raise KeyError(f"no corpus {name}")
    if row["path"] is None:
        raise MissingPayload(f"{name} is {'deferred' if row['deferred'] else 'missing'}")
    return row["path"]
