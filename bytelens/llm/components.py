"""Connected components by alternating large-star and small-star contraction.

Every round is a few joins and aggregations on the edge list and writes it to the shared folder, so
the lineage stays short; nothing is gathered on the driver but counts and the hubs. A hub's edges are reduced to
minima before they meet; a node with over a ``HUB``-th of all edges (there are at most twice ``HUB`` of these) is
joined by broadcast, so that its edges stay where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch

#: A key of over a HUB-th of the rows is joined by broadcast: at most HUB keys can be such.
HUB = 500


def join_unique(rows: DataFrame, unique: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """``rows`` (``total`` of them) joined to ``unique``, whose ``n`` says how many rows have its key; hot keys by broadcast."""
    most = max(16, -(-total // HUB))
    hot = unique.filter(F.col("n") > most)
    found = hot.limit(HUB + 1).collect()
    if not found:
        return rows.join(unique.drop("n"), key)
    assert len(found) <= HUB
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, unique.schema).drop("n"))  # HUB rows at most
    cold = rows.join(hot.select(key), key, "left_anti").join(unique.filter(F.col("n") <= most).drop("n"), key)
    return cold.unionByName(rows.join(hot, key).select(*cold.columns))


def _stamp(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of longs to (node, root): the smallest node that ``node`` reaches; roots are left out.

    Defined cases: loops and repeated pairs do not matter; no pairs give no rows. Rounds go on until nothing changes.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch(e, "edges")
    stamp, last = _stamp(e), None
    while stamp[0] and stamp != last:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_unique(both, low, "u", 2 * stamp[0]).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_unique(large, low, "a", stamp[0]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = scratch(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        last, stamp = stamp, _stamp(e)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
