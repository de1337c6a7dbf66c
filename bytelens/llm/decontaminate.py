"""Benchmark decontamination by winnowing (operator 4).

Words are hashed; of every ``WINDOW - K + 1`` neighbouring K-grams the ones with the smallest hash are
kept, so any ``WINDOW`` words that a document shares with an item hold a kept K-gram at the same place
of both. Kept K-grams of the documents are looked up among those of the items, and each meeting is
extended along its diagonal to all runs of equal words; runs of ``WINDOW`` words or more are hits. Items
shorter than a window are one window: all their words, looked up by one hash of all.

A benchmark of up to ``BLOCK_BYTES`` of text is indexed as one block and broadcast: a broadcast join of the fingerprints. Of a larger one the kept
K-grams are first joined, by shuffle, with those of the documents, and only items that met (and items shorter than a window) are indexed, in blocks of
``BLOCK_BYTES`` at most, of which a worker holds one at a time. Documents themselves are never shuffled.

Defined cases: null texts have no words; an item without words is never hit; a null item_id reads
``null``; equal item_ids count once; document rows are handled one by one (null or repeated ids
do not matter); empty tables on either side give no hits or no rows; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, flat, lowered, mix64, pieces, scratch, span_hashes, table, words

WINDOW = 10
K = 5
BLOCK_BYTES = 8_000_000
_TOP = U(2**64 - 1)


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbouring words (the caller drops those that cross rows)."""
    g = np.zeros(max(0, len(h) - k + 1), U)
    for j in range(k):
        g = g * U(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
    return mix64(g + U(k))


def _kept(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the K-grams that are smallest in some window."""
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, U)
    g = _grams(h, K)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # words from here to the row's end
    span = window - K + 1
    m = g[: n - window + 1].copy()
    for j in range(1, span):
        np.minimum(m, g[j : j + len(m)], out=m)
    whole = left[: len(m)] >= window
    keep = np.zeros(len(g), bool)
    for j in range(span):
        keep[j : j + len(m)] |= whole & (g[j : j + len(m)] == m)
    at = np.flatnonzero(keep)
    return at, g[at]


class Index:
    """Kept K-grams of a block of items and the items' words."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        self.ids, self.window = ids, window
        data, off = flat(pa.array(texts, pa.large_string()))
        data = lowered(data)
        starts, ends, self.first = words(data, off, True)
        self.h = span_hashes(data, starts, ends)
        size = np.diff(self.first)
        at, g = _kept(self.h, self.first, window)
        order = np.argsort(g, kind="stable")
        self.g, self.at = g[order], at[order]
        self.item_of = np.repeat(np.arange(len(ids)), size)
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in sorted({int(s) for s in size if 0 < s < window}):
            which = np.flatnonzero(size == k)
            key = _grams(self.h, k)[self.first[which]]
            order = np.argsort(key, kind="stable")
            self.short[k] = (key[order], which[order])

    def find(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, set[tuple[int, int]]]:
        """Which words are hit, and the (row, item) pairs that met."""
        n = len(h)
        step, met = np.zeros(n + 1, np.int64), set()
        row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        at, g = _kept(h, first, self.window)
        lo, hi = np.searchsorted(self.g, g, "left"), np.searchsorted(self.g, g, "right")
        some = np.flatnonzero(hi > lo)
        if len(some):
            times = (hi - lo)[some]
            p = np.repeat(at[some], times)
            q = self.at[np.repeat(lo[some] - np.cumsum(times) + times, times) + np.arange(times.sum())]
            item = self.item_of[q]
            diagonal = p - (q - self.first[item])  # where the item's word 0 would stand
            for row, it, d in np.unique(np.stack([row_of[p], item, diagonal]), axis=1).T.tolist():
                a, b = max(first[row], d), min(first[row + 1], d + self.first[it + 1] - self.first[it])
                same = np.zeros(b - a + 2, bool)
                same[1:-1] = h[a:b] == self.h[self.first[it] + a - d : self.first[it] + b - d]
                turn = np.flatnonzero(same[1:] != same[:-1])
                for x, y in zip(turn[::2].tolist(), turn[1::2].tolist()):
                    if y - x >= self.window:
                        step[a + x] += 1
                        step[a + y] -= 1
                        met.add((row, it))
        for k, (keys, which) in self.short.items():
            if n < k:
                continue
            key = _grams(h, k)
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            ok = np.flatnonzero((hi > lo) & (row_of[: len(key)] == row_of[k - 1 :]))
            step[:-1] += np.bincount(ok, minlength=n)[:n]
            step -= np.bincount(ok + k, minlength=n + 1)[: n + 1]
            times = (hi - lo)[ok]
            item = which[np.repeat(lo[ok] - np.cumsum(times) + times, times) + np.arange(times.sum())]
            pairs = np.unique(np.stack([np.repeat(row_of[ok], times), item]), axis=1)
            met.update(zip(*pairs.tolist()))
        return np.cumsum(step[:-1]) > 0, met


def _fingerprints(texts: DataFrame, window: int) -> DataFrame:
    """(id, g): the kept K-grams of each row's text; g is null for a text of fewer words than a window."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                data, off = flat(part.column("text"))
                data = lowered(data)
                starts, ends, first = words(data, off, True)
                at, g = _kept(span_hashes(data, starts, ends), first, window)
                row = np.searchsorted(first, at, side="right") - 1
                pairs = np.unique(np.stack([row.astype(U), g]), axis=1)
                short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < window))
                ids = part.column("id").take(pa.array(np.concatenate([pairs[0].astype(np.int64), short])))
                grams = pa.concat_arrays([pa.array(pairs[1].view(np.int64)), pa.nulls(len(short), pa.int64())])
                yield pa.RecordBatch.from_arrays([ids, grams], ["id", "g"])

    return texts.mapInArrow(run, "id long, g long")


def meeting(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The items that share a kept K-gram with a document, and those shorter than a window."""
    key = F.xxhash64("item_id", "text")
    items = _fingerprints(bench.select(key.alias("id"), "text"), window)
    seen = _fingerprints(docs.select(F.lit(0).cast("long").alias("id"), "text"), window).select("g").distinct()
    some = items.join(seen, "g").select("id").unionAll(items.filter("g IS NULL").select("id")).distinct()
    return bench.withColumn("_key", key).join(some.withColumnRenamed("id", "_key"), "_key").drop("_key")


def extent(bench: DataFrame) -> tuple[int, int]:
    """Bytes of text and rows."""
    r = bench.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return r["b"] or 0, r["n"]


def index_blocks(bench: DataFrame, window: int = WINDOW):
    """The benchmark's index in blocks of bounded size, each made from its own small collect."""
    size, items = extent(bench)
    blocks = max(1, -(-size // BLOCK_BYTES), -(-items // 1_000_000))
    pick = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        rows = bench.filter(pick == k) if blocks > 1 else bench
        got = rows.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text").collect()
        yield Index([r["i"] for r in got], [r["text"] for r in got], window)


def mark(docs: DataFrame, bench: DataFrame, keep: list[str], window: int = WINDOW) -> DataFrame:
    """``keep`` columns with n_words, spans (hit words as [from, to)), and items (sorted ids)."""
    spark = docs.sparkSession
    if extent(bench)[0] > BLOCK_BYTES:
        bench = scratch(meeting(docs, bench.select("item_id", "text"), window), "benchmark")
    shared = [spark.sparkContext.broadcast(x) for x in index_blocks(bench, window)]
    keep = [c for c in dict.fromkeys(keep) if c not in ("n_words", "spans", "items")]
    d = docs.select(*dict.fromkeys([*keep, "text"]))
    more = "n_words long, spans array<struct<`from`:long,`to`:long>>, items array<string>"
    schema = d.select(*keep).schema
    for f in spark.createDataFrame([], more).schema:
        schema = schema.add(f)
    span_type = pa.struct([("from", pa.int64()), ("to", pa.int64())])

    def scan(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                data, off = flat(part.column("text"))
                data = lowered(data)
                starts, ends, first = words(data, off, True)
                h = span_hashes(data, starts, ends)
                hit, items = np.zeros(len(h), bool), [set() for _ in range(part.num_rows)]
                for s in shared:
                    index = s.value
                    found, met = index.find(h, first)
                    hit |= found
                    for row, it in met:
                        items[row].add(index.ids[it])
                    if len(shared) > 1:  # hold one block at a time
                        vars(s).pop("_value", None)
                spans = [[] for _ in items]
                if hit.any():
                    for row in np.unique(np.repeat(np.arange(len(items)), np.diff(first))[hit]).tolist():
                        x = np.zeros(first[row + 1] - first[row] + 2, bool)
                        x[1:-1] = hit[first[row] : first[row + 1]]
                        turn = np.flatnonzero(x[1:] != x[:-1]).tolist()
                        spans[row] = [{"from": a, "to": b} for a, b in zip(turn[::2], turn[1::2])]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in keep],
                        pa.array(np.diff(first), pa.int64()),
                        pa.array(spans, pa.list_(span_type)),
                        pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                    ],
                    [*keep, "n_words", "spans", "items"],
                )

    return d.mapInArrow(scan, schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE = {
    "op4_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i+1:i+least(len(w), 10)], ' ') AS g
  FROM (SELECT *, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
g AS (SELECT doc_id, k, i, array_to_string(w[i+1:i+k], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(greatest(len(w) - k + 1, 0))) AS i FROM d, ks)),
m AS (SELECT g.doc_id, g.i, g.k, win.item_id FROM g JOIN win ON g.k = win.k AND g.g = win.g),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
}
