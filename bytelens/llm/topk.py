"""Exact top-k inner-product search with M-trees searched best first (operator 3).

Vectors are quantised to integers and lifted by one component so that all have the same length; then the
larger an inner product, the smaller the Euclidean distance, and a metric index applies. Rows are dealt
to groups of about ``GROUP``; each group is an M-tree of two levels (routing objects, and leaf pages with centre, covering radius
and distance to their parent). A page's distance is first bounded by triangle inequality from the stored parent
distance, so most centres are never compared; each query takes its pages in order of that bound and stops at
the first one beyond its k-th best. Queries come in blocks of about ``BLOCK``; each block meets each group
once, and the groups' best are merged. Scores are exact integers; bounds carry a margin for rounding.

Defined cases: null vectors, vectors with null or non-finite components and rows without vec_id take no part;
a query meets only vectors of its own length, never rows with its own vec_id; a query row that repeats counts once,
candidate rows that repeat count each; ties go to the smaller vec_id; empty tables give no rows; other columns are ignored;
a score beyond 64 bits is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

GROUP = 8192
BLOCK = 8192
PAGE = 128
FAN = 12
SCALE = 256


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
    big = float(np.abs(x.astype(float)).max()) if x.size else 0.0
    return x.astype(float) if big * big * max(1, dim) < 2**52 else x.astype(object)


class MTree:
    """Routing objects over leaf pages of rows sorted by id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, page: int = PAGE, fan: int = FAN):
        self.exact = x
        f = x.astype(float)
        norm = (f * f).sum(axis=1)
        self.reach = float(norm.max()) if len(f) else 0.0
        self.lift = np.column_stack([f, np.sqrt(np.maximum(self.reach - norm, 0))])
        self.ids = ids
        self.pages: list[np.ndarray] = []
        parents, owner = [], []
        for rows in self._split(np.arange(len(ids)), fan):
            parents.append(self._centre(rows))
            todo = [rows]
            while todo:
                r = todo.pop()
                if len(r) <= page:
                    self.pages.append(r[np.argsort(ids[r], kind="stable")])
                    owner.append(len(parents) - 1)
                else:
                    todo += self._split(r, 2)
        self.parents = np.array(parents).reshape(len(parents), -1)
        self.owner = np.array(owner, np.int64)
        self.centres = np.array([self._centre(r) for r in self.pages])
        self.radius = np.array([np.sqrt(((self.lift[r] - c) ** 2).sum(axis=1).max()) for r, c in zip(self.pages, self.centres)])
        self.to_parent = np.sqrt(((self.centres - self.parents[self.owner]) ** 2).sum(axis=1))

    def _centre(self, rows: np.ndarray) -> np.ndarray:
        """The row next to the mean: routing objects are rows."""
        x = self.lift[rows]
        return x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin()]

    def _split(self, rows: np.ndarray, parts: int) -> list[np.ndarray]:
        """By the nearest of far-apart rows; evenly where all rows are alike."""
        x = self.lift[rows]
        far = ((x - x[0]) ** 2).sum(axis=1)
        seeds = [x[far.argmax()]]
        dist = ((x - seeds[0]) ** 2).sum(axis=1)
        near = np.zeros(len(rows), np.int64)
        while len(seeds) < parts and dist.max() > 0:
            seeds.append(x[dist.argmax()])
            d = ((x - seeds[-1]) ** 2).sum(axis=1)
            near[d < dist] = len(seeds) - 1
            dist = np.minimum(dist, d)
        if len(seeds) == 1:
            return [r for r in np.array_split(rows, parts) if len(r)]
        return [rows[near == i] for i in range(len(seeds)) if (near == i).any()]

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vec_id, score) of each query's k best here."""
        n, exact_type = len(q), object if object in (q.dtype, self.exact.dtype) else float
        f = np.column_stack([q.astype(float), np.zeros(len(q))])
        own = (f * f).sum(axis=1)
        margin = 1e-7 * (1 + np.sqrt(own + self.reach))

        def distance(rows, to):
            return np.sqrt(np.maximum(own[rows, None] + (to * to).sum(axis=1) - 2 * (f[rows] @ to.T), 0))

        every = np.arange(n)
        bound = np.abs(distance(every, self.parents)[:, self.owner] - self.to_parent) - self.radius
        order = np.argsort(bound, axis=1, kind="stable")
        score = np.full((n, k), -np.inf, exact_type)
        found = np.full((n, k), np.iinfo(np.int64).max)

        def worst(rows):
            """Distance of the k-th best; infinite while there are fewer."""
            s = score[rows, -1].astype(float)
            return np.where(s == -np.inf, np.inf, np.sqrt(np.maximum(own[rows] + self.reach - 2 * np.where(s == -np.inf, 0, s), 0)))

        active = every
        for t in range(len(self.pages)):
            nearest = order[active, t]
            active = active[bound[active, nearest] <= worst(active) + margin[active]]
            if not len(active):
                break
            nearest = order[active, t]
            for p in np.unique(nearest):
                rows = active[nearest == p]
                rows = rows[distance(rows, self.centres[p : p + 1])[:, 0] - self.radius[p] <= worst(rows) + margin[rows]]
                if not len(rows):
                    continue
                members = self.pages[p]
                got = q[rows].astype(exact_type) @ self.exact[members].T.astype(exact_type)
                got = np.where(self.ids[members][None, :] == q_ids[rows][:, None], -np.inf, got)
                useful = (got >= score[rows, -1:]).any(axis=1)
                rows, got = rows[useful], got[useful]
                if not len(rows):
                    continue
                s = np.concatenate([score[rows], got], axis=1)
                i = np.concatenate([found[rows], np.broadcast_to(self.ids[members], got.shape)], axis=1)
                best = np.lexsort((i, -s), axis=-1)[:, :k]
                score[rows], found[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
        r, c = np.nonzero(score != -np.inf)
        return r, found[r, c], score[r, c]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of both sides' (vec_id, embedding)."""
    x = F.col("embedding")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long"))

    def prepared(d: DataFrame) -> DataFrame:
        d = d.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(usable).filter(F.size(x) > 0)
        return d.select(F.col("vec_id").cast("long").alias("vec_id"), F.size(x).alias("dim"), whole.alias("v"))

    rows, asked = prepared(vectors), prepared(queries).dropDuplicates(["vec_id", "v"])
    groups = max(1, -(-rows.count() // GROUP))
    blocks = max(1, -(-asked.count() // BLOCK))
    one = F.xxhash64("vec_id")
    rows = rows.withColumn("g", F.pmod(one, F.lit(groups)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("b", F.pmod(one, F.lit(blocks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def search(key, left, right):
        out = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())}
        if left.num_rows and right.num_rows:
            dim = key[0].as_py()
            ids, q_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            r, i, s = MTree(ids, _matrix(left.column("v"), dim)).search(q_ids, _matrix(right.column("v"), dim), k)
            if any(abs(int(v)) >= 1 << 63 for v in s):
                raise OverflowError("a score does not fit 64 bits")
            out = {"query_id": pa.array(q_ids[r]), "vec_id": pa.array(i), "score": pa.array([int(v) for v in s], pa.int64())}
        return pa.table(out)

    cell = ["dim", "g", "b"]
    some = rows.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return some.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


ORACLE = {
    "op3_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
