"""Enumerative coding, prefix codes, cache approximation and rare events: kernels and their distributed forms."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rank(members: list[int]) -> int:
    """Place of a set of distinct integers among sets of its size, colexicographic."""
    return sum(math.comb(x, k + 1) for k, x in enumerate(sorted(members)))


def unrank(place: int, size: int) -> list[int]:
    out = []
    for k in range(size, 0, -1):
        low, high = k - 1, k
        while math.comb(high, k) <= place:
            low, high = high, 2 * high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if math.comb(mid, k) <= place else (low, mid)
        out.append(low)
        place -= math.comb(low, k)
    return out[::-1]


def set_ranks(df: DataFrame, key: str, member: str) -> DataFrame:
    """(key, size, place, back): the set of each key's members as one number, and the set read back."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members = sorted(int(x) for x in pdf[member].iloc[0])
        place = rank(members)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "size": [len(members)], "place": [str(place)], "back": [unrank(place, len(members))]})

    kind = df.schema[key].dataType.simpleString()

    def each(parts):
        for p in parts:
            if len(p):
                yield pd.concat([run(p.iloc[i : i + 1]) for i in range(len(p))])

    sets = df.filter(F.col(member).isNotNull()).groupBy(key).agg(F.collect_set(member).alias(member))
    return sets.mapInPandas(each, f"{key} {kind}, size long, place string, back array<long>")


def huffman_length(weights) -> float:
    """Mean length of an optimal prefix code; a single symbol takes no bits."""
    heap = [float(w) for w in weights if w > 0]
    total, cost = sum(heap), 0.0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost / total if total else 0.0


def huffman_by(df: DataFrame, key: str, symbol: str) -> DataFrame:
    """(key, symbols, n, mean_bits) from counts aggregated before the shuffle to keys; an alphabet must fit a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [pdf[key].iloc[0]], "symbols": [len(pdf)], "n": [int(pdf["n"].sum())], "mean_bits": [huffman_length(pdf["n"])]})

    counts = df.groupBy(key, symbol).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).applyInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, symbols long, n long, mean_bits double")


def lru_miss_rate(weights: np.ndarray, capacity: int) -> float:
    """Characteristic-time approximation of a least-recently-used cache under independent requests."""
    p = np.asarray(weights, float) / np.sum(weights)
    if capacity >= len(p):
        return 0.0
    low, high = 0.0, 1.0
    while np.sum(-np.expm1(-high * p)) < capacity:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.sum(-np.expm1(-mid * p)) < capacity else (low, mid)
    return float(np.sum(p * np.exp(-high * p)))


def tilted(p: np.ndarray, rate: float) -> tuple[np.ndarray, float, float]:
    """Law with mean code length ``rate`` among p * 2^(t * cost), its t, and the log2 of its normaliser."""
    cost, low, high = -np.log2(p), 0.0, 60.0
    for _ in range(80):
        t = (low + high) / 2
        q = p * 2.0 ** (t * (cost - cost.max()))
        low, high = (t, high) if (q * cost).sum() / q.sum() < rate else (low, t)
    return q / q.sum(), t, math.log2(q.sum()) + t * cost.max()


def tail_probability(spark: SparkSession, p: list[float], steps: int, rate: float, paths: int, seed: int = 1) -> DataFrame:
    """(tail, hits): chance that ``steps`` independent symbols cost ``rate`` bits each or more, by importance sampling.

    Path k draws from its own generator, so the estimate does not depend on partitions.
    """
    law = np.asarray(p, float)
    q, t, norm = tilted(law, rate)
    cost = -np.log2(law)

    def run(parts):
        for x in parts:
            total = np.array([cost[np.random.default_rng([seed, int(k)]).choice(len(q), steps, p=q)].sum() for k in x["id"]])
            yield pd.DataFrame({"w": np.where(total >= rate * steps - 1e-9, 2.0 ** (steps * norm - t * total), 0.0)})

    w = spark.range(paths).mapInPandas(run, "w double")
    return w.agg(F.avg("w").alias("tail"), F.sum((F.col("w") > 0).cast("long")).alias("hits"))


class Grammar:
    """An unambiguous grammar in Chomsky form: counts of words by length, and words as numbers.

    ``pairs``: (symbol, left, right); ``leaves``: (symbol, letter).
    """

    def __init__(self, pairs: list[tuple[str, str, str]], leaves: list[tuple[str, str]], most: int):
        self.pairs, self.leaves = pairs, leaves
        symbols = {s for rule in pairs for s in rule} | {s for s, _ in leaves}
        self.words = {s: [0] * (most + 1) for s in symbols}
        for s, _ in leaves:
            self.words[s][1] += 1
        for n in range(2, most + 1):
            for s, left, right in pairs:
                self.words[s][n] += sum(self.words[left][k] * self.words[right][n - k] for k in range(1, n))

    def unrank(self, symbol: str, n: int, number: int) -> str:
        """The word with a number, in order of rules and of the left part's length."""
        if n == 1:
            return [letter for s, letter in self.leaves if s == symbol][number]
        for s, left, right in self.pairs:
            for k in range(1, n if s == symbol else 1):
                here = self.words[left][k] * self.words[right][n - k]
                if number < here:
                    a, b = divmod(number, self.words[right][n - k])
                    return self.unrank(left, k, a) + self.unrank(right, n - k, b)
                number -= here
        raise IndexError("no such word")

    def rank(self, symbol: str, word: str) -> int | None:
        """The number of a word; None if the symbol does not derive it."""
        known: dict[tuple[str, int, int], int | None] = {}

        def find(s: str, a: int, b: int) -> int | None:
            if (s, a, b) not in known:
                known[s, a, b] = self._rank(s, word, a, b, find)
            return known[s, a, b]

        return find(symbol, 0, len(word))

    def _rank(self, symbol, word, a, b, find):
        if b - a == 1:
            letters = [letter for s, letter in self.leaves if s == symbol]
            return letters.index(word[a]) if word[a] in letters else None
        before = 0
        for s, left, right in self.pairs:
            for k in range(1, b - a if s == symbol else 1):
                others = self.words[right][b - a - k]
                x = find(left, a, a + k) if others and self.words[left][k] else None
                y = find(right, a + k, b) if x is not None else None
                if y is not None:
                    return before + x * others + y
                before += self.words[left][k] * others
        return None


#: Words of matched brackets.
BRACKETS = ([("S", "A", "B"), ("S", "X", "S"), ("S", "Y", "B"), ("S", "Z", "S"), ("X", "A", "B"), ("Y", "A", "S"), ("Z", "Y", "B")], [("A", "("), ("B", ")")])
