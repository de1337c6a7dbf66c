"""Resampling and replay that need ordered or repeated passes: BCa intervals, LRU replay."""

from __future__ import annotations

import time
from collections import OrderedDict
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

N = NormalDist()


def bca(values: np.ndarray, resamples: int = 2000, level: float = 0.95, seed: int = 1) -> tuple[float, float, str]:
    """Bias-corrected accelerated interval of the mean; percentile or degenerate where that is undefined."""
    v = np.sort(np.asarray(values, float))
    if len(v) == 0:
        return float("nan"), float("nan"), "empty"
    if v[0] == v[-1]:
        return float(v[0]), float(v[0]), "degenerate"
    rng = np.random.default_rng(seed)
    stats = np.sort(np.array([v[rng.integers(0, len(v), len(v))].mean() for _ in range(resamples)]))
    mean, tail = v.mean(), (1 - level) / 2
    share = (np.sum(stats < mean) + 0.5 * np.sum(stats == mean)) / resamples
    loo = (v.sum() - v) / (len(v) - 1)
    d = loo.mean() - loo
    spread = (d**2).sum() ** 1.5
    if not 0 < share < 1 or spread == 0:
        return float(np.quantile(stats, tail)), float(np.quantile(stats, 1 - tail)), "percentile"
    z, a = N.inv_cdf(share), (d**3).sum() / (6 * spread)
    ends = [N.cdf(z + (z + q) / (1 - a * (z + q))) for q in (N.inv_cdf(tail), N.inv_cdf(1 - tail))]
    return float(np.quantile(stats, ends[0])), float(np.quantile(stats, ends[1])), "bca"


def bca_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """One interval a group; a group's values must fit a task (measurements, not corpora)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi, how = bca(pdf[value].dropna().to_numpy())
        return pd.DataFrame({key: [pdf[key].iloc[0]], "lo": [lo], "hi": [hi], "method": [how]})

    return df.select(key, value).groupBy(key).applyInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, lo double, hi double, method string")


def time_under_repetition(run, repeats: int = 5, warmup: int = 1, resamples: int = 1000, seed: int = 0) -> dict:
    """Seconds of each measured call after some that are not, their mean, and a percentile interval of the mean."""
    if repeats < 2:
        raise ValueError("an interval needs two calls at least")
    for _ in range(warmup):
        run()
    times = np.empty(repeats)
    for k in range(repeats):
        began = time.perf_counter()
        run()
        times[k] = time.perf_counter() - began
    means = times[np.random.default_rng(seed).integers(0, repeats, (resamples, repeats))].mean(axis=1)
    lo, hi = np.quantile(means, [0.025, 0.975])
    return {"times": times.tolist(), "mean": float(times.mean()), "lo": float(lo), "hi": float(hi)}


def lru_hits(requests: list[int], capacity: int) -> int:
    cache: OrderedDict[int, None] = OrderedDict()
    hits = 0
    for r in requests:
        if r in cache:
            hits += 1
            cache.move_to_end(r)
        else:
            cache[r] = None
            if len(cache) > capacity:
                cache.popitem(last=False)
    return hits


def lru_replay(df: DataFrame, key: str, order: str, item: str, capacity: int) -> DataFrame:
    """Hits of each key's ordered requests under least-recently-used replacement."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values(order)[item].tolist()
        return pd.DataFrame({key: [pdf[key].iloc[0]], "requests": [len(r)], "hits": [lru_hits(r, capacity)]})

    return df.select(key, order, item).groupBy(key).applyInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, requests long, hits long")
