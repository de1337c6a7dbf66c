import cmath
import math
from itertools import product

import numpy as np
import pytest

from bytelens.operators import replica


@pytest.mark.parametrize("p", [0.005, 0.03, 0.2, 0.45])
def test_threshold_of_two_symbols_is_the_closed_form(p):
    assert replica.simple_up_to(2, p) == pytest.approx(0.5 * (1 - math.sqrt(1 - 2 * p) / (1 - p)), rel=1e-7)


@pytest.mark.parametrize("a", [2, 3, 4])
def test_ratio_against_sums_over_paths(a):
    p, s, b = 0.15, 1.1, a - 1
    d = replica.simple_up_to(a, p) / 2
    e = [d / (b * (1 - d)), d / (b * (1 - d)) * cmath.exp(1j * s)]
    pay = ((b * d * e[1]) + d - b * e[1]) / (b * d * e[1] + d - b)
    t = [[1 - p if i == j else p / b for j in range(a)] for i in range(a)]
    states = list(product(range(a), repeat=3))
    value, grew = {x: 1.0 + 0j for x in states}, 0.0
    for _ in range(60):  # growth of the sum over all paths, step by step
        new = {}
        for x, y, z in states:
            new[x, y, z] = sum(
                t[y][v] * t[z][w] / t[x][u] * (pay if v != u else 1) * (pay.conjugate() if w != u else 1) * value[u, v, w] for u, v, w in states if value[u, v, w]
            )
        grew = max(map(abs, new.values()))
        value = {k: v / grew for k, v in new.items()}
    g = grew * abs((b * d * e[1] + d - b) / (b * d * e[0] + d - b)) ** 2
    assert replica.ratios(a, p, d, np.array([s]))[0] == pytest.approx((1 - g) / (d * (1 - d) * (1 - math.cos(s))), rel=1e-3)


def test_queries_agree_on_thresholds(spark):
    cases = spark.createDataFrame([(2, 0.1), (3, 0.1)], "a int, p double")
    most = {r["a"]: r["d_max"] for r in replica.thresholds(cases).collect()}
    for r in replica.margins(cases, parts=4, angles=8).collect():
        assert r["d"] == pytest.approx(most[r["a"]] * r["part"] / 4) and r["ratio"] > 1
    assert replica.margins(cases.limit(0)).count() == 0
