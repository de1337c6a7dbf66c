import itertools
import math

import duckdb
import numpy as np
import pytest

from bytelens.functions.dialect import TABLES
from bytelens.operators import enumerative as e
from bytelens.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def test_ranks_count_the_sets():
    sets = sorted((list(s) for s in itertools.combinations(range(8), 3)), key=lambda s: s[::-1])
    assert [e.rank(s) for s in sets] == list(range(56))
    assert [e.unrank(i, 3) for i in range(56)] == sets
    assert e.unrank(e.rank([5, 900, 10**9]), 3) == [5, 900, 10**9] and e.unrank(0, 0) == []


def test_huffman():
    assert e.huffman_length([3]) == 0 and e.huffman_length([]) == 0
    assert e.huffman_length([4, 2, 1, 1]) == 1.75


def test_lru_miss_rate():
    assert e.lru_miss_rate(np.ones(10), 10) == 0
    assert abs(e.lru_miss_rate(np.ones(1000), 250) - 0.75) < 1e-6


def test_tail_against_enumeration(spark):
    p, n, rate = [0.5, 0.3, 0.2], 12, 2.0
    exact = 0.0
    for a in range(n + 1):
        for b in range(n + 1 - a):
            k = (a, b, n - a - b)
            if -sum(c * math.log2(x) for c, x in zip(k, p)) >= rate * n - 1e-9:
                exact += math.factorial(n) / math.prod(map(math.factorial, k)) * math.prod(x**c for x, c in zip(p, k))
    got = e.tail_probability(spark, p, n, rate, 4000).first()["tail"]
    assert abs(got / exact - 1) < 0.1


@pytest.mark.parametrize("name", ["q13_cmi_chunk_boot", "q80_kt_codelength_types", "q102_cooccurrence_edges", "q103_embedding_bit_tc", "q110_zipf_weights", "q115_sum_order_invariance", "q111_set_ranks"])
def test_against_duckdb(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = c.sql(catalogue.ORACLES[name])
    got = catalogue.QUERIES[name](spark, SMALL).select(*want.columns).collect()
    same = lambda rows: sorted((tuple(round(float(v), 6) if isinstance(v, (int, float)) else v for v in r) for r in rows), key=str)
    assert same(got) == same(want.fetchall())
    assert len(got)
