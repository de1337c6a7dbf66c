import math
import random

import duckdb
import numpy as np
import pytest

from bytelens.functions.dialect import TABLES, duck_sql, spark_sql
from bytelens.operators import codec, resample
from bytelens.plans import catalogue
from bytelens.sources import corpora

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(rows):
    out = []
    for r in rows:
        out.append(tuple(None if v is None else str(v) if isinstance(v, (str, bool)) else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v) for v in r))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_duckdb(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_anchors(spark):
    assert spark_sql(spark, SMALL, catalogue.records.SQL["q22_calib_dup_anchor"]).first()["tc_bpb"] == 1.0
    seed = spark_sql(spark, SMALL, "SELECT @SEED{concat('20260710:boot:x:', CAST(id AS VARCHAR(20)))} AS seed FROM @IDS{1}").first()["seed"]
    assert seed == 2891011492


def test_unknown_macro():
    with pytest.raises(ValueError):
        duck_sql("SELECT @NOPE{1}")


def test_partition_count_does_not_matter(spark):
    plan = catalogue.QUERIES["q02_h0_by_source"]
    one = plain(plan(spark, SMALL).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    assert plain(plan(spark, SMALL).collect()) == one
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("block", [b"", b"a", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", bytes(range(256)), random.Random(1).randbytes(300), b"abracadabra " * 30])
def test_codec_round_trip(block):
    raw, payload = codec.encode_block(block)
    assert codec.decode_block(raw, payload, len(block)) == block
    assert len(payload) <= len(block)


def test_code_length_is_the_sum_of_log_frequencies():
    block = b"the cat and the hat and the bat " * 12
    model, bits = codec.Counts(3), 0.0
    for i, b in enumerate(block):
        freq = model.frequencies(block[max(0, i - 3) : i])
        bits += math.log2(sum(freq) / freq[b])
        model.update(block[max(0, i - 3) : i], b)
    raw, payload = codec.encode_block(block)
    assert not raw and abs(8 * len(payload) - bits) < 32


def test_read_range_spans_blocks_and_stops_short(spark):
    text = "".join(random.Random(2).choice("abc ") for _ in range(700))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    archive = codec.pack(corpora.blocks(d, "doc_id", "text", 256))
    assert bytes(codec.read_range(archive, 200, 200, 256).first()["data"]) == text[200:400].encode()
    assert bytes(codec.read_range(archive, 690, 200, 256).first()["data"]) == text[690:].encode()
    with pytest.raises(ValueError):
        codec.read_range(archive, -1, 2, 256)


def test_blocks(spark):
    d = spark.createDataFrame([(1, "x" * 10), (2, ""), (3, None)], "doc_id long, text string")
    assert [len(r["block"]) for r in corpora.blocks(d, "doc_id", "text", 4).orderBy("blk").collect()] == [4, 4, 2]
    assert corpora.blocks(d, "doc_id", "text", 4, drop_last=True).count() == 2
    with pytest.raises(ValueError):
        corpora.blocks(d, "doc_id", "text", 0)


def test_records_sink(spark, tmp_path):
    d = spark.createDataFrame([("c", "z", 1)], "corpus string, coder string, n int")
    corpora.append_records(d, f"{tmp_path}/log", ("corpus", "coder"))
    corpora.append_records(d, f"{tmp_path}/log", ("corpus", "coder"))
    assert corpora.read_records(spark, f"{tmp_path}/log", "corpus string, coder string, n int").count() == 2
    with pytest.raises(ValueError):
        corpora.append_records(d, f"{tmp_path}/log", ("corpus", "seed"))


def test_bca():
    x = np.random.default_rng(0).normal(5, 1, 200)
    lo, hi, how = resample.bca(x)
    assert lo < x.mean() < hi and how == "bca"
    assert resample.bca(np.ones(5))[2] == "degenerate"


def test_lru():
    assert resample.lru_hits([1, 2, 1, 3, 2, 1], 2) == 1
    assert codec.lz78_bits(b"") == 0
