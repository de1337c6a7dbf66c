import math
import random

import duckdb
import pytest

from bytelens.operators import codec, mixing, phrases, twopass
from bytelens.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TEXT = b"the cat and the hat and the bat sat on the mat " * 6


@pytest.mark.parametrize("predictor", [mixing.Mixed, mixing.Hashed])
@pytest.mark.parametrize("block", [b"", b"a", bytes(range(256)), random.Random(1).randbytes(150), TEXT])
def test_mixing_round_trip(predictor, block):
    raw, payload = codec.encode_block(block, 4, predictor)
    assert codec.decode_block(raw, payload, len(block), 4, predictor) == block


def test_mixing_is_a_distribution_and_learns():
    m = mixing.Mixed(3)
    first = m.frequencies(b"")
    assert min(first) >= 1 and sum(first) < 1 << 24 and len(first) == 256
    for i, b in enumerate(TEXT):
        m.frequencies(TEXT[max(0, i - 3) : i])
        m.update(TEXT[max(0, i - 3) : i], b)
    f = m.frequencies(b"the"[-3:])
    assert max(range(256), key=f.__getitem__) == 32
    assert len(codec.encode_block(TEXT, 3, mixing.Mixed)[1]) < len(codec.encode_block(TEXT, 3)[1])


def test_squash_and_stretch():
    assert mixing.SQUASH[mixing.LIMIT] == 2047 and (mixing.SQUASH[1:] >= mixing.SQUASH[:-1]).all()
    assert all(mixing.SQUASH[mixing.STRETCH[p] + mixing.LIMIT] >= p for p in range(1, 4096))


def test_model_round_trip_and_strict_parse():
    model = {0: {0: {97: 3, 98: 200}}, 1: {97: {98: 1}, 98: {97: 70000}}}
    data = twopass.serialise(1, model)
    assert twopass.parse(data) == (1, model)
    for bad in (b"", data[:-1], data + b"\0", bytes([0, 1, 5, 1, 97, 1]), bytes([0, 1, 0, 1, 97, 0])):
        with pytest.raises(ValueError):
            twopass.parse(bad)


def pruned(text: bytes, width: int):
    tables = [{} for _ in range(width + 1)]
    for i, b in enumerate(text):
        for o in range(min(i, width) + 1):
            t = tables[o].setdefault(text[i - o : i], {})
            t[b] = t.get(b, 0) + 1
    kept = dict(tables[0])
    for o in range(1, width + 1):
        for ctx, t in tables[o].items():
            up = next(kept[ctx[k:]] for k in range(1, o + 1) if ctx[k:] in kept)
            n, m = sum(t.values()), sum(up.values())
            gain = sum(c * (math.log2((256 + 32 * m) / (1 + 32 * up[b])) - math.log2((256 + 32 * n) / (1 + 32 * c))) for b, c in t.items())
            syms = sorted(t)
            size = sum(len(twopass.varint(x)) for x in [int.from_bytes(ctx, "big"), len(t), *t.values(), *(b - a for a, b in zip([0, *syms], syms))])
            if gain > 8 * size:
                kept[ctx] = t
    return kept


def test_prune_against_brute_force(spark):
    text = (TEXT * 30).decode()
    d = spark.createDataFrame([("x", text), ("y", "é" * 5), ("z", None)], "corpus string, text string")
    got = {}
    for r in twopass.prune(twopass.gram_counts(d, 3), 3).filter("corpus = 'x'").collect():
        got.setdefault(r["ctx"].to_bytes(r["ord"], "big"), {})[r["sym"]] = r["c"]
    want = pruned(text.encode(), 3)
    assert got == want and any(len(c) > 1 for c in want)


@pytest.mark.parametrize("block", [b"", b"a", random.Random(3).randbytes(200), TEXT, TEXT * 8])
def test_phrases(block):
    coded = phrases.encode(block)
    assert phrases.decode(*coded) == block
    one, all_ = phrases.parse_saving(block, coded[0])
    assert all_ <= one + 1e-6
    if block == TEXT * 8:
        assert coded[0] and coded[1] < len(block)


@pytest.mark.parametrize("name", ["q74_cm_roundtrip", "q75_hashed_cm_roundtrip", "q33_two_pass_roundtrip", "q76_dictionary_roundtrip"])
def test_round_trips_against_duckdb(spark, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{SMALL}/benchmark.parquet'")
    want = c.sql(catalogue.ORACLES[name])
    got = catalogue.QUERIES[name](spark, SMALL).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_two_pass_choice(spark):
    r = catalogue.QUERIES["q33b_two_pass_fallback"](spark, SMALL).first()
    assert (r["chosen"] == "two-pass") == (r["two_pass"] < r["one_pass"])
