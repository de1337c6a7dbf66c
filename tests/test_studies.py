import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelens.operators import bytecounts, enumerative, mixing, resample, twopass
from bytelens.sources import manifest
from bytelens.streaming import blocks as streams


def test_manifest(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "a.bin").write_bytes(b"abc")
    entries = [{"name": "b", "class": "text", "file": "b.bin", "deferred": True}, {"name": "a", "class": "text", "file": "a.bin"}, {"name": "c", "class": "control", "file": "c.bin", "deferred": False}]
    (tmp_path / "m.json").write_text(json.dumps({"corpora": entries}, indent=1))
    m, files = manifest.load_manifest(spark, str(tmp_path / "m.json")), manifest.payloads(spark, str(tmp_path / "data"))
    assert [r["name"] for r in manifest.corpus_names(m, files).collect()] == ["a", "c"]
    assert [r["name"] for r in manifest.corpus_names(m, files, include_deferred=True).collect()] == ["a", "b", "c"]
    assert manifest.payload_path(m, files, "a").endswith("a.bin")
    with pytest.raises(manifest.MissingPayload, match="deferred"):
        manifest.payload_path(m, files, "b")
    with pytest.raises(KeyError):
        manifest.payload_path(m, files, "none")


def test_grammar_numbers_its_words():
    g = enumerative.Grammar(*enumerative.BRACKETS, 12)
    assert [g.words["S"][2 * n] for n in range(1, 7)] == [1, 2, 5, 14, 42, 132]
    words = [g.unrank("S", 8, k) for k in range(14)]
    assert len(set(words)) == 14 and [g.rank("S", w) for w in words] == list(range(14))
    assert g.rank("S", "())(") is None


def test_timing():
    got = resample.time_under_repetition(lambda: sum(range(1000)), repeats=4)
    assert len(got["times"]) == 4 and got["lo"] <= got["mean"] <= got["hi"]
    with pytest.raises(ValueError):
        resample.time_under_repetition(lambda: None, repeats=1)


def test_traces_and_shipped_weights():
    block = b"the cat sat on the mat and the cat sat on the hat"
    assert mixing.trace(block, mixing.Mixed(2)) == mixing.trace(block, mixing.Mixed(2))
    assert mixing.trace(block, mixing.Mixed(2))[1] != mixing.trace(block, mixing.Mixed(1))[1]
    weights = mixing.train_weights([block, block], 2, 3)
    assert mixing.trace(block, mixing.Frozen(2, weights))[0] < mixing.trace(block, mixing.Frozen(2, np.full((3, 256), mixing.ONE // 3)))[0]
    sketch = mixing.Hashed(3, 12)
    first = mixing.trace(block * 4, sketch)[0]
    assert first < 8 * len(block * 4) and sketch.rows.nbytes == 2 * 2 * 4 * 4096


def test_kernels_against_plain_python(spark):
    rows = [(1, "abracadabra", "x"), (2, "é" * 5 + "abc", "x"), (3, "", None), (4, None, "y"), (5, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want: dict = {}
    for _, t, s in rows:
        b = (t or "").encode()
        for k in (0, 2):
            for i in range(k, len(b)):
                key = (s, int(i >= len(b) // 2), k, int.from_bytes(b[i - k : i], "big"), b[i])
                want[key] = want.get(key, 0) + 1
    got = bytecounts.counts(docs, "source", [0, 2], "half").groupBy("source", "piece", "k", "ctx", "x").agg(F.sum("c").alias("c")).collect()
    assert {tuple(r)[:5]: r["c"] for r in got} == want
    for r in bytecounts.adaptive(docs, ["doc_id"]).collect():
        b = rows[r["doc_id"] - 1][1].encode()
        bits = kt = 0.0
        for i, x in enumerate(b):
            kt -= np.log2((b[:i].count(x) + 0.5) / (i + 128))
            for k in (2, 1, 0):
                past = [j for j in range(k, i) if b[j - k : j] == b[i - k : i]] if i >= k else []
                if past or k == 0:
                    bits += np.log2(256 + 32 * len(past)) - np.log2(1 + 32 * sum(b[j] == x for j in past))
                    break
        assert (r["b2"], r["kt"]) == pytest.approx((bits, kt))
    lags = {(r["source"], r["lag"]): r for r in bytecounts.lagged(docs, "source").groupBy("source", "lag").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy"))).collect()}
    pairs = [(b[i], b[i - 2]) for b in (rows[0][1].encode(), rows[1][1].encode()) for i in range(2, len(b))]
    assert tuple(lags["x", 2])[2:] == (len(pairs), sum(x for x, _ in pairs), sum(y for _, y in pairs), sum(x * y for x, y in pairs))


def test_state_is_carried_from_batch_to_batch(spark, tmp_path):
    texts = ["abcabc", "aabb", "cccc", "abc"]
    for k, t in enumerate(texts):
        spark.createDataFrame([(k, t, "s")], "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    stream = spark.readStream.schema("doc_id long, text string, source string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = streams.drain(streams.carried_bits(stream, "source", "doc_id"), "carried", "update").collect()
    whole, bits = "", 0.0
    for t in "".join(texts):
        bits += np.log2(256 + 32 * len(whole)) - np.log2(1 + 32 * whole.count(t))
        whole += t
    assert len(got) == 4 and max(got, key=lambda r: r["bytes"])["bits"] == pytest.approx(bits)


@pytest.mark.parametrize("width", [6, 7, 8])
def test_long_contexts(spark, width):
    text = "the same line of text again and again, ünder the same sky; " * 6
    docs = spark.createDataFrame([("c", text)], "corpus string, text string")
    counts = {(r["ord"], r["ctx"] % (1 << 64), r["sym"]): r["c"] for r in twopass.gram_counts(docs, width).collect()}
    b = text.encode()
    want: dict = {}
    for i in range(width, len(b)):
        key = (width, int.from_bytes(b[i - width : i], "big"), b[i])
        want[key] = want.get(key, 0) + 1
    assert {k: c for k, c in counts.items() if k[0] == width} == want
    assert twopass.widest(9_000) == 8 and twopass.widest(20_000_000) == 2 and twopass.widest(10_000_000) == 4
