"""Queries that SQL cannot express, against their plain Python twins on a table of some hundred documents."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from bytelens.llm import mixing, registry, sharding

import brute

SYLLABLES = {"en": "ka lo mi ren tu sha dor pel vin ost".split(), "de": "grü ze wol tsch ank fe bur himm ach ler".split()}
PASSAGE = " ".join(f"benchword{chr(97 + i)}" for i in range(12))


def made():
    rng = np.random.default_rng(17)
    vocabulary = {g: ["".join(rng.choice(s, rng.integers(1, 4))) for _ in range(700)] for g, s in SYLLABLES.items()}
    rows = []

    def add(text, lang):
        source = ("a", "a", "a", "b", "é", None)[int(rng.integers(0, 6))]
        rows.append((len(rows) * 3 + 1, text, lang, source))

    for base in range(110):
        lang = "en" if base % 3 else "de"
        words = list(rng.choice(vocabulary[lang], int(rng.integers(150, 320))))
        for edits in (0, 0, 2, 4, 60)[: int(rng.integers(1, 6))]:
            w = list(words)
            for at in rng.integers(0, len(w), edits):
                w[at] = str(rng.choice(vocabulary[lang]))
            text = " ".join(w)
            if rng.random() < 0.05:
                text = text[:400] + " " + PASSAGE + " " + text[400:]
            add(text, lang if rng.random() < 0.9 else None)
    for text in (None, "", "12 34 --", "ka lo", "Ka\tLO\x0bmi"):
        add(text, None)
    for _ in range(6):
        add(" ".join("".join(rng.choice(list("qxzvkjw"), 6)) for _ in range(90)), None)
    return rows


ROWS = made()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("brute")
    ids, texts, langs, sources = map(list, zip(*ROWS))
    documents = {"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": langs, "source": sources, "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
    pq.write_table(pa.table(documents), d / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, 2], pa.int64()), "text": [PASSAGE, None]}), d / "benchmark.parquet")
    return str(d)


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 32)
    monkeypatch.setattr(mixing, "RUN", 1 << 10)
    monkeypatch.setattr(sharding, "BUCKET", 32)


def got(spark, folder, name, columns):
    return sorted(tuple(r[c] for c in columns) for r in registry.QUERIES[name](spark, folder).collect())


def test_mix(spark, folder):
    rows = got(spark, folder, "op1_mix_sources", ("doc_id", "size", "source_size", "taken", "target"))
    want = sorted((i, n, s, taken, target) for i, n, s, target, taken in brute.mix([(i, t, s) for i, t, _, s in ROWS], mixing.MAX_SLOTS, mixing.GOLDEN))
    assert [r[:4] for r in rows] == [r[:4] for r in want]
    assert [r[4] for r in rows] == pytest.approx([r[4] for r in want])


def test_shards(spark, folder):
    assert got(spark, folder, "op10_stratified_shards", ("doc_id", "shard", "slot")) == sorted(brute.shard([(i, t, s) for i, t, _, s in ROWS]))


def test_language(spark, folder):
    learned = [(t, g) for i, t, g, _ in ROWS if g is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    want = brute.languages(learned, [r[1] for r in ROWS])
    rows = got(spark, folder, "op8_language_id", ("doc_id", "lang_pred", "score"))
    assert [r[:2] for r in rows] == [(i, g) for (i, *_), (g, *_) in zip(ROWS, want)]
    assert [r[2] for r in rows] == pytest.approx([w[1] for w in want], abs=0.01)
    held = [(g, p) for (i, _, g, _), (_, p, _) in zip(ROWS, rows) if g is not None and zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(g == p for g, p in held)


def test_pipeline(spark, folder):
    want = brute.pipeline(ROWS, [PASSAGE, None], mixing.MAX_SLOTS, mixing.GOLDEN)
    rows = [(r["doc_id"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(rows) == sorted(want)
    assert 100 < len({i for i, *_ in want}) < len(ROWS) - 100
