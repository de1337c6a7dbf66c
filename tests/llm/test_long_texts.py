"""One text of over a megabyte, most of it again in a second document, through every query on documents."""

import pyarrow as pa
import pyarrow.parquet as pq
import numpy as np
import pytest

import corpus_pipeline
from brute import alnum_words, space_words
from bytelens.llm import registry


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("long")
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(20000)]
    text = " ".join(words[i] for i in rng.integers(0, len(words), 230_000))
    texts = [text, text[: len(text) // 2] + " and its own end", "short text of its own", None]
    documents = {"doc_id": [1, 2, 3, 4], "text": texts, "lang": ["en", "en", "en", None], "source": ["a", "a", "b", None], "n_chars": [len(t or "") for t in texts]}
    pq.write_table(pa.table(documents), d / "documents.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [" ".join(text.split(" ")[200_000:200_015])]}), d / "benchmark.parquet")
    return str(d), texts


def got(spark, folder, name):
    return {r["doc_id"]: r for r in registry.QUERIES[name](spark, folder).collect()}


def test_queries(spark, folder):
    folder, texts = folder
    long, half = texts[0], len(texts[0]) // 2
    spaced, alnum = ({i + 1: len(f(t)) for i, t in enumerate(texts)} for f in (space_words, alnum_words))
    assert {i: r["size"] for i, r in got(spark, folder, "op1_mix_sources").items()} == spaced
    assert len({r["component_id"] for r in got(spark, folder, "op2_simhash_components").values()}) >= 3
    marked = got(spark, folder, "op4_decontaminate")
    assert {i: r["n_words"] for i, r in marked.items()} == alnum and [marked[i]["n_hit"] for i in (1, 2, 3, 4)] == [15, 0, 0, 0]
    left = got(spark, folder, "op6_suffix_dedup")
    assert left[1]["n_removed"] == 0 and left[2]["n_bytes"] == len(texts[1])
    # a byte or two of the end may happen to go on as the long text does
    assert half <= left[2]["n_removed"] <= half + 5 and left[2]["n_spans"] == 1
    assert {i: r["n_words"] for i, r in got(spark, folder, "op7_licence_scan").items()} == alnum
    assert [got(spark, folder, "op8_language_id")[i]["lang_pred"] for i in (1, 4)] == ["en", "und"]
    assert {i: r["n_tokens"] for i, r in got(spark, folder, "op9_lm_scores").items()} == {i: n + 1 for i, n in spaced.items()}
    assert got(spark, folder, "op10_stratified_shards")[1]["size"] == len(long) + 16


def test_pipeline(spark, folder):
    folder, texts = folder
    rows = corpus_pipeline.run(spark, folder).collect()
    # the first holds the benchmark's passage; the second shares less than 0.8 of its shingles with it
    assert {r["doc_id"] for r in rows} == {2, 3} and all(r["text"] == texts[r["doc_id"] - 1] for r in rows)
