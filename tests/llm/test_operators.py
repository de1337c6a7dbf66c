"""Every operator against brute force on a small hard fixture: nulls, empties, ties, repeats, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

import corpus_pipeline
from brute import alnum_words, classes, low, space_words
from bytelens.llm import decontaminate, licenses, registry
from bytelens.llm import simhash as simhash_module
from bytelens.llm.html import grow, main_text, LABELLED
from bytelens.llm.mixing import targets
from bytelens.llm.simhash import bit_sliced_links
from bytelens.llm.suffix import suffix_array

import numpy as np

PASSAGE = " ".join(f"word{i}" for i in range(14))
LONG = "the quick brown fox jumps over the lazy dog while rain falls on the old stone bridge near town " * 3
ROWS = [
    (1, LONG, "en", "a"),
    (2, LONG, "en", "a"),
    (3, "Start. " + LONG + " end of it", "en", "b"),
    (4, None, "en", "b"),
    (5, "", None, None),
    (6, "12 34 $$", "de", None),
    (7, "prefix " + PASSAGE + " suffix mehr", "de", "a"),
    (8, "der die das und nicht ein eine Haus " * 400, "de", "c"),
    (9, "Licensed under the GNU General Public License, version 3. MIT license; cc by", "en", "c"),
    (10, "one short", "en", "c"),
    (10, "one short", "en", "c"),
    (11, "İé ẞ mixed\x0bWHITE\tspace ünïcode", "de", "é"),
    (None, "no id here " + LONG, "en", "a"),
    (50, PASSAGE[:-1], None, "a"),
]
BENCH = [(1, PASSAGE), (2, "one short"), (3, None), (4, ""), (None, "quick brown fox"), (5, PASSAGE)]


@pytest.fixture(scope="session")
def here(tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    cols = list(zip(*ROWS))
    extra = {c: ["x"] * len(ROWS) for c in ("size", "fp", "shard", "target", "spans", "lang_pred")}
    pq.write_table(pa.table({"doc_id": pa.array(cols[0], pa.int64()), "text": cols[1], "lang": cols[2], "source": cols[3], "n_chars": pa.array([len(t or "") for t in cols[1]], pa.int64()), **extra}), d / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([b[0] for b in BENCH], pa.int64()), "text": [b[1] for b in BENCH]}), d / "benchmark.parquet")
    rng = np.random.default_rng(3)
    vec = [list(map(float, rng.normal(size=6))) for _ in range(320)]
    vec[7], vec[9], vec[11], vec[13] = None, [1.0, None] * 3, [float("nan")] * 6, [1.0] * 4
    for i in range(200, 260):
        vec[i] = vec[100]
    pq.write_table(pa.table({"vec_id": pa.array(range(320), pa.int64()), "embedding": pa.array(vec, pa.list_(pa.float32())), "score": [0] * 320}), d / "embeddings.parquet")
    pq.write_table(pa.table({"page_id": pa.array([1, 2], pa.int64()), "url": ["u", None], "html": ["<article><p>Hi &amp; bye<p>two", None], "text": ["a", "b"]}), d / "pages.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty(here, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "benchmark", "embeddings", "pages"):
        pq.write_table(pq.read_table(f"{here}/{t}.parquet").slice(0, 0), d / f"{t}.parquet")
    return str(d)


def got(spark, here, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, here).collect()]


def same(rows, expected, keys):
    order = lambda r: str(r)
    assert sorted([tuple(r[k] for k in keys) for r in rows], key=order) == sorted(expected, key=order)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).count() == 0


def test_targets_reshare():
    assert targets([10, 100, 100], [5, 2, 1], 150) == pytest.approx([20, 260 / 3, 130 / 3])
    assert targets([0, 4], [1, 1], 6) == [0, 6]


def test_mix(spark, here):
    rows = got(spark, here, "op1_mix_sources")
    same(rows, [(i, len(space_words(t))) for i, t, _, _ in ROWS], ("doc_id", "size"))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert rows == got(spark, here, "op1_mix_sources") or sorted(map(str, rows)) == sorted(map(str, got(spark, here, "op1_mix_sources")))
    took, want = Counter(), {}
    for r in rows:
        took[r["source"]] += r["taken"]
        want[r["source"]] = r["target"]
    assert sum(want.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    for s, t in want.items():
        assert abs(took[s] - t) <= 0.1 * t + 8


def simhash(t):
    w = space_words(t)
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, here):
    fp = [simhash(t) for _, t, _, _ in ROWS]
    root = list(range(len(fp)))
    for _ in fp:
        for i in range(len(fp)):
            for j in range(len(fp)):
                if (fp[i] ^ fp[j]).bit_count() <= 4:
                    root[i] = min(root[i], root[j])
    least = {}
    for r, (i, *_rest) in zip(root, ROWS):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    same(got(spark, here, "op2_simhash_components"), [(row[0], f"{f:016x}", least.get(r)) for row, f, r in zip(ROWS, fp, root)], ("doc_id", "fingerprint", "component_id"))


@pytest.mark.parametrize("radius", [0, 3, 4, 6, 7])
def test_bit_sliced(radius):
    rng = np.random.default_rng(radius)
    f = rng.integers(0, 2**63, 300, dtype=np.uint64)
    f[100:] = f[rng.integers(0, 100, 200)] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    g = np.sort(rng.integers(0, 4, 300))
    pairs = {(int(a), int(b)) for i, j in bit_sliced_links(f, g, radius, 500) for a, b in zip(i, j)}
    assert pairs == {(i, j) for i in range(300) for j in range(i + 1, 300) if g[i] == g[j] and int(f[i] ^ f[j]).bit_count() <= radius}


def test_top_k(spark, here):
    t = pq.read_table(f"{here}/embeddings.parquet").to_pylist()
    v = {r["vec_id"]: [math.floor(256 * x) for x in r["embedding"]] for r in t if r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"])}
    out = []
    for q in v:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], x)), i) for i, x in v.items() if i != q and len(x) == len(v[q]))[:5]
            out += [(q, k + 1, i, -m) for k, (m, i) in enumerate(s)]
    same(got(spark, here, "op3_top_k"), out, ("query_id", "rank", "vec_id", "score"))


@pytest.mark.parametrize("most", [None, 100])
def test_decontaminate(spark, here, most, monkeypatch):
    if most:  # more than one block: fingerprints meet by shuffle
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", most)
        bench = spark.createDataFrame([*BENCH, (9, " ".join(f"never{i}" for i in range(30)))], "item_id long, text string")
        left = decontaminate.meeting(spark.read.parquet(f"{here}/documents.parquet"), bench)
        assert sorted(str(r["item_id"]) for r in left.collect()) == ["1", "2", "5", "None"]
    out = []
    for i, t, _, _ in ROWS:
        w, hit, items = alnum_words(t), set(), set()
        for item, text in BENCH:
            b = alnum_words(text)
            n = min(10, len(b))
            wins = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    items.add("null" if item is None else str(item))
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    same(got(spark, here, "op4_decontaminate"), out, ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("<html><head><title>x</title></head><body><nav><a href=1>Home</a></nav><article><h1>T</h1><p>One  two<br>three</p><aside>side</aside><p>Les.</p><div class='comments'><p>me too</p></div></article><footer>f</footer>", "T\nOne two three\nLes."),
        ("<body><div class='ad'>buy</div><article><p><b>a &amp; b<br><p>c &lt;d&gt; <script>var t='</p>';</script>e<form>mail</form></article><div>after</div>", "a & b\nc <d> e"),
        ("<article><p>cut off &am", "cut off &am"),
    ],
)
def test_html(page, text):
    assert main_text(page, grow(np.array(LABELLED, float))) == text


def test_html_query(spark, here):
    same(got(spark, here, "op5_html_text"), [(1, "u", "Hi & bye\ntwo", 12), (2, None, "", 0)], ("page_id", "url", "text", "n_chars"))


def test_suffix_array():
    rng = np.random.default_rng(5)
    for _ in range(300):
        s = rng.integers(1, rng.integers(2, 5), rng.integers(0, 60)).tolist() + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_dedup(spark, here):
    docs = [(i, (t or "").encode()) for i, t, _, _ in ROWS]
    first = {}
    for i, b in docs:
        for k in range(len(b) - 49):
            if i is not None:
                first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    out = []
    for i, b in docs:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    same(got(spark, here, "op6_suffix_dedup"), out, ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def test_licences(spark, here):
    rows = {r["doc_id"]: r for r in got(spark, here, "op7_licence_scan")}
    for i, t, _, _ in ROWS:
        w = alnum_words(t)
        hits = [(k, label) for label, p, _ in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(hits))
        assert r["first_word"] == min((k for k, _ in hits), default=None) and r["last_word"] == max((k for k, _ in hits), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert "gpl-3.0" in rows[9]["labels"]


def test_language(spark, here):
    rows = got(spark, here, "op8_language_id")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    same(rows, [(i, held(i)) for i, *_ in ROWS], ("doc_id", "held_out"))
    for r in rows:
        if r["doc_id"] in (4, 5, 6):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "de") and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 3)} == {"en"}


def test_scores(spark, here):
    c = Counter()
    tokens = [(i, space_words(t) + [""]) for i, t, _, _ in ROWS]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    for i, w in tokens:
        if not held(i):
            c.update(w)
    n, v = sum(c.values()), len(c)
    out = [(i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, w in tokens]
    rows = got(spark, here, "op9_lm_scores")
    for r in rows:
        r["base_score"] = round(r["base_score"], 6)
        assert -1e6 < r["score"] < 0
    same(rows, out, ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"))


def test_shards(spark, here):
    rows = got(spark, here, "op10_stratified_shards")
    size = lambda t: len((t or "").encode()) + 16
    same(rows, [(i, size(t), zlib.crc32((t or "").encode())) for i, t, _, _ in ROWS], ("doc_id", "size", "text_crc32"))
    count = Counter(r["shard"] for r in rows)
    assert max(count.values()) - min(count[s] for s in range(40)) <= 1
    for s in count:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(count[s]))


def test_running_sums_over_stretches(spark):
    from pyspark.sql import functions as F

    from bytelens.llm.common import running

    rows = [(s, b * 37, b % 5) for s in ("a", "b") for b in range(700)]
    got = running(spark.createDataFrame(rows, "s string, b long, c long"), ["s"], "b", "c", "before").collect()
    assert {(r["s"], r["b"]): r["before"] for r in got} == {(s, b): sum(c2 for s2, b2, c2 in rows if s2 == s and b2 < b) for s, b, _ in rows}
    one = running(spark.createDataFrame(rows[:700], "s string, b long, c long").drop("s"), [], "b", "c", "before").agg(F.max("before")).first()[0]
    assert one == sum(c for _, _, c in rows[:700]) - rows[699][2]


def test_long_texts_are_cut_in_parts():
    from bytelens.llm import language

    texts = ["ab cd " * 5000, None, "x", "y" * 9000, ""]
    rows, strings = zip(*((r, s) for rs, ss in language.parts(texts, 2000) for r, s in zip(rs.tolist(), ss)))
    for i, t in enumerate(texts):
        assert "".join(s for r, s in zip(rows, strings) if r == i) == (t or "")
    assert max(map(len, strings)) <= 2000


def test_pipeline_keeps_one_of_each_class_of_similar_texts(spark):
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 900, 300)]
        for k in (0, 2, 4, 6, 40, 0):
            w = list(base)
            for at in rng.integers(0, 300, k):
                w[at] = "other"
            texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    want = sorted(set(classes(texts)))
    assert kept == want and len(want) == 24


def test_forest_spans_with_nearest_links():
    rng = np.random.default_rng(2)
    f = rng.integers(0, 2**63, 120, dtype=np.uint64)
    f[40:] = f[rng.integers(0, 40, 80)] ^ (np.uint64(1) << rng.integers(0, 64, 80, dtype=np.uint64))
    f = np.unique(f)
    pairs = [(i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if int(f[i] ^ f[j]).bit_count() <= 5]
    i, j = simhash_module.forests(f, [tuple(np.array(x) for x in zip(*pairs))])
    whole = simhash_module.spanning(len(f), [tuple(np.array(x) for x in zip(*pairs))])
    assert (simhash_module.spanning(len(f), [(i, j)]) == whole).all() and len(i) == len(f) - len(set(whole.tolist()))

    def weight(edges):  # Kruskal
        tree, total = list(range(len(f))), 0
        for d, a, b in sorted((int(f[a] ^ f[b]).bit_count(), a, b) for a, b in edges):
            if tree[a] != tree[b]:
                old, total = tree[b], total + d
                tree = [tree[a] if x == old else x for x in tree]
        return total

    assert weight(zip(i.tolist(), j.tolist())) == weight(pairs)


CLASHES = ("copies", "_id", "_k", "_key", "_copy", "score", "items", "spans", "n_words", "lang_pred", "size", "shard", "grams", "key", "fp", "c", "taken", "__n")


def test_pipeline_leaves_extra_columns_alone(spark, here):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{here}/documents.parquet").drop("size", "fp", "shard", "target", "spans", "lang_pred")
    docs = docs.withColumns({c: F.concat(F.lit(c + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES})
    for _, stage in corpus_pipeline.STAGES:
        columns, types = docs.columns, dict(docs.dtypes)
        docs = stage(spark, docs, here)
        taken = corpus_pipeline.PLACED if stage is corpus_pipeline.shards else ()
        for c in columns:
            if c not in taken:
                assert types[c] == dict(docs.dtypes)[c]
        for r in docs.collect():
            assert all(r[c] == f"{c}:{'none' if r['doc_id'] is None else r['doc_id']}" for c in CLASHES if c not in taken)
    texts = {(i, t) for i, t, _, _ in ROWS}
    assert docs.count() and all((r["doc_id"], r["text"]) in texts for r in docs.collect())


def test_pipeline_rejects_languages_it_has_not_learned(spark):
    rng = np.random.default_rng(4)
    words = {"en": "the river stone bridge was old when rain fell over town and mill".split(), "de": "der alte fluss stand lange still und die stadt schlief nicht".split()}
    rows = [(i, " ".join(rng.choice(words[lang], 120)), lang, "a", 0) for i, lang in enumerate(["en", "de"] * 20)]
    rows += [(100 + i, " ".join("".join(rng.choice(list("qxzvkjw"), 6)) for _ in range(90)), None, "a", 0) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()) == list(range(40))


def test_pipeline(spark, here, empty):
    docs = spark.read.parquet(f"{here}/documents.parquet")
    kept = [None]
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, here)
        assert docs.columns == spark.read.parquet(f"{here}/documents.parquet").columns
        kept.append(sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=str))
    assert set(kept[1]).isdisjoint({4, 5, 6})
    assert 2 not in kept[2] and 1 in kept[2] and kept[2].count(10) <= 1
    assert set(kept[3]).isdisjoint({7, 10}) and {8, 11} <= set(kept[3])
    assert set(kept[4]) <= set(kept[3])
    out = corpus_pipeline.run(spark, here)
    assert out.count() == len(kept[4])
    assert {"text", "source", "shard", "slot"} <= set(out.columns) and out.filter("text IS NULL").count() == 0
    count = Counter(r["shard"] for r in out.select("shard").collect())
    assert max(count.values()) - min(count[s] for s in range(40)) <= 1
    assert out.select("shard", "slot").distinct().count() == out.count()
    assert corpus_pipeline.run(spark, empty).count() == 0
