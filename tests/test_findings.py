"""What reviews of larger and odd inputs found."""

from hashlib import sha256

import duckdb
import numpy as np
import pytest

from bytelens.llm import common, scoring, simhash
from bytelens.operators import bytecounts
from bytelens.plans import catalogue
from bytelens.streaming import blocks


def test_q12_sends_texts_and_not_bytes(spark):
    """No row a byte, and no sort or join of such rows."""
    plan = catalogue.QUERIES["q12_cmi_perm_null"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("portion", [1 << 24, 5])
def test_permuted_halves_against_plain_python(spark, monkeypatch, portion):
    rng = np.random.default_rng(3)
    rows = [(int(i), "".join(rng.choice(list("abcé "), int(rng.integers(0, 60)))), str(rng.choice(["x", "y"]))) for i in rng.permutation(np.arange(-3, 40)) * 400]
    rows += [(7, None, "x"), (None, "abc", "x"), (9, "abc", None), (11, "", "y")]
    want: dict = {}
    cells: dict = {}
    for d, t, s in rows:
        if d is not None and s is not None:
            b = (t or "").encode()
            for i in range(1, len(b)):
                cells.setdefault((s, int(d / 4096), b[i - 1]), []).append((d, i, b[i]))
    for (s, _, c), found in cells.items():
        high = [x >> 4 for *_, x in sorted(found)]
        low = [x & 15 for *_, x in sorted(found, key=lambda r: sha256(b"7:%d:%d" % r[:2]).hexdigest())]
        for a, b in zip(high, low):
            want[s, c, a << 4 | b] = want.get((s, c, a << 4 | b), 0) + 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got: dict = {}
    monkeypatch.setattr(bytecounts, "PORTION", portion)
    some = docs.filter("source IS NOT NULL AND doc_id IS NOT NULL AND octet_length(text) > 1").selectExpr("source", "doc_id", "text", "doc_id DIV 4096 AS piece").toPandas()
    for (s, _), t in some.sort_values("doc_id").groupby(["source", "piece"]):
        text = [x.encode() for x in t["text"]]
        m = bytecounts._permuted(t["doc_id"].to_numpy(), np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)]))
        for k in np.flatnonzero(m).tolist():
            got[s, k >> 8, k & 255] = got.get((s, k >> 8, k & 255), 0) + m[k]
    assert got == want
    sums = bytecounts.permuted(docs).groupBy("source", "c", "x").sum("m").collect()
    assert {tuple(r)[:3]: r[3] for r in sums} == want


def test_texts_of_one_id_take_turns():
    """Orders that (doc_id, place) leaves open are settled by the text; halves of other places keep theirs."""
    data, off = np.frombuffer(b"abab" + b"abac", np.uint8), np.array([0, 4, 8])
    m = bytecounts._permuted(np.array([5, 5]), data, off)
    assert m.sum() == 6 and m.reshape(256, 256)[ord("a")].sum() == 4


def test_equal_first_bytes_are_told_apart_by_the_rest():
    digest = [b"\1" * 8 + b"z", b"\1" * 8 + b"a", b"\0" * 9, b"\1" * 8 + b"z"]
    h = np.array([int.from_bytes(x[:8], "big") for x in digest], np.uint64)
    assert bytecounts._by_digest(np.array([1, 1, 2, 1], np.uint8), h, digest.__getitem__).tolist() == [1, 0, 3, 2]


def test_q115_sums_beyond_64_bits(spark, tmp_path):
    rows = [(k, p, 7) for k, p in enumerate([5 * 10**12, 4 * 10**12, 3 * 10**12, 9 * 10**15, None])]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = sum(p * 1000003 + 7 for _, p, _ in rows if p)
    assert want > 1 << 63
    got = catalogue.QUERIES["q115_sum_order_invariance"](spark, str(tmp_path))
    assert [int(x) for x in got.first()] == [want, want]
    small = catalogue.QUERIES["q115_sum_order_invariance"](spark, "/root/testdata/sf0.001")
    assert [t for _, t in small.dtypes] == ["bigint", "bigint"]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Tables as folders of several files."""
    at = tmp_path_factory.mktemp("parts")
    for t in ("documents", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").repartition(3).write.parquet(f"{at}/{t}.parquet")
    return str(at)


def _against_sql(spark, folder, table, name):
    got = catalogue.QUERIES[name](spark, folder)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = c.sql(catalogue.ORACLES[name])
    rows = sorted(want.fetchall())
    assert rows and sorted(tuple(r) for r in got.select(*want.columns).collect()) == rows


def test_q140_reads_folders(spark, parts):
    _against_sql(spark, parts, "documents", "q140_stream_block_bits")


def test_q141_reads_folders(spark, parts):
    _against_sql(spark, parts, "documents", "q141_stream_carried_bits")


@pytest.mark.parametrize("name", ["q89_stream_event_counts", "q91_dedupe_sink"])
def test_event_streams_read_folders(spark, parts, name):
    _against_sql(spark, parts, "events", name)


def test_similar_short_texts_all_meet(spark):
    """Five shingles of one text and four of the other: similarity 0.8, fingerprints of few words far apart."""
    words = lambda k: [f"w{k}x{i}" for i in range(9)]
    rows = [(2 * k + h, " ".join(words(k)[: 9 - h])) for k in range(150) for h in (0, 1)]
    found = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    classes: dict = {}
    for r in found:
        classes.setdefault(r["root"], []).append(r["first"]["id"])
    assert sorted(sorted(c) for c in classes.values()) == [[2 * k, 2 * k + 1] for k in range(150)]


def test_classes_against_all_pairs(spark):
    """Near copies of every kind, by brute force over all pairs."""
    rng = np.random.default_rng(11)
    texts = []
    for k in range(40):
        base = [f"t{k % 13}w{i}" for i in rng.integers(0, 60, int(rng.integers(5, 80)))]
        for _ in range(5):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = f"n{rng.integers(0, 5)}"
            texts.append(" ".join(w[int(rng.integers(0, 3)) :]))
    sets = [set(simhash.shingle_set(t.encode(), 5).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    found = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    root = {r["first"]["id"]: r["root"] for r in found}
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    pairs = {(label[i], root[first[t]]) for i, t in enumerate(texts)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_similar_documents_in_few_plans(spark, monkeypatch):
    """The three kinds of fingerprints share their plans: the driver of the pipeline ran out of memory over them."""
    calls = []
    monkeypatch.setattr(simhash, "links", lambda *a, links=simhash.links: calls.append(a) or links(*a))
    texts = [" ".join(f"w{i * (k // 2) % 101}" for i in range(40 + k % 2)) for k in range(2, 12)]
    simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(calls) == 1


def test_links_of_kinds_stay_apart(spark):
    fps = spark.createDataFrame([(k, f) for k in range(3) for f in (0, 1 << k, (1 << 40) - 1)], "kind int, fp long")
    found = {(r["kind"], *sorted((r["a"], r["b"]))) for r in simhash.links(fps, 7, 4, 3).collect()}
    assert found == {(k, 0, 1 << k) for k in range(3)}


def test_op9_learns_from_all_words(spark, monkeypatch):
    """The size of a sample plays no part; each word and token counts."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("".join(rng.choice(list("abcdé"), rng.integers(1, 7))) for _ in range(50)), i % 4 > 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")

    def scores():
        return {r["doc_id"]: r["score"] for r in scoring.score_documents(docs, docs["train"], ["doc_id"], orders=0).collect()}

    whole = scores()
    monkeypatch.setattr(scoring, "SAMPLE", 20, raising=False)
    assert scores() == pytest.approx(whole, rel=1e-9)


def test_share_is_the_likeliest_of_all_tokens():
    rng = np.random.default_rng(8)
    counts, spelt = rng.integers(1, 50, 500), 10.0 ** rng.uniform(-7, -2, 500)
    known, share = (counts - 1) / (counts.sum() - 1), 0.5
    for _ in range(3000):
        share = float(np.average(share * known / (share * known + (1 - share) * spelt), weights=counts))
    slopes = np.array([(counts * (known - spelt) / (s * known + (1 - s) * spelt)).sum() for s in scoring.SHARES])
    assert scoring.best_share(slopes) == pytest.approx(share, abs=2e-3)


def test_q141_gives_no_row_for_sources_without_bytes(spark, tmp_path):
    rows = [(i, t, s) for i, (t, s) in enumerate([("abca", "x"), (None, "x"), ("", "y"), (None, "y"), ("é" * 50, "z"), ("a", None)])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' AS lang").write.parquet(str(tmp_path / "documents.parquet"))
    _against_sql(spark, str(tmp_path), "documents", "q141_stream_carried_bits")


def test_carried_bits_of_counts_against_the_sum():
    counts = np.zeros(256, np.int64)
    counts[[0, 7, 65, 255]] = [1, 2, 1_000_003, 300_000]
    logs = lambda a, n: np.log2((a + 32 * np.arange(n)).astype(np.longdouble)).sum()
    want = logs(256, counts.sum()) - sum(logs(1, n) for n in counts.tolist())
    assert blocks.order0_bits(counts) == pytest.approx(float(want), rel=1e-14)
    assert blocks.order0_bits(np.eye(1, 256, 3, dtype=np.int64)[0]) == 8.0


def test_carried_bits_goes_on_over_batches(spark, parts):
    """A file a batch ends where all files at once do."""
    docs = spark.readStream.schema("doc_id long, text string, source string").option("maxFilesPerTrigger", 1).parquet(f"{parts}/documents.parque[t]")
    got = blocks.drain(blocks.carried_bits(docs.filter("source IS NOT NULL"), "source"), "carried", "update").groupBy("source").agg({"bits": "max", "bytes": "max"})
    want = catalogue.QUERIES["q141_stream_carried_bits"](spark, parts).collect()
    assert sorted((r["source"], round(r["max(bits)"], 2), r["max(bytes)"]) for r in got.collect()) == sorted(tuple(r) for r in want)


def test_op9_learning_makes_inputs_for_many_steps(monkeypatch):
    """One call over many steps learns what a call a step does, with a few passes of inputs."""
    rng = np.random.default_rng(3)
    words = sorted({bytes(rng.choice(list(b"abcdefg"), rng.integers(1, 9)).astype(np.uint8)) + b" " for _ in range(900)})[:640]
    voc, blob = scoring.Vocabulary(words, np.ones(640, np.int64)), b"".join(words)
    edges, paths = scoring._edges(blob), voc.paths(0, 640)
    whole = scoring.Mixer(scoring.slot_tables(*scoring._grams(blob, *edges)), 640)
    apart, calls = whole.fresh(), []
    for a in range(0, 640, 32):
        apart.learn(blob, *(x[a : a + 32] for x in edges), paths)
    monkeypatch.setattr(scoring.Mixer, "_inputs", lambda *a, inputs=scoring.Mixer._inputs: calls.append(1) or inputs(*a))
    whole.learn(blob, *edges, paths)
    assert len(calls) <= 8
    assert whole.w == pytest.approx(apart.w, abs=1e-5) and whole.map == pytest.approx(apart.map, abs=1e-5)
    assert (whole.gates == apart.gates).all() and (whole.cells == apart.cells).all()


def test_op9_looks_up_each_four_byte_string_once(monkeypatch):
    """Learning and scoring look up a string's contexts once for all places and all ``owns``, and blocks of strings change nothing."""
    rng = np.random.default_rng(5)
    words = sorted({bytes(rng.choice(list(b"abc"), rng.integers(1, 9)).astype(np.uint8)) + b" " for _ in range(3000)})
    voc, blob = scoring.Vocabulary(words, np.ones(len(words), np.int64)), b"".join(words)
    edges, paths = scoring._edges(blob), voc.paths(0, len(words))
    keys, times = scoring._grams(blob, *edges)
    mixer, slots, rows = scoring.Mixer(scoring.slot_tables(keys, times), len(words)), scoring._slots, []
    monkeypatch.setattr(scoring, "_slots", lambda last, *a: rows.append(len(last)) or slots(last, *a))
    mixer.learn(blob, *edges, paths)
    whole = mixer.score(blob, *edges, paths, (None, 1))
    assert len(keys) < len(blob) / 10 and sum(rows) == 2 * 8 * len(keys)
    monkeypatch.setattr(scoring, "STRINGS", 500)
    again = scoring.Mixer(mixer.n, len(words))
    again.learn(blob, *edges, paths)
    assert (again.w == mixer.w).all() and (again.map == mixer.map).all() and (again.cells == mixer.cells).all()
    assert all((a == b).all() for a, b in zip(whole, again.score(blob, *edges, paths, (None, 1))))


@pytest.mark.parametrize("bits", [4, 20, 50, 64])
def test_op9_sorts_hashes_as_values(bits):
    """Distinct numbers, first places and numbers as ``np.unique`` gives them, also where the top bits tell nothing apart."""
    rng = np.random.default_rng(bits)
    v = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) >> np.uint64(64 - bits)
    for some in (v, v[:0], v[:1], np.repeat(v, 3), v << np.uint64(64 - bits)):
        for got, want in zip(common.distinct(some), np.unique(some, return_index=True, return_inverse=True)):
            assert (got == want).all()


def test_op9_ladder_adds_up_as_written():
    """Packed counts and sums by gate give what the plain steps give."""
    rng = np.random.default_rng(8)
    n = 3 * scoring.STEP + 77
    slots, gate, bit = rng.integers(0, 40, (4, n)), rng.integers(0, scoring.LADDER_GATES, n), rng.random(n) < 0.3
    seen, hits, w = np.zeros((4, scoring.SLOTS)), np.zeros((4, scoring.SLOTS)), np.full((scoring.LADDER_GATES, 5), 0.3)
    w[:, -1] = 0.0
    table = np.tile(1 / (1 + np.exp(-(np.arange(scoring.APM) - scoring.APM // 2) / 2)), (2, 1))
    rows, want = np.arange(4)[:, None], np.empty(n)
    for a in range(0, n, scoring.STEP):
        s, g, y = slots[:, a : a + scoring.STEP], gate[a : a + scoring.STEP], bit[a : a + scoring.STEP].astype(float)
        x = np.concatenate([np.log((hits[rows, s] + 0.4) / (seen[rows, s] - hits[rows, s] + 0.4)), np.full((1, len(y)), 0.3)])
        z = np.clip((x * w[g].T).sum(axis=0), -14, 14)
        p, cell, kind = 1 / (1 + np.exp(-z)), np.clip(np.rint(z * 2) + scoring.APM // 2, 0, scoring.APM - 1).astype(int), g // 16
        want[a : a + scoring.STEP] = np.clip((p + table[kind, cell]) / 2, scoring._MIN, 1 - scoring._MIN)
        np.add.at(seen, (rows, s), 1.0)
        np.add.at(hits, (rows, s), np.broadcast_to(y, s.shape))
        slope, moved, held = np.zeros_like(w), np.zeros_like(table), np.zeros_like(table)
        np.add.at(slope, g, ((y - p) * x).T)
        np.add.at(moved, (kind, cell), y)
        np.add.at(held, (kind, cell), 1.0)
        w += 0.3 * slope / np.maximum(np.bincount(g, minlength=scoring.LADDER_GATES)[:, None], 32)
        table = (table * 50 + moved) / (50 + held)
    assert scoring.Ladder(4).run(slots, gate, bit, True) == pytest.approx(want, rel=1e-12)
