"""SimHash near-duplicates with bit-sliced comparison (operator 2).

Fingerprints are majority votes over the XXH64 of 4-word shingles. Equal fingerprints are collapsed
first. Distinct ones that differ in at most ``radius`` bits agree on all but ``radius`` of any ``b`` blocks
of bits, so each is dealt to one bucket per choice of ``b - radius`` blocks; ``b`` follows the number of fingerprints, so
that buckets stay small, and the result is exact for any ``b``. A bucket's bit planes are stored vertically, 64
fingerprints a word, and one fingerprint is compared with 64 at a time: a carry-save counter (three bit planes and
an overflow) adds up the differing bits, and a block of 64 is abandoned once all its counts exceed the radius.
Buckets of over ``HOT`` fingerprints are split into tiles that meet pairwise (the result is exact, and a bucket's work is quadratic in it).
Tiles return spanning links, not all pairs. A fingerprint of over a 500th of the rows is joined by broadcast.

``similar_documents`` finds documents that share ``SIMILARITY`` of their ``WORDS``-word shingles: fingerprints of pairs of words, three a document
with different seeds, are close where texts are, links of any are candidates, and every one is verified by the exact Jaccard similarity
of the shingle sets. Of a group of close texts ``FORESTS`` spanning forests of its nearest links are verified (a number of links in proportion to the
texts). What these miss is found exactly: similar sets share one of their first shingles in any order common to all (here rare ones first, by counts of all
texts in ``ORDER_BITS`` bits of slots), so every two texts that share such a shingle and are not yet of one class are verified, unless sizes and places exclude them.

Defined cases: a null or wordless text has fingerprint zero, linked like any other; repeated rows come back
as rows; a component whose ids are all null has a null component_id; an empty table gives an empty result; other
columns are left alone.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, flat, lowered, mix64, pieces, scratch, span_hashes, table, words
from .components import components, join_unique

SHINGLE = 4
RADIUS = 4
SEED = 42
HOT = 2048
#: Fingerprints a bucket holds on average at most; fewer choices of blocks, and rows to shuffle, as it grows.
BUCKET = 1024
#: Similar documents: words of a shingle and the least Jaccard similarity; words of the fingerprints' shingles, their seeds, bits they may differ in, and forests of links that are verified.
WORDS, SIMILARITY = 5, 0.8
PAIRS, SEEDS, NEAR, FORESTS = 2, (0, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03), 7, 4
#: Slots of the counts that order shingles (collisions cost time, not links), and slots that are added up together.
ORDER_BITS, ORDER_BLOCK = 22, 1 << 14


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else []
    whole = b" ".join(w)
    ends = (np.cumsum([len(x) for x in w]) + np.arange(len(w))).tolist()
    begins = [0] + [e + 1 for e in ends[: len(w) - size]]
    digest = xxhash.xxh64_intdigest
    return [digest(whole[a:b], SEED) for a, b in zip(begins, ends[size - 1 :])]


def _votes(h: np.ndarray) -> np.uint64:
    """Bit i is set if it is set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        bits = np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return (U(1) << np.flatnonzero(votes * 2 > len(h)).astype(U)).sum(dtype=U)


def fingerprints(texts: list[str | None], size: int = SHINGLE) -> np.ndarray:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    return np.array([_votes(np.array(shingle_hashes(t, size), U)) for t in texts], U).reshape(-1)


def pair_fingerprints(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A fingerprint for each of ``SEEDS`` (columns) of the distinct pairs of neighbouring words of each text (fewer words: of the words)."""
    starts, ends, first = words(lowered(data), off, False)
    h = span_hashes(lowered(data), starts, ends)
    out = np.zeros((len(off) - 1, len(SEEDS)), U)
    for i in range(len(out)):
        w = h[first[i] : first[i + 1]]
        w = np.unique(mix64(w[:-1] * U(0x100000001B3) + w[1:]) if len(w) >= PAIRS else w)
        for k, seed in enumerate(SEEDS):
            out[i, k] = _votes(mix64(w ^ U(seed)) if seed else w)
    return out


def _exceeds(ones, twos, fours, over, radius: int):
    """Lanes whose count is above the radius."""
    above, equal = over.copy(), ~over
    for plane, bit in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & bit:
            equal &= plane
        else:
            above |= equal & plane
            equal &= ~plane
    return above


def bit_sliced_links(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS, tile: int = 1 << 17):
    """Pairs of rows (i, j), i < j, of one group with at most ``radius`` (< 8) differing bits, in portions.

    Rows of a group are neighbours.
    """
    n = len(fps)
    if n < 2:
        return
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(begin, n))
    n_words = -(-size // 64)
    first_word = np.cumsum(n_words) - n_words
    total = int(n_words.sum())
    g = np.repeat(np.arange(len(begin)), size)
    rank = np.arange(n) - begin[g]
    lane = first_word[g] * 64 + rank
    row_at = np.full(total * 64, -1, np.int64)
    row_at[lane] = np.arange(n)
    lanes = np.zeros(total * 64, U)
    lanes[lane] = fps
    planes = [np.packbits(((lanes >> U(b)) & U(1)).astype(np.uint8), bitorder="little").view(U) for b in range(64)]
    valid = np.packbits(row_at >= 0, bitorder="little").view(U)
    own = lane // 64
    todo = first_word[g] + n_words[g] - own  # from a row's own word to its group's last
    cuts = np.concatenate([[0], np.cumsum(todo)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + tile, side="right")) - 1)
        times = todo[at:to]
        q = np.repeat(np.arange(at, to), times)
        w = own[q] + np.arange(len(q)) - np.repeat(cuts[at:to] - cuts[at], times)
        query = fps[q]
        ones, twos, fours, over = (np.zeros(len(q), U) for _ in range(4))
        for b in range(64):
            x = planes[b][w] ^ (U(0) - ((query >> U(b)) & U(1)))
            carry = ones & x
            ones ^= x
            x = twos & carry
            twos ^= carry
            carry = fours & x
            fours ^= x
            over |= carry
            if b % 8 == 7:
                live = (~_exceeds(ones, twos, fours, over, radius) & valid[w]) != 0
                if b < 63 and live.sum() < 0.7 * len(live):  # abandon the blocks that are all beyond the radius
                    q, w, query, ones, twos, fours, over = (v[live] for v in (q, w, query, ones, twos, fours, over))
        near = ~_exceeds(ones, twos, fours, over, radius) & valid[w]
        some = np.flatnonzero(near)
        t, bit = np.nonzero(np.unpackbits(near[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i, j = q[some[t]], row_at[w[some[t]] * 64 + bit]
        yield i[j > i], j[j > i]
        at = to


def spanning(n: int, portions) -> np.ndarray:
    """The smallest row each row reaches."""
    label = np.arange(n)
    for i, j in portions:
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            while (label[label] != label).any():
                label = label[label]
    return label


def forests(fps: np.ndarray, portions, times: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """``times`` spanning forests of the links without links in common, each nearest first: ends of their links.

    Ties are dealt by hash, so that no row gets all of them.
    """

    def grow(i, j):
        """Every tree takes its nearest link to another, until none is left."""
        key = (np.bitwise_count(fps[i] ^ fps[j]).astype(U) << U(56)) | (mix64(fps[i] ^ mix64(fps[j])) >> U(8))
        order = np.argsort(key, kind="stable")
        i, j = i[order], j[order]
        used = np.zeros(len(i), bool)
        for _ in range(times):
            tree, left = np.arange(len(fps)), np.flatnonzero(~used)
            while len(left):
                left = left[tree[i[left]] != tree[j[left]]]
                _, first = np.unique(np.stack([tree[i[left]], tree[j[left]]], axis=1).reshape(-1), return_index=True)
                pick = left[np.unique(first // 2)]
                used[pick] = True
                tree = spanning(len(fps), [(tree[i[pick]], tree[j[pick]])])[tree]
        return i[used], j[used]

    i, j = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for x, y in portions:
        i, j = np.concatenate([i, x]), np.concatenate([j, y])
        if len(i) > 500_000:
            i, j = grow(i, j)
    return grow(i, j)


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bits that each table of buckets keys on, for n fingerprints."""
    for blocks in range(radius + 1, 2 * radius + 1):
        kept = blocks - radius
        if n <= BUCKET << (64 * kept // blocks) or blocks == 2 * radius:
            break
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(block, kept)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = RADIUS, nearest: int = 0, kinds: int = 1) -> DataFrame:
    """Distinct longs ``fp`` to spanning links (a, b) of those that differ in ``radius`` bits at most; ``nearest``: of so many forests, nearest links first.

    ``kinds``: fingerprints are of so many kinds, 0 and so on in the column ``kind``, and only those of one kind meet; links have the column too.
    """
    cuts = masks(-(-fps.count() // kinds), radius)
    first = F.col("kind") * len(cuts) if kinds > 1 else F.lit(0)
    keys = [F.struct((first + i).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(cuts)]
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("x")).select("fp", "x.t", "x.k")
    hot = dealt.groupBy("t", "k").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT)
    hot = hot.select("t", "k", F.ceil(F.col("c") / HOT).alias("parts"))
    dealt = dealt.join(hot, ["t", "k"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("s", F.pmod(F.xxhash64("fp"), "parts"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("t", "k", F.least("s", "o").alias("x"), F.greatest("s", "o").alias("y"), "fp")
    cell = ["t", "k", "x", "y"]

    def compare(batches):
        held: list[np.ndarray] = []  # rows of the cell that is not complete yet, and those before it

        def out(rows: np.ndarray):
            change = (rows[1:, :4] != rows[:-1, :4]).any(axis=1)
            group = np.concatenate([[0], np.cumsum(change)])
            f = rows[:, 4].view(U)
            found = bit_sliced_links(f, group, radius)
            if nearest:
                i, j = forests(f, found, nearest)
            else:
                j = spanning(len(f), found)
                i = np.flatnonzero(j != np.arange(len(f)))
                j = j[i]
            return pa.RecordBatch.from_pydict({"a": rows[i, 4], "b": rows[j, 4], "kind": (rows[i, 0] // len(cuts)).astype(np.int32)})

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
            held.append(np.ascontiguousarray(rows))
            if sum(map(len, held)) >= 60_000:
                rows = np.concatenate(held)
                change = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1))
                if len(change):
                    cut = change[-1] + 1
                    yield out(np.ascontiguousarray(rows[:cut]))
                    held = [rows[cut:]]
        if held:
            yield out(np.ascontiguousarray(np.concatenate(held)))

    sorted_ = dealt.repartition(*cell).sortWithinPartitions(*cell)
    return sorted_.mapInArrow(compare, "a long, b long, kind int")


def near_duplicates(docs: DataFrame, keep: list[str], radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """``keep`` columns with fp (long), root (the component's smallest fp) and component_id (its smallest doc_id)."""

    def scan(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                fp = fingerprints(part.column("text").to_pylist(), size)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(fp.view(np.int64))], [*keep, "fp"])

    keep = [c for c in dict.fromkeys(["doc_id", *keep]) if c not in ("fp", "root", "component_id")]
    d = docs.select(*dict.fromkeys([*keep, "text"]))
    base = scratch(d.mapInArrow(scan, d.select(*keep).schema.add("fp", "long")), "fingerprints")
    distinct = scratch(base.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "id", "n", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    total = distinct.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("prints")).first()
    by_fp = join_unique(named.withColumnRenamed("n", "_n"), smallest, "root", total["prints"]).select("fp", "root", "component_id", F.col("_n").alias("n"))
    return join_unique(base, scratch(by_fp, "classes"), "fp", total["rows"] or 0)


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a text (told apart by 64-bit hashes): key (XXH64 of the text), first (its smallest id), rows, root (smallest key of its class).

    Defined cases: null and empty texts are one text each and like no other; an id that is null is last; texts of fewer than
    ``WORDS`` words are similar if they have the same words; empty tables give no rows.
    """

    def scan(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                f = pair_fingerprints(*flat(part.column("text"))).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("id"), *(pa.array(f[:, k]) for k in range(len(SEEDS)))], ["key", "id", *prints])

    prints = [f"f{k}" for k in range(len(SEEDS))]
    d = docs.select(F.xxhash64(text).alias("key"), F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).cast("long").alias("id")).alias("id"), F.col(text).alias("text"))
    schema = d.select("key", "id").schema
    for f in prints:
        schema = schema.add(f, "long")
    base = scratch(d.mapInArrow(scan, schema), "fingerprints")
    texts = base.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows"), *(F.min(f).alias(f) for f in prints))
    texts = scratch(texts, "texts")
    # the kinds of fingerprints go through one plan
    of = texts.select("key", F.posexplode(F.array(*prints)).alias("kind", "fp"))
    fps = scratch(of.groupBy("kind", "fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    near = scratch(links(fps.select("kind", "fp"), NEAR, FORESTS, len(prints)).distinct(), "near")
    a, b = (fps.select("kind", F.col("fp").alias(c), F.col("least").alias(e)) for c, e in ("ax", "by"))
    near = near.join(a, ["kind", "a"]).join(b, ["kind", "b"]).select("x", "y")
    # texts with one fingerprint: each with the smallest
    same = join_unique(of, fps.filter("n > 1"), ["kind", "fp"], len(prints) * texts.count()).filter("key <> least").select(F.col("key").alias("x"), F.col("least").alias("y"))
    pairs = near.unionByName(same)
    pairs = scratch(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "candidates")
    firsts = texts.select("key", F.col("first").alias("id"))
    good = _verified(d, firsts, pairs)
    ends = [F.col("x").alias("a"), F.col("y").alias("b")]
    roots = components(good.select(*ends))
    more = _unmet(d, roots)
    if more.take(1):
        # the classes found stand for their links
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(_verified(d, firsts, more).select(*ends)))
    return texts.join(roots, texts["key"] == roots["node"], "left").select("key", "first", "rows", F.coalesce("root", "key").alias("root"))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text (of all its words, if they are fewer; none for none)."""
    data = lowered(np.frombuffer(text, np.uint8))
    starts, ends, _ = words(data, np.array([0, len(data)]), False)
    h = span_hashes(data, starts, ends)
    k = min(size, len(h))
    g = np.zeros(len(h) - k + 1 if k else 0, U)
    for j in range(k):
        g = mix64(g * U(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return np.unique(g)


def _levels(rows: DataFrame) -> np.ndarray:
    """How often shingles of each slot occur, as steps of a logarithm."""

    def count(batches):
        n = np.zeros(1 << ORDER_BITS, np.uint32)
        for batch in batches:
            for part in pieces(batch, "text", 1_000_000):
                for t in part.column("text").cast(pa.binary()).to_pylist():
                    np.add.at(n, _order_slots(shingle_set(t or b"", WORDS)), np.uint32(1))
        packed = [zlib.compress(x.tobytes(), 1) for x in n.reshape(-1, ORDER_BLOCK)]
        yield pa.RecordBatch.from_pydict({"b": pa.array(range(len(packed)), pa.int32()), "n": pa.array(packed, pa.binary())})

    def add(key, t):
        n = np.zeros(ORDER_BLOCK, np.int64)
        for x in t.column("n").to_pylist():
            n += np.frombuffer(zlib.decompress(x), np.uint32)
        return pa.table({"b": [key[0].as_py()], "n": [np.floor(4 * np.log2(n + 1)).astype(np.uint8).tobytes()]}, pa.schema([("b", pa.int32()), ("n", pa.binary())]))

    found = rows.select("text").mapInArrow(count, "b int, n binary").groupBy("b").applyInArrow(add, "b int, n binary").collect()
    out = np.zeros(1 << ORDER_BITS, np.uint8)
    for r in found:
        out[r["b"] * ORDER_BLOCK : (r["b"] + 1) * ORDER_BLOCK] = np.frombuffer(bytes(r["n"]), np.uint8)
    return out


def _order_slots(s: np.ndarray) -> np.ndarray:
    return (s >> U(64 - ORDER_BITS)).astype(np.int64)


def _by_first(width: int, work):
    """Turns batches of rows of longs, sorted by their first, into calls of ``work`` with whole groups."""

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(width)], axis=1))
            if sum(map(len, held)) >= 60_000:
                rows = np.concatenate(held)
                change = np.flatnonzero(rows[1:, 0] != rows[:-1, 0])
                cut = change[-1] + 1 if len(change) else 0
                if cut:
                    yield from work(rows[:cut])
                held = [rows[cut:]]
        if held:
            yield from work(np.concatenate(held))

    return run


def cross_pairs(key: np.ndarray, root: np.ndarray, n: np.ndarray, place: np.ndarray, block: int = 1 << 20):
    """Portions of pairs of one shingle's texts, of different classes, that can be similar; texts in the order of ``n``, shingles of their sets.

    ``place``: where the shingle stands in the set's order. Of their first common shingle at most as many more are common as stand after it in either.
    """
    step = max(1, block // len(key))
    for a in range(0, len(key), step):
        i = np.arange(a, min(len(key), a + step))[:, None]
        end = int(np.searchsorted(n, n[i[-1, 0]] / SIMILARITY + 1e-6, side="right"))
        j = np.arange(a, end)[None, :]
        most = np.minimum(n[i] - place[i], n[j] - place[j])
        ok = (j > i) & (root[i] != root[j]) & (most * (1 + SIMILARITY) >= SIMILARITY * (n[i] + n[j]) - 1e-6)
        x, y = np.nonzero(ok)
        if len(x):
            yield key[x + a], key[y + a]


def _unmet(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (x, y) of keys in different classes among which are all that are similar. ``rows``: key, text; ``roots``: node, root of what is linked."""
    levels = rows.sparkSession.sparkContext.broadcast(_levels(rows))

    def prefixes(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1_000_000):
                keys, at = np.unique(part.column("key").to_numpy(), return_index=True)
                texts = part.column("text").cast(pa.binary())
                out = [[np.zeros(0, np.int64)] * 4]
                for key, k in zip(keys.tolist(), at.tolist()):
                    s = shingle_set(texts[k].as_py() or b"", WORDS)
                    n = len(s)
                    first = n - int(np.ceil(SIMILARITY * n - 1e-6)) + 1 if n else 0
                    s = s[np.lexsort((s, levels.value[_order_slots(s)]))[:first]]
                    out.append([s.view(np.int64), np.full(len(s), key), np.arange(len(s)), np.full(len(s), n)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["s", "key", "place", "n"])

    def shared(found):
        found = found[np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])]  # copies of a text
        begin = np.flatnonzero(np.concatenate([[True], found[1:, 0] != found[:-1, 0]]))
        size = np.diff(np.append(begin, len(found)))
        some = found[np.repeat(size > 1, size)]
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(some[:, c])) for c in range(4)], ["s", "key", "place", "n"])

    def pair(found):
        begin = np.flatnonzero(np.concatenate([[True], found[1:, 0] != found[:-1, 0]]))
        end = np.append(begin[1:], len(found))
        apart = np.minimum.reduceat(found[:, 4], begin) != np.maximum.reduceat(found[:, 4], begin)
        for a, b in zip(begin[apart].tolist(), end[apart].tolist()):
            g = found[a:b]
            for x, y in cross_pairs(g[:, 1], g[:, 4], g[:, 3], g[:, 2]):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["x", "y"])

    kind = "s long, key long, place long, n long"
    met = rows.select("key", "text").mapInArrow(prefixes, kind).repartition("s").sortWithinPartitions("s", "key").mapInArrow(_by_first(4, shared), kind)
    met = scratch(met, "shared")
    met = met.join(roots, met["key"] == roots["node"], "left").select("s", "key", "place", "n", F.coalesce("root", "key").alias("root"))
    pairs = met.repartition("s").sortWithinPartitions("s", "n", "key").mapInArrow(_by_first(5, pair), "x long, y long")
    return scratch(pairs.distinct(), "unmet")


def _verified(rows: DataFrame, firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (x, y) of keys whose texts' shingle sets have a Jaccard similarity of ``SIMILARITY`` or more.

    ``rows``: key, id, text; ``firsts``: each key's smallest id, whose row alone shows its text, so that copies do not meet.
    """

    def sets(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1_000_000):
                found = [shingle_set(t or b"", WORDS).view(np.int64) for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found, pa.list_(pa.int64()))], ["key", "s"])

    ends = pairs.select(F.col("x").alias("key")).unionAll(pairs.select("y")).distinct()
    ends = firsts.join(ends, "key").select(F.col("key").alias("k"), F.col("id.none").alias("n"), F.coalesce("id.id", F.lit(0)).alias("i"))
    one = (F.col("key") == F.col("k")) & (F.coalesce("id.id", F.lit(0)) == F.col("i")) & (F.col("id.none") == F.col("n"))
    some = rows.join(ends, one).select("key", "text").dropDuplicates(["key"]).mapInArrow(sets, "key long, s array<long>")
    some = scratch(some, "shingles")
    left, right = (some.select(F.col("key").alias(c), F.col("s").alias(f"s{c}")) for c in "xy")
    shared = F.size(F.array_intersect("sx", "sy"))
    similar = shared >= SIMILARITY * (F.size("sx") + F.size("sy") - shared)
    return scratch(pairs.join(left, "x").join(right, "y").filter(similar & (F.size("sx") > 0)).select("x", "y"), "verified")


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"])
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")
