"""Suffix-array deduplication (operator 6).

Every ``SPAN``-byte window belongs to the anchor with the smallest hash among its ``GRAM``-byte grams, so equal
windows have equal anchors at equal offsets, and a window whose anchor stands in one document only is not repeated.

1. Each task cuts its documents into units of about ``UNIT`` bytes, finds their anchors once and writes both to shared scratch. Units send
   the hashes of their anchors and of the anchors' contexts (all windows of the anchor) to reducers by anchor.
2. Reducers settle contexts that equal one of a smaller document as a whole (by 64 bits of hash among the contexts of an anchor), and ask for the
   bytes of each context where an anchor has several contexts in several documents.
3. Those contexts, but for the ones without any window hash that two documents share, are sorted by suffix arrays, built by linear grouping: suffixes are grouped by Lyndon
   prefix, groups processed in descending order over previous-smaller pointers, and each group's order
   is then emitted in one sweep, without recursive renaming. Neighbours that agree in ``SPAN`` bytes are compared byte by byte; the
   smallest document of each run keeps its window.
4. Units put both answers together.

Reducers hold about ``GROUP`` bytes of text each, however large the corpus is.
Copies, however many, send one hash per anchor and context and never meet as pairs.

Defined cases: a null text is empty; a null id neither removes nor loses bytes; rows that share an id never remove
each other's bytes; texts under ``SPAN`` bytes lose none; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, by_number, flat, pieces, scratch, span_hashes, table

SPAN = 50
GRAM = 16
UNIT = 2_000_000
#: Bytes of text a reducer answers for.
GROUP = 8_000_000
#: Bytes hashed at once: what numpy works on then stays in the processor's cache.
CACHED = 1 << 15
_PLACE = U((1 << 16) - 1)


def suffix_array(text) -> list[int]:
    """Order of all suffixes of a sequence of ints whose last is the smallest and unique, by linear grouping."""
    n = len(text)
    order = np.argsort(np.asarray(text), kind="stable").tolist()
    place, group, size = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for k, i in enumerate(order):
        if k and text[i] != text[order[k - 1]]:
            start = k
        place[i], group[i] = k, start
        size[start] += 1
    before = [-1] * n
    end = n
    while end:  # groups in descending order
        own = group[order[end - 1]]
        members = order[own:end] if end - own == 1 else sorted(order[own:end])
        votes: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= own:  # over what is not smaller, along pointers set before
                p = before[p]
            before[i] = p
            if p >= 0:
                votes[p] = votes.get(p, 0) + 1
        if votes:
            levels: dict[int, list[int]] = {}
            for p, v in votes.items():
                if v in levels:
                    levels[v].append(p)
                else:
                    levels[v] = [p]
            for v in sorted(levels, reverse=True):
                level = levels[v]
                for p in level:  # to the end of its group, which shrinks
                    g = group[p]
                    size[g] -= 1
                    last = g + size[g]
                    other, at = order[last], place[p]
                    order[at], order[last] = other, p
                    place[other], place[p] = at, last
                behind = [group[p] + size[group[p]] for p in level]
                for p, g in zip(level, behind):  # into a new group right behind (the old one's place, if all moved)
                    group[p] = g
                    size[g] += 1
        end = own
    out, done, free = [-1] * n, [False] * n, list(range(n + 1))
    out[0], done[n - 1] = n - 1, True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = before[j]
    return out


def _candidates(contexts: list[bytes], docs: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each context whose hash is met in more than one document: only these need sorting."""
    sizes = np.array([len(c) for c in contexts])
    begin = np.cumsum(sizes) - sizes
    n = sizes - span + 1
    owner = np.repeat(np.arange(len(contexts)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[owner]
    h = span_hashes(np.frombuffer(b"".join(contexts), np.uint8), start, start + span)
    order = np.argsort(h)
    h, doc = h[order], docs[owner][order]
    runs = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(runs, len(h)))
    several = np.repeat(np.minimum.reduceat(doc, runs) < np.maximum.reduceat(doc, runs), size)
    hit = order[several]
    place = start[hit] - begin[owner[hit]]
    first, last = np.full(len(contexts), len(owner) + 1), np.full(len(contexts), -1)
    np.minimum.at(first, owner[hit], place)
    np.maximum.at(last, owner[hit], place)
    return first, last


def repeated_windows(contexts: list[bytes], docs: np.ndarray, anchor: np.ndarray, span: int = SPAN, most: int = 250_000) -> list[np.ndarray]:
    """For each context, which window starts also start in a context of a smaller document.

    Contexts of one ``anchor`` are neighbours; windows of different anchors differ, so suffix arrays are
    built for runs of whole anchors with about ``most`` bytes.
    """
    out = [np.zeros(len(c) - span + 1, bool) for c in contexts]
    if not contexts:
        return out
    first, last = _candidates(contexts, docs, span)
    left = np.flatnonzero(last >= 0)
    # equal stretches are sorted once, for their smallest document
    own: dict[bytes, int] = {}
    least: list[int] = []
    group = []
    number = []
    for i in left:
        part = contexts[i][first[i] : last[i] + span]
        k = own.setdefault(part, len(own))
        number.append(k)
        if k == len(least):
            least.append(docs[i])
            group.append(anchor[i])
        elif docs[i] < least[k]:
            least[k] = docs[i]
    parts, least = list(own), np.array(least)
    sizes = np.cumsum([len(p) for p in parts])
    found: list[np.ndarray] = []
    at = 0
    while at < len(parts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        while to < len(parts) and group[to] == group[to - 1]:
            to += 1
        found += _sorted_windows(parts[at:to], least[at:to], span)
        at = to
    for i, k in zip(left, number):
        out[i][first[i] : last[i] + 1] = found[k] | (docs[i] > least[k])
    return out


def _sorted_windows(contexts: list[bytes], docs: np.ndarray, span: int) -> list[np.ndarray]:
    sizes = np.array([len(c) for c in contexts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(contexts) + 1, np.int32)
    owner = np.full(len(text), -1)
    for i, c in enumerate(contexts):
        text[begin[i] : begin[i] + sizes[i]] = np.frombuffer(c, np.uint8) + np.int32(2)
        text[begin[i] + sizes[i]] = 1
        owner[begin[i] : begin[i] + sizes[i] - span + 1] = i
    order = np.array(suffix_array(text.tolist()))
    order = order[owner[order] >= 0]
    same = np.zeros(len(order), bool)
    for a in range(1, len(order), 50_000):
        i = order[a - 1 : a + 50_000]
        rows = text[i[:, None] + np.arange(span)]
        same[a : a + len(i) - 1] = (rows[1:] == rows[:-1]).all(axis=1)
    gone = np.zeros(len(text), bool)
    if len(order):
        doc = docs[owner[order]]
        runs = np.flatnonzero(~same)
        least = np.repeat(np.minimum.reduceat(doc, runs), np.diff(np.append(runs, len(order))))
        gone[order] = doc > least
    return [gone[b : b + s - span + 1] for b, s in zip(begin, sizes)]


_PACKER, _UNPACKER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(a: np.ndarray) -> bytes:
    return _PACKER.compress(np.ascontiguousarray(a).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(_UNPACKER.decompress(b), kind)


def _four(g: np.ndarray) -> bytes:
    """Half of the anchors' hashes: enough beside the reducer, as anchors taken for one only have their contexts compared."""
    return (g >> U(32)).astype(np.uint32).tobytes()


def _gram_hashes(data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """48-bit hashes (the upper bits) of the ``GRAM`` bytes that begin at each place, or at those of ``at``."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, U)
    eight = np.ndarray((n + 8,), "<u8", data, strides=(1,))
    low, high = (eight[:n].copy(), eight[8 : n + 8].copy()) if at is None else (eight[at], eight[at + 8])
    low *= U(0x9E3779B97F4A7C15)
    low ^= low >> U(32)
    low += high
    low *= U(0xBF58476D1CE4E5B9)
    low ^= low >> U(29)
    low *= U(0x94D049BB133111EB)
    low ^= low >> U(32)
    return low & ~_PLACE


def anchors(data: np.ndarray, off: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """First and last window, and place of each anchor, in order."""
    n = len(data) - span + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    whole = np.ones(n, bool)  # windows inside one row
    for end in off[1:].tolist():
        whole[max(0, end - span + 1) : end] = False
    width = span - gram + 1
    place = np.empty(n, np.int64)
    for a in range(0, n, CACHED):
        b = min(n, a + CACHED)
        key = _gram_hashes(data[a : b + span - 1])
        key |= _PLACE - np.arange(len(key), dtype=U)  # smallest hash, the rightmost of equal ones
        have = 1
        while have * 2 <= width:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        rest = width - have
        key = np.minimum(key[: len(key) - rest], key[rest:])
        place[a:b] = (_PLACE - (key & _PLACE)).astype(np.int64) + a
    window = np.flatnonzero(whole)
    if not len(window):
        return (np.zeros(0, np.int64),) * 3
    place = place[window]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)]))
    return window[new], window[np.append(new[1:], len(window)) - 1], place[new]


def _to_bytes(t: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(t)
    return out.getvalue().to_pybytes()


def remove_repeats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``doc_id`` and ``keep`` columns with n_bytes, n_removed, n_spans and kept (the bytes that remain)."""
    keep = [c for c in dict.fromkeys(["doc_id", *keep]) if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    d = docs.select(*dict.fromkeys([*keep, "text"])).withColumn("doc_id", F.col("doc_id").cast("long"))
    total = d.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    reducers = max(1, -(-total // GROUP))

    def reducer(g):
        return ((g >> U(16)) % U(reducers)).astype(np.int64)

    def prepare(batches):
        """Units with the places of their anchors (none of rows without an id)."""
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for t in pieces(batch, "text", UNIT):
                data, off = flat(t.column("text"))
                first, last, p = anchors(data, off)
                ok = t.column("doc_id").is_valid().to_numpy(zero_copy_only=False)[np.searchsorted(off, first, side="right") - 1]
                first, last, p = first[ok], last[ok], p[ok]
                marks = np.concatenate([np.diff(first, prepend=0), last - first, p - first]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"u": [task << 32 | n], "a": [_pack(marks)], "x": [_to_bytes(t)]})
                n += 1

    def unit(marks, rows):
        """Rows, their bytes, their ids, and the windows, places and hashes of their anchors."""
        marks = _unpack(marks.as_py(), np.int32).astype(np.int64).reshape(3, -1)
        rows = pa.ipc.open_stream(rows.as_py()).read_all()
        data, off = flat(rows.column("text"))
        first = np.cumsum(marks[0])
        ids = rows.column("doc_id").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
        doc = ids[np.searchsorted(off, first, side="right") - 1]
        return rows, data, off, doc, first, first + marks[1], first + marks[2], _gram_hashes(data, first + marks[2])

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, data, _, doc, first, last, p, g = unit(batch.column("a")[i], batch.column("x")[i])
                c = span_hashes(data, first, last + SPAN) + (p - first).astype(U) * U(0x9E3779B97F4A7C15)
                out = {"r": [], "u": [], "a": [], "c": [], "d": []}
                for r, here in by_number(reducer(g)):
                    for k, v in zip(out, (r, batch.column("u")[i].as_py(), _four(g[here]), c[here].tobytes(), _pack(np.diff(doc[here], prepend=0)))):
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, pa.schema([("r", pa.int64()), ("u", pa.int64())] + [(c, pa.binary()) for c in "acd"]))

    def settle(key, t):
        a = [np.frombuffer(x, np.uint32) for x in t.column("a").to_pylist()]
        cut = np.cumsum([len(x) for x in a])[:-1]
        a, c = np.concatenate(a), np.concatenate([np.frombuffer(x, U) for x in t.column("c").to_pylist()])
        doc = np.concatenate([np.cumsum(_unpack(x, np.int64)) for x in t.column("d").to_pylist()])
        order = np.lexsort((doc, c, a))
        a, c, doc = a[order], c[order], doc[order]
        new_a = np.concatenate([[True], a[1:] != a[:-1]])
        new_c = new_a | np.concatenate([[True], c[1:] != c[:-1]])
        at_a, at_c = np.flatnonzero(new_a), np.flatnonzero(new_c)
        of_a, of_c = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
        least = doc[at_c][of_c]
        several = (np.add.reduceat(new_c.astype(np.int64), at_a) > 1) & (np.minimum.reduceat(doc, at_a) < np.maximum.reduceat(doc, at_a))
        code = np.where(doc > least, 1, np.where(several[of_a], 2, 0)).astype(np.uint8)
        back = np.empty_like(code)
        back[order] = code
        parts = np.split(back, cut)
        n = len(parts)
        return pa.table({"kind": pa.array([1] * n, pa.int32()), "r": pa.array([key[0].as_py()] * n, pa.int64()), "u": t.column("u"), "x": pa.array([_pack(p) for p in parts], pa.binary())})

    def codes(places, answers, n):
        """Codes of a unit's anchors: 1 settled, 2 asked for."""
        code = np.zeros(n, np.uint8)
        for k, r, x in zip(*(answers.column(c).to_pylist() for c in ("kind", "r", "x"))):
            if k == 1:
                code[places[r]] = _unpack(x, np.uint8)
        return code

    def tell(key, t, answers):
        _, data, _, doc, first, last, _, g = unit(t.column("a")[0], t.column("x")[0])
        to = reducer(g)
        asked = np.flatnonzero(codes(dict(by_number(to)), answers, len(to)) == 2)
        first, last, g, doc = first[asked], last[asked], g[asked], doc[asked]
        out = {"r": [], "u": [], "a": [], "d": [], "n": [], "x": []}
        for r, here in by_number(to[asked]):
            size = last[here] + SPAN - first[here]
            place = np.repeat(first[here] - np.cumsum(size) + size, size) + np.arange(size.sum())
            for k, v in zip(out, (r, key[0].as_py(), _four(g[here]), _pack(doc[here]), _pack(size), _pack(data[place]))):
                out[k].append(v)
        return pa.table(out, pa.schema([("r", pa.int64()), ("u", pa.int64())] + [(n, pa.binary()) for n in ("a", "d", "n", "x")]))

    def compare(key, t):
        a = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("a").to_pylist()])
        doc, sizes = (np.concatenate([_unpack(x, np.int64) for x in t.column(k).to_pylist()]) for k in ("d", "n"))
        whole = b"".join(_unpack(x, np.uint8).tobytes() for x in t.column("x").to_pylist())
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(a, kind="stable")
        gone = repeated_windows([whole[b : b + s] for b, s in zip(begin[order].tolist(), sizes[order].tolist())], doc[order], a[order])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        out, at = [], 0
        for n in t.column("n").to_pylist():
            n = len(_unpack(n, np.int64))
            out.append(_pack(np.packbits(np.concatenate([gone[i] for i in place[at : at + n].tolist()]))))
            at += n
        n = len(out)
        return pa.table({"kind": pa.array([2] * n, pa.int32()), "r": pa.array([key[0].as_py()] * n, pa.int64()), "u": t.column("u"), "x": pa.array(out, pa.binary())})

    schema = d.select(*keep).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")

    def finish(key, t, answers):
        t, data, off, _, first, last, _, g = unit(t.column("a")[0], t.column("x")[0])
        places = dict(by_number(reducer(g)))
        code = codes(places, answers, len(g))
        step = np.zeros(len(data) + 1, np.int32)
        whole = code == 1
        np.add.at(step, first[whole], 1)
        np.add.at(step, last[whole] + SPAN, -1)
        for k, r, x in zip(*(answers.column(c).to_pylist() for c in ("kind", "r", "x"))):
            if k == 2:
                here = places[r][code[places[r]] == 2]
                size = last[here] - first[here] + 1
                bits = np.unpackbits(_unpack(x, np.uint8))[: size.sum()].astype(bool)
                starts = (np.repeat(first[here] - np.cumsum(size) + size, size) + np.arange(size.sum()))[bits]
                np.add.at(step, starts, 1)
                np.add.at(step, starts + SPAN, -1)
        gone = np.cumsum(step[:-1]) > 0
        sums = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        at = off[:-1][np.diff(off) > 0]
        begins[at] = gone[at]
        spans = np.concatenate([[0], np.cumsum(begins)])
        kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        columns = [t.column(c) for c in keep] + [
            pa.array(np.diff(off)),
            pa.array(sums[off[1:]] - sums[off[:-1]]),
            pa.array(spans[off[1:]] - spans[off[:-1]]),
            pa.array(kept, pa.binary()),
        ]
        return pa.table(columns, [f.name for f in schema])

    reply = "kind int, r long, u long, x binary"
    cut = scratch(d.mapInArrow(prepare, "u long, a binary, x binary"), "suffix-units")
    units = cut.groupBy("u")
    settled = cut.select("u", "a", "x").mapInArrow(send, "r long, u long, a binary, c binary, d binary").groupBy("r").applyInArrow(settle, reply)
    told = units.cogroup(settled.groupBy("u")).applyInArrow(tell, "r long, u long, a binary, d binary, n binary, x binary")
    compared = told.groupBy("r").applyInArrow(compare, reply)
    return units.cogroup(settled.unionAll(compared).groupBy("u")).applyInArrow(finish, schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = {
    "op6_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT k, doc_id, i, substr(hx, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(greatest(n - 49, 0))) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS least_id FROM w GROUP BY s),
r AS (SELECT w.k, w.i FROM w JOIN m ON w.s = m.s WHERE m.least_id < w.doc_id),
e AS (SELECT k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i) AS run FROM e),
p AS (SELECT k, run, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY k, run),
q AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS last_b FROM p),
t AS (SELECT q.k, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last_b, string_agg(substr(hx, 2 * q.last_b + 1, 2 * (a - q.last_b)), '' ORDER BY a) AS kept
  FROM q JOIN d ON q.k = d.k GROUP BY q.k)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN t.k IS NULL THEN hx ELSE kept || substr(hx, 2 * last_b + 1) END)) AS kept_sha256 FROM d LEFT JOIN t ON d.k = t.k"""
}
