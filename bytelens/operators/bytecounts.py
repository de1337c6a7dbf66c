"""Byte kernels: counts of bytes in contexts, adaptive code lengths and lagged products, from Arrow batches.

Each task works on whole batches with numpy and emits partial sums, so no row a byte ever exists; what is
left to Spark is one aggregation of small rows. Null and empty texts have no bytes.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAGS = (1, 2, 4, 8, 16, 32, 64, 256)
#: Bytes worked on at once (one text at least).
PIECE = 1 << 22
#: Bytes of a group that are permuted at once (those after one byte at least), and places whose digits are kept.
PORTION = 1 << 24
_DIGITS = [b"%d" % i for i in range(1 << 15)]


def _flat(text) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the n+1 offsets."""
    text = text.cast(pa.large_binary()).fill_null(b"")
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = text.buffers()
    off = np.frombuffer(off, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def _pieces(batch):
    """Slices of whole rows: bytes, row and place of each byte, length of each row."""
    _, off = _flat(batch.column("text"))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + PIECE, side="right")) - 1)
        part = batch.slice(at, to - at)
        data, o = _flat(part.column("text"))
        size = np.diff(o)
        row = np.repeat(np.arange(len(size)), size)
        yield part, data.astype(np.int64), row, np.arange(len(data)) - o[:-1][row], size
        at = to


def _part(kind: str, i: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """The part that each place belongs to; -1: none."""
    if kind == "third":
        return (i >= n // 3).astype(np.int64) + (i >= 2 * n // 3)
    if kind == "half":
        return (i >= n // 2).astype(np.int64)
    if kind == "held":  # 0 to learn from, 1 held out; contexts do not cross
        return np.where(i < n // 2, 0, np.where(i >= n // 2 + k, 1, -1))
    if kind == "plane":
        return i % 4
    if kind == "chunk":
        return i // 2048
    return np.zeros(len(i), np.int64)


def _tally(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often they occur: by a dense table where the keys are small."""
    if len(key) and key.max() < max(1 << 16, 2 * len(key)):
        c = np.bincount(key)
        at = np.flatnonzero(c)
        return at, c[at]
    return np.unique(key, return_counts=True)


def counts(docs: DataFrame, by: str, orders: list[int], part: str = "") -> DataFrame:
    """Partial counts c of byte x after the ``k`` bytes ctx (a number), by group and piece: ``by``, piece, k, ctx, x, c."""

    def run(batches):
        for batch in batches:
            for rows, data, row, i, size in _pieces(batch):
                names = rows.column(by).dictionary_encode(null_encoding="encode")
                group = names.indices.to_numpy().astype(np.int64)[row]
                n, ctx = size[row], np.zeros(len(data), np.int64)
                for k in range(max(orders) + 1):
                    if k:
                        ctx[k:] += data[:-k] << 8 * (k - 1)
                    if k not in orders:
                        continue
                    p = _part(part, i, n, k)
                    some = np.flatnonzero((i >= k) & (p >= 0))
                    low = (ctx[some] << 8) | data[some]
                    high = group[some] * (int(p.max(initial=0)) + 1) + p[some]
                    key, c = _tally(high << 8 * (k + 1) | low)
                    high, low = key >> 8 * (k + 1), key & ((1 << 8 * (k + 1)) - 1)
                    g, p = np.divmod(high, int(p.max(initial=0)) + 1)
                    columns = [names.dictionary.take(pa.array(g)), pa.array(p), pa.array(np.full(len(c), k)), pa.array(low >> 8), pa.array(low & 255), pa.array(c)]
                    yield pa.RecordBatch.from_arrays(columns, [by, "piece", "k", "ctx", "x", "c"])

    kind = dict(docs.dtypes)[by]
    return docs.select(by, "text").mapInArrow(run, f"{by} {kind}, piece long, k long, ctx long, x long, c long")


def _earlier(key: np.ndarray) -> np.ndarray:
    """How often each place's key stands before it."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    out = np.empty(len(key), np.int64)
    out[order] = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
    return out


def adaptive(docs: DataFrame, keep: list[str]) -> DataFrame:
    """For each document with bytes: len, code lengths in bits of adaptive models of orders 0 to 2 with backoff (b0, b1, b2), the same of the first quarter (e0, e1, e2), and the KT code length (kt)."""
    names = ["b0", "b1", "b2", "e0", "e1", "e2", "kt"]

    def run(batches):
        for batch in batches:
            for rows, x, row, i, size in _pieces(batch):
                p1, p2 = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
                p1[1:], p2[2:] = x[:-1], x[:-2]
                c0 = _earlier(row << 8 | x)
                cost = [np.log2(256 + 32 * i) - np.log2(1 + 32 * c0)]
                for k, ctx in ((1, p1), (2, p2 << 8 | p1)):
                    some = np.flatnonzero(i >= k)
                    context = row[some] << 8 * k | ctx[some]
                    t, c = _earlier(context), _earlier(context << 8 | x[some])
                    b = cost[-1].copy()
                    b[some] = np.where(t > 0, np.log2(256 + 32 * t) - np.log2(1 + 32 * c), b[some])
                    cost.append(b)
                early = i < (size // 4)[row]
                every = [*cost, *(b * early for b in cost), -np.log2((c0 + 0.5) / (i + 128.0))]
                full = np.flatnonzero(size)
                found = [np.bincount(row, weights=b, minlength=len(size))[full] for b in every]
                left = rows.take(pa.array(full))
                yield pa.RecordBatch.from_arrays([*(left.column(c) for c in keep), pa.array(size[full]), *(pa.array(f) for f in found)], [*keep, "len", *names])

    schema = docs.select(*keep).schema.add("len", "long")
    for name in names:
        schema = schema.add(name, "double")
    return docs.select(*keep, "text").mapInArrow(run, schema)


def lagged(docs: DataFrame, by: str) -> DataFrame:
    """Partial sums by group over bytes x and the bytes y that stand ``lag`` places before (lag 0: themselves): ``by``, lag, n, sx, sy, sxy."""

    def run(batches):
        for batch in batches:
            for rows, x, row, i, _ in _pieces(batch):
                names = rows.column(by).dictionary_encode(null_encoding="encode")
                group, m = names.indices.to_numpy().astype(np.int64)[row], len(names.dictionary)
                for lag in (0, *LAGS):
                    some = np.flatnonzero(i >= lag)
                    a, b, g = x[some], x[some - lag], group[some]
                    sums = [np.bincount(g, weights=w, minlength=m).astype(np.int64) for w in (np.ones(len(g)), a, b, a * b)]
                    yield pa.RecordBatch.from_arrays([names.dictionary, pa.array(np.full(m, lag)), *(pa.array(s) for s in sums)], [by, "lag", "n", "sx", "sy", "sxy"])

    kind = dict(docs.dtypes)[by]
    return docs.select(by, "text").mapInArrow(run, f"{by} {kind}, lag long, n long, sx long, sy long, sxy long")


def _digests(doc: int, places: np.ndarray) -> np.ndarray:
    """SHA-256 of ``7:doc:place``, a row each."""
    head = b"7:%d:" % doc
    if len(places) and places[-1] < len(_DIGITS):
        found = [sha256(head + _DIGITS[i]).digest() for i in places.tolist()]
    else:
        found = [sha256(head + b"%d" % i).digest() for i in places.tolist()]
    return np.frombuffer(b"".join(found), np.uint8).reshape(-1, 32)


def _by_digest(ctx: np.ndarray, h: np.ndarray, whole) -> np.ndarray:
    """Stable order by ``ctx`` and digest; ``h``: the digests' first eight bytes, ``whole``: a row's digest, asked for where these agree."""
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(ctx[order], kind="stable")]
    c, k = ctx[order], h[order]
    tied = np.flatnonzero((k[1:] == k[:-1]) & (c[1:] == c[:-1]))
    for run in np.split(tied, np.flatnonzero(np.diff(tied) > 1) + 1) if len(tied) else ():
        rows = order[run[0] : run[-1] + 2].tolist()
        order[run[0] : run[-1] + 2] = sorted(rows, key=lambda r: (whole(r), r))
    return order


def _permuted(ids: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of (byte before, high half and low half that met) of texts in the order of their ids."""
    out = np.zeros(1 << 16, np.int64)
    first = np.zeros(len(data), bool)
    first[off[:-1][np.diff(off) > 0]] = True
    before = np.concatenate([np.zeros(min(1, len(data)), np.uint8), data[:-1]])
    many, repeated = np.bincount(before[~first], minlength=256), bool((ids[1:] == ids[:-1]).any())
    c = 0
    while c < 256:
        to = c + max(1, int(np.searchsorted(np.cumsum(many[c:]), PORTION, side="right")))
        at = np.flatnonzero((before >= c) & (before < min(to, 256)) & ~first)
        c = to
        if not len(at):
            continue
        h, cut = np.empty(len(at), np.uint64), np.searchsorted(at, off)
        for d in np.flatnonzero(np.diff(cut)).tolist():
            for a in range(cut[d], cut[d + 1], PIECE):
                b = min(a + PIECE, cut[d + 1])
                h[a:b] = np.ascontiguousarray(_digests(int(ids[d]), at[a:b] - off[d])[:, :8]).view(">u8").ravel()
        if repeated:  # texts of one id take turns
            doc = np.searchsorted(off, at, side="right") - 1
            turn = np.lexsort((at - off[doc], ids[doc]))
            at, h = at[turn], h[turn]

        def whole(row: int, at=at) -> bytes:
            d = int(np.searchsorted(off, at[row], side="right")) - 1
            return sha256(b"7:%d:%d" % (ids[d], at[row] - off[d])).digest()

        ctx = before[at]
        plain, drawn = at[np.argsort(ctx, kind="stable")], at[_by_digest(ctx, h, whole)]
        out += np.bincount(before[plain].astype(np.int64) << 8 | data[plain] & 0xF0 | data[drawn] & 15, minlength=1 << 16)
    return out


def permuted(docs: DataFrame, size: int = 4096) -> DataFrame:
    """Partial counts m of byte x after byte c by source, low halves dealt anew: within a source, ``size`` ids and a byte before,
    the n-th high half by (doc_id, place) meets the n-th low half by SHA-256 of ``7:doc_id:place``.

    Rows without source or doc_id take no part. A task holds the texts of a source with ``size`` ids, and 40 bytes or so for each of ``PORTION`` bytes.
    """

    def run(key, table):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        data, off = _flat(table.column("text").combine_chunks())
        m = _permuted(table.column("doc_id").to_numpy(), data, off)
        at = np.flatnonzero(m)
        return pa.table({"source": pa.array([key[0].as_py()] * len(at), pa.string()), "c": at >> 8, "x": at & 255, "m": m[at]})

    some = docs.filter("source IS NOT NULL AND doc_id IS NOT NULL AND octet_length(text) > 1")
    some = some.select("source", "doc_id", "text", F.expr(f"doc_id DIV {size}").alias("piece"))
    return some.groupBy("source", "piece").applyInArrow(run, "source string, c long, x long, m long")
