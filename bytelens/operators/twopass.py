"""Two-pass coding: counts of a whole corpus, pruned contexts, a serialised model, frozen coding.

Counting and pruning are joins over (corpus, order, context, byte); a context is an integer of up to eight bytes, its newest byte in
the low eight bits, so the next shorter context is a mask. Counts are not capped. A model is kept where
it saves more than it costs; models are as large as what they save, so one fits a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytelens.sources.scratch import settled

from .codec import Counts, decode_block, encode_block

MOST_WIDTH = 8
#: Widths that are tried, and the memory in MB that counting may take.
WIDTHS, BUDGET = range(2, MOST_WIDTH + 1), 2048.0


def widest(n_bytes: int) -> int:
    """The largest width whose counts, at some 12 MB a MB of text times the width squared, stay within the budget; 2 at least."""
    if n_bytes <= 0:
        return MOST_WIDTH
    return int(max(2, min(MOST_WIDTH, (BUDGET * 1e6 / (12 * n_bytes)) ** 0.5)))


def gram_counts(streams: DataFrame, width: int) -> DataFrame:
    """(corpus, text) to (corpus, ord, ctx, sym, c, t): counts of a byte after a context, and the context's total."""
    if not 0 <= width <= MOST_WIDTH:
        raise ValueError(f"width must be 0 to {MOST_WIDTH}")

    def run(batches):
        for b in batches:
            corpora: dict = {}
            for corpus, text in zip(b.column("corpus").to_pylist(), b.column("text").to_pylist()):
                corpora.setdefault(corpus, []).append(np.frombuffer((text or "").encode(), np.uint8).astype(np.uint64))
            for corpus, texts in corpora.items():
                for o in range(width + 1):
                    long = [t for t in texts if len(t) > o]
                    if not long:
                        continue
                    ctx = np.concatenate([sum((t[k : len(t) - o + k] << np.uint64(8 * (o - 1 - k)) for k in range(o)), np.zeros(len(t) - o, np.uint64)) for t in long])
                    ctx, number = np.unique(ctx, return_inverse=True)
                    gram, c = np.unique(number.astype(np.int64) << 8 | np.concatenate([t[o:] for t in long]).astype(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"corpus": pa.array([corpus] * len(gram), pa.string()), "ord": pa.array([o] * len(gram), pa.int32()), "ctx": ctx[gram >> 8].view(np.int64), "sym": gram & 255, "c": c.astype(np.int64)})

    parts = streams.select(F.col("corpus").cast("string"), "text").mapInArrow(run, "corpus string, ord int, ctx long, sym long, c long")
    all_ = parts.groupBy("corpus", "ord", "ctx", "sym").agg(F.sum("c").alias("c"))
    one = Window.partitionBy("corpus", "ord", "ctx")
    return all_.select("corpus", "ord", "ctx", "sym", "c").withColumn("t", F.sum("c").over(one))


def varint_size(x: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 7)).cast("long")


def _bits(c, t) -> Column:
    return F.log2(256 + 32 * F.col(t)) - F.log2(1 + 32 * F.col(c))


def prune(counts: DataFrame, width: int) -> DataFrame:
    """The contexts that save more bits over their nearest kept ancestor than they take in the model; order 0 stays.

    What is kept of an order does not depend on longer contexts: a smaller width keeps the same up to its order.
    """
    counts = settled(counts, "counts")
    kept = counts.filter("ord = 0")
    near = kept.select("corpus", "ctx").distinct().select("*", F.lit(0).alias("up_ord"), F.lit(0).cast("long").alias("up"))
    for o in range(1, width + 1):
        here = counts.filter(F.col("ord") == o).withColumn("suffix", F.col("ctx").bitwiseAND((1 << 8 * (o - 1)) - 1))
        ups = kept.select("corpus", F.col("ord").alias("up_ord"), F.col("ctx").alias("up"), "sym", F.col("c").alias("uc"), F.col("t").alias("ut"))
        x = here.join(near.withColumnRenamed("ctx", "suffix"), ["corpus", "suffix"]).join(ups, ["corpus", "up_ord", "up", "sym"])
        step = F.col("sym") - F.coalesce(F.lag("sym").over(Window.partitionBy("corpus", "ctx").orderBy("sym")), F.lit(0))
        x = x.withColumn("step", step).groupBy("corpus", "ctx", "up_ord", "up").agg(
            F.sum(F.col("c") * (_bits("uc", "ut") - _bits("c", "t"))).alias("gain"),
            (varint_size(F.col("ctx")) + varint_size(F.count(F.lit(1))) + F.sum(varint_size(F.col("step")) + varint_size(F.col("c")))).alias("size"),
        )
        x = x.select("*", (F.col("gain") > 8 * F.col("size")).alias("keep"))
        x = settled(x, "gains")
        near = x.select("corpus", "ctx", F.when(F.col("keep"), o).otherwise(F.col("up_ord")).alias("up_ord"), F.when(F.col("keep"), F.col("ctx")).otherwise(F.col("up")).alias("up"))
        stay = x.filter("keep").select("corpus", "ctx")
        kept = kept.unionByName(here.drop("suffix").join(stay, ["corpus", "ctx"], "left_semi"))
    return kept


def varint(x: int) -> bytes:
    """Unsigned LEB128."""
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes([*out, x])


def serialise(width: int, model: dict[int, dict[int, dict[int, int]]]) -> bytes:
    """Width, then of each order the number of contexts and, ascending and as differences, contexts, bytes and counts."""
    out = [bytes([width])]
    for o in range(width + 1):
        table, before = model.get(o, {}), 0
        out.append(varint(len(table)))
        for ctx in sorted(table):
            out += [varint(ctx - before), varint(len(table[ctx]))]
            before, last = ctx, 0
            for sym, c in sorted(table[ctx].items()):
                out += [varint(sym - last), varint(c)]
                last = sym
    return b"".join(out)


def parse(data: bytes) -> tuple[int, dict[int, dict[int, dict[int, int]]]]:
    """The inverse of :func:`serialise`; anything that it cannot have written is an error."""
    at = 1

    def number() -> int:
        nonlocal at
        x = shift = 0
        while True:
            if at >= len(data):
                raise ValueError("the model ends early")
            byte = data[at]
            at += 1
            x |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return x

    def ascending(n: int, most: int):
        x = -1
        for k in range(n):
            d = number()
            if k and not d:
                raise ValueError("the model is not in ascending order")
            x = x + d if k else d
            if x > most:
                raise ValueError("the model has a value out of range")
            yield x

    if not data:
        raise ValueError("the model is empty")
    model: dict = {}
    for o in range(data[0] + 1):
        model[o] = {}
        for ctx in ascending(number(), (1 << 8 * o) - 1):
            n = number()
            if not 1 <= n <= 256:
                raise ValueError("a context has no bytes")
            model[o][ctx] = {}
            for sym in ascending(n, 255):
                model[o][ctx][sym] = c = number()
                if not c:
                    raise ValueError("a count is zero")
    if at != len(data):
        raise ValueError("the model is too long")
    return data[0], model


def models(kept: DataFrame, width: int) -> DataFrame:
    """(corpus, model): one serialised model a corpus."""

    def run(t: pa.Table) -> pa.Table:
        model: dict = {}
        for o, ctx, sym, c in zip(*(t.column(x).to_pylist() for x in ("ord", "ctx", "sym", "c"))):
            model.setdefault(o, {}).setdefault(ctx % (1 << 64), {})[sym] = c  # eight bytes are a negative long
        return pa.table({"corpus": pa.array([t.column("corpus")[0].as_py()], pa.string()), "model": pa.array([serialise(width, model)], pa.binary())})

    return kept.groupBy("corpus").applyInArrow(run, "corpus string, model binary")


class Frozen(Counts):
    """The longest kept context predicts; nothing is learned."""

    def __init__(self, data: bytes):
        width, model = parse(data)
        super().__init__(width)
        self.seen = {ctx.to_bytes(o, "big"): counts for o, table in model.items() for ctx, counts in table.items()}

    def update(self, past: bytes, byte: int) -> None:
        pass


def pack_frozen(blocks: DataFrame, kept: DataFrame, width: int, slots: int = 8) -> DataFrame:
    """(corpus, id, blk, block) to (corpus, id, blk, size, raw, payload, again, model_size): coded with the corpus's model.

    ``again`` is the decoded block. Blocks of a corpus are dealt to ``slots`` tasks, each with the model.
    """
    dealt = blocks.withColumn("slot", F.pmod(F.xxhash64("id", "blk"), F.lit(slots)).cast("int"))
    given = models(kept, width).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))

    def run(t: pa.Table, m: pa.Table) -> pa.Table:
        data = m.column("model")[0].as_py() if m.num_rows and t.num_rows else b"\0\0"
        model = Frozen(data)
        plain = t.column("block").to_pylist()
        coded = [encode_block(b, model.width, lambda _: model) for b in plain]
        back = [decode_block(r, p, len(b), model.width, lambda _: model) for (r, p), b in zip(coded, plain)]
        n = t.num_rows
        return pa.table({"corpus": t.column("corpus"), "id": t.column("id"), "blk": t.column("blk"), "size": pa.array([len(b) for b in plain], pa.int64()), "raw": pa.array([c[0] for c in coded], pa.bool_()), "payload": pa.array([c[1] for c in coded], pa.binary()), "again": pa.array(back, pa.binary()), "model_size": pa.array([len(data)] * n, pa.int64())})

    return dealt.groupBy("corpus", "slot").cogroup(given.groupBy("corpus", "slot")).applyInArrow(run, "corpus string, id long, blk long, size long, raw boolean, payload binary, again binary, model_size long")
