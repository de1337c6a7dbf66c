"""Block codec: longest-context counts, class partition, 32-bit arithmetic coding.

Every block starts from empty state, so blocks are coded independently and the result does not depend on
how they are spread over tasks. Coding is sequential inside a block; it runs in Arrow batches.
"""

from __future__ import annotations

import bz2
import hashlib
import lzma
import zlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP, HALF, QUARTER = (1 << 32) - 1, 1 << 31, 1 << 30
CAP = 1 << 16


class Counts:
    """Byte counts after contexts of 0..width bytes; the longest context seen before predicts."""

    def __init__(self, width: int):
        self.width, self.seen = width, {}

    def frequencies(self, past: bytes) -> list[int]:
        for order in range(min(self.width, len(past)), -1, -1):
            counts = self.seen.get(past[len(past) - order :] if order else b"")
            if counts:
                freq = [1] * 256
                for b, c in counts.items():
                    freq[b] += 32 * c
                return freq
        return [1] * 256

    def update(self, past: bytes, byte: int) -> None:
        for order in range(min(self.width, len(past)) + 1):
            counts = self.seen.setdefault(past[len(past) - order :] if order else b"", {})
            counts[byte] = counts.get(byte, 0) + 1
            if sum(counts.values()) >= CAP:
                for b in list(counts):
                    counts[b] //= 2
                    if not counts[b]:
                        del counts[b]


def classes(freq: list[int]) -> list[list[int]]:
    """The likeliest byte (the smallest of equals), the next fifteen, and the rest."""
    order = sorted(range(256), key=lambda b: (-freq[b], b))
    return [order[:1], order[1:16], order[16:]]


class Encoder:
    def __init__(self):
        self.low, self.high, self.waiting, self.bits = 0, TOP, 0, []

    def _emit(self, bit: int) -> None:
        self.bits.append(bit)
        self.bits.extend([1 - bit] * self.waiting)
        self.waiting = 0

    def put(self, begin: int, end: int, total: int) -> None:
        width = self.high - self.low + 1
        self.high = self.low + width * end // total - 1
        self.low += width * begin // total
        while True:
            if self.high < HALF:
                self._emit(0)
            elif self.low >= HALF:
                self._emit(1)
                self.low, self.high = self.low - HALF, self.high - HALF
            elif self.low >= QUARTER and self.high < HALF + QUARTER:
                self.waiting += 1
                self.low, self.high = self.low - QUARTER, self.high - QUARTER
            else:
                return
            self.low, self.high = self.low << 1, self.high << 1 | 1

    def finish(self) -> bytes:
        self.waiting += 1
        self._emit(int(self.low >= QUARTER))
        self.bits += [0] * (-len(self.bits) % 8)
        return int("1" + "".join(map(str, self.bits)), 2).to_bytes(len(self.bits) // 8 + 1, "big")[1:]


class Decoder:
    def __init__(self, data: bytes):
        self.data, self.at, self.low, self.high, self.value = data, 0, 0, TOP, 0
        for _ in range(32):
            self.value = self.value << 1 | self._bit()

    def _bit(self) -> int:
        byte, bit = divmod(self.at, 8)
        self.at += 1
        return self.data[byte] >> (7 - bit) & 1 if byte < len(self.data) else 0

    def get(self, sizes: list[int]) -> int:
        total, width = sum(sizes), self.high - self.low + 1
        target = ((self.value - self.low + 1) * total - 1) // width
        begin, k = 0, 0
        while begin + sizes[k] <= target:
            begin += sizes[k]
            k += 1
        self.high = self.low + width * (begin + sizes[k]) // total - 1
        self.low += width * begin // total
        while True:
            if self.high < HALF:
                pass
            elif self.low >= HALF:
                self.low, self.high, self.value = self.low - HALF, self.high - HALF, self.value - HALF
            elif self.low >= QUARTER and self.high < HALF + QUARTER:
                self.low, self.high, self.value = self.low - QUARTER, self.high - QUARTER, self.value - QUARTER
            else:
                return k
            self.low, self.high, self.value = self.low << 1, self.high << 1 | 1, self.value << 1 | self._bit()


def encode_block(block: bytes, width: int = 3, predictor=Counts) -> tuple[bool, bytes]:
    """(stored raw, payload): raw where coding does not save a byte.

    ``predictor(width)`` has ``frequencies(past)``, 256 integers of at least one, and ``update(past, byte)``.
    """
    model, out = predictor(width), Encoder()
    for i, b in enumerate(block):
        past = block[max(0, i - width) : i]
        freq = model.frequencies(past)
        parts = classes(freq)
        sums = [sum(freq[x] for x in p) for p in parts]
        k = next(j for j, p in enumerate(parts) if b in p)
        out.put(sum(sums[:k]), sum(sums[: k + 1]), sum(sums))
        before = sum(freq[x] for x in parts[k][: parts[k].index(b)])
        out.put(before, before + freq[b], sums[k])
        model.update(past, b)
    coded = out.finish() if block else b""
    return (True, block) if len(coded) >= len(block) else (False, coded)


def decode_block(raw: bool, payload: bytes, size: int, width: int = 3, predictor=Counts) -> bytes:
    if raw:
        return payload
    model, source, out = predictor(width), Decoder(payload), bytearray()
    for i in range(size):
        past = bytes(out[max(0, i - width) : i])
        freq = model.frequencies(past)
        parts = classes(freq)
        part = parts[source.get([sum(freq[x] for x in p) for p in parts])]
        out.append(part[source.get([freq[x] for x in part])])
        model.update(past, out[-1])
    return bytes(out)


def pack(blocks: DataFrame, width: int = 3, predictor=Counts) -> DataFrame:
    """(id, blk, block) to an archive: (id, blk, size, raw, payload, check)."""

    def run(batches):
        for b in batches:
            data = b.column("block").to_pylist()
            coded = [encode_block(x, width, predictor) for x in data]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": b.column("id"),
                    "blk": b.column("blk"),
                    "size": pa.array([len(x) for x in data], pa.int64()),
                    "raw": pa.array([c[0] for c in coded], pa.bool_()),
                    "payload": pa.array([c[1] for c in coded], pa.binary()),
                    "check": pa.array([hashlib.sha256(x).digest()[:8] for x in data], pa.binary()),
                }
            )

    return blocks.select("id", "blk", "block").mapInArrow(run, "id long, blk long, size long, raw boolean, payload binary, check binary")


def unpack(archive: DataFrame, width: int = 3, predictor=Counts) -> DataFrame:
    """The blocks of an archive with ``intact``: whether the block agrees with its check."""

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("raw", "payload", "size")))
            data = [decode_block(r, p, n, width, predictor) for r, p, n in rows]
            ok = [hashlib.sha256(x).digest()[:8] == c for x, c in zip(data, b.column("check").to_pylist())]
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "blk": b.column("blk"), "block": pa.array(data, pa.binary()), "intact": pa.array(ok, pa.bool_())})

    return archive.mapInArrow(run, "id long, blk long, block binary, intact boolean")


def read_range(archive: DataFrame, begin: int, size: int, block: int, width: int = 3, predictor=Counts) -> DataFrame:
    """Bytes [begin, begin + size) of every stream, decoding only the blocks that cover them; short at the end."""
    if begin < 0 or size < 0:
        raise ValueError("a range cannot be negative")
    hit = archive.filter((F.col("blk") * block < begin + size) & (F.col("blk") * block + F.col("size") > begin))
    off = F.col("blk") * block
    piece = F.expr("substring(block, CAST(a AS INT) + 1, CAST(z - a AS INT))")
    got = unpack(hit, width, predictor).withColumn("a", F.greatest(F.lit(begin) - off, F.lit(0))).withColumn("z", F.least(F.lit(begin + size) - off, F.octet_length("block")))
    got = got.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("blk", piece.alias("p")))).alias("x"), F.every("intact").alias("intact"))
    return got.select("id", F.aggregate("x", F.lit(b""), lambda s, e: F.concat(s, e["p"])).alias("data"), "intact")


MODES = {"store": lambda b: b, "zlib-9": lambda b: zlib.compress(b, 9), "bz2-9": lambda b: bz2.compress(b, 9), "lzma-6": lambda b: lzma.compress(b), "zstd-19": lambda b: zstandard.ZstdCompressor(level=19).compress(b)}


def mode_costs(blocks: DataFrame) -> DataFrame:
    """(id, blk, mode, bits) of every block under every general compressor, round trips enforced."""
    back = {"store": lambda b: b, "zlib-9": zlib.decompress, "bz2-9": bz2.decompress, "lzma-6": lzma.decompress, "zstd-19": lambda b: zstandard.ZstdDecompressor().decompress(b)}

    def run(batches):
        for batch in batches:
            rows = {"id": [], "blk": [], "mode": [], "bits": []}
            for i, k, b in zip(*(batch.column(c).to_pylist() for c in ("id", "blk", "block"))):
                for name, f in MODES.items():
                    coded = f(b)
                    if back[name](coded) != b:
                        raise ValueError(f"{name} does not round-trip")
                    rows["id"].append(i), rows["blk"].append(k), rows["mode"].append(name), rows["bits"].append(8 * len(coded))
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("id", pa.int64()), ("blk", pa.int64()), ("mode", pa.string()), ("bits", pa.int64())]))

    return blocks.select("id", "blk", "block").mapInArrow(run, "id long, blk long, mode string, bits long")


def lz78_bits(data: bytes, alphabet: int = 256) -> int:
    """Cost of the LZ78 parse: a pointer and a symbol a phrase, a trailing phrase its pointer only."""
    known, phrase, bits, symbol = {b""}, b"", 0, max(1, (alphabet - 1).bit_length())
    for b in data:
        longer = phrase + bytes([b])
        if longer in known:
            phrase = longer
            continue
        bits += max(1, (len(known) - 1).bit_length()) + symbol
        known.add(longer)
        phrase = b""
    return bits + (max(1, (len(known) - 1).bit_length()) if phrase else 0)
