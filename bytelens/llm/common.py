"""Pieces the training-data operators share: shared scratch tables, text buffers, words and hashes.

Executors never see each other's local folders, so everything that is cut out of a lineage goes to
the folder named by ``spark.checkpoint.dir`` (see :func:`scratch`).
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the mixing and scoring contracts: runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Words of the licence and contamination contracts: runs of ASCII digits, letters and all non-ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Bytes a core of tables that are dealt out before work starts.
SMALL = 4_000_000

U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where a local session names none (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="bytelens-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later plans start from the files.

    The folder is removed when the JVM of the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bytelens-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. One of a few small files (``SMALL`` bytes a core at most) is dealt to all cores; others are read as they lie."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL and len(df.inputFiles()) < cores else df


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def source_key(source: Column) -> Column:
    """A source as a key that is never null and sorts by code point with null last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), source))


def spread(*cols: Column) -> Column:
    """A seeded 31-bit hash, the order in which rows are shuffled."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 33)


def running(counts: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """``counts`` with ``name``: the sum of ``value`` over the rows of the same ``keys`` with a smaller ``order`` (a long, unique a key).

    Sums of stretches of 4096 numbers are added up first, so no task holds more of a key than a 4096th of its numbers or one stretch.
    """
    far, top = "_stretch", "_top"
    counts = counts.withColumn(far, F.shiftright(F.col(order).cast("long"), 12))
    tops = counts.groupBy(*keys, far).agg(F.sum(value).alias(top))
    tops = tops.withColumn(top, F.sum(top).over(Window.partitionBy(*keys).orderBy(far)) - F.col(top))
    inside = F.sum(value).over(Window.partitionBy(*keys, far).orderBy(order)) - F.col(value)
    return counts.withColumn(name, inside).join(tops, [*keys, far]).withColumn(name, F.col(name) + F.col(top)).drop(far, top)


# --- Arrow text as flat numpy buffers -------------------------------------------------------------


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n+1 offsets; null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null("" if not pa.types.is_binary(text.type) else b"")
    text = text.cast(pa.large_binary())
    _, off, data = text.buffers()
    off = np.frombuffer(off, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(batch, column: str, most: int = 2_000_000):
    """Slices of whole rows of a batch with about ``most`` bytes of text at most (one row at least)."""
    col = batch.column(column)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    _, off = flat(col)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE_WORD = np.ones(256, bool)
_IS_SPACE_WORD[[32, 9, 10, 11, 12, 13]] = False
_IS_ALNUM_WORD = np.zeros(256, bool)
_IS_ALNUM_WORD[48:58] = _IS_ALNUM_WORD[97:123] = _IS_ALNUM_WORD[128:] = True


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, off: np.ndarray, alnum: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in (lower-cased) ``data``, and the first word of each row (n+1).

    Words never cross rows.
    """
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = (_IS_ALNUM_WORD if alnum else _IS_SPACE_WORD)[data]
    cut = off[:-1][np.diff(off) > 0]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    begins[cut] = inside[cut]
    starts = np.flatnonzero(begins)
    stops = inside[:-1].copy()
    ends_here = ~inside[1:]
    ends_here[cut[cut > 0] - 1] = True
    ends = np.flatnonzero(stops & ends_here) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_MIXED = mix64(np.arange(1, 257, dtype=U))
_BASE = U(0x9E3779B97F4A7C15)
_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = -(-n >> 19) << 19
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)]), dtype=U) for b in (_BASE, _INV)]
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of ``data[start:end]``, in one pass of prefix sums."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_MIXED[data] * up[:-1], dtype=U, out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def by_number(to: np.ndarray):
    """Each number that occurs, with the places where it does, in order."""
    low = int(to.min()) if len(to) else 0
    # numpy sorts 16 bits by radix
    order = np.argsort((to - low).astype(np.uint16) if len(to) and int(to.max()) - low < 1 << 16 else to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order], prepend=np.iinfo(np.int64).min))
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(order)).tolist()):
        yield int(to[order[a]]), order[a:b]


def in_order(v: np.ndarray) -> np.ndarray:
    """Places of 64-bit numbers in stable order. Their top bits are sorted as values, with the places in the bits below; numbers that these do not tell apart are sorted after."""
    low = U(max(1, (len(v) - 1).bit_length()))
    mask = (U(1) << low) - U(1)
    order = (np.sort((v & ~mask) | np.arange(len(v), dtype=U)) & mask).astype(np.int64)
    there = v[order]
    wrong = np.flatnonzero(there[1:] < there[:-1])
    if len(wrong):
        top = there >> low
        open_ = np.unique(top[wrong])
        for a, b in zip(np.searchsorted(top, open_).tolist(), np.searchsorted(top, open_, side="right").tolist()):
            order[a:b] = order[a:b][np.argsort(there[a:b], kind="stable")]
    return order


def distinct(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 64-bit numbers in order, the first place of each, and each number's number."""
    order = in_order(v)
    there = v[order]
    new = np.ones(len(v), bool)
    new[1:] = there[1:] != there[:-1]
    number = np.empty(len(v), np.int64)
    number[order] = np.cumsum(new) - 1
    return there[new], order[new], number
