"""What several operators of this subpackage share: reading tables, shared storage, hashing of byte arrays."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])

#: Odd multiplier of the rolling polynomial and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


#: Bytes of an Arrow batch, unless the application was started with a bound of its own.
ARROW_BYTES = "4m"


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did (a cluster would use --py-files), and get whole texts in batches bounded in bytes."""
    if not spark.sparkContext.getConf().contains("spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a folder in the warehouse where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Stored tables of one computation; on leaving, all but the kept ones are deleted."""

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.frames = spark, {}, []  # frames are held, so that their ids stay theirs

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch._open.remove(self)
        for path in self.paths.values():
            delete(self.spark, path)

    def keep(self, *frames: DataFrame) -> None:
        for df in frames:
            self.paths.pop(id(df), None)

    def drop(self, df: DataFrame) -> None:
        if path := self.paths.pop(id(df), None):
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if Scratch._open:
        Scratch._open[-1].paths[id(out)] = path
        Scratch._open[-1].frames.append(out)
    return out


def task_count(spark: SparkSession, rows: int, rows_each: int) -> int:
    """How many tasks a table of so many rows is worth; at least two for every core."""
    return 2 * spark.sparkContext.defaultParallelism + rows // rows_each


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A fixed pseudo-random 64-bit value for every byte.
BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept up to a few million entries."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:
            have[done : 2 * done] = have[:done] * np.uint64(step)
            done, step = 2 * done, step * step % 2**64
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


_STEP = 1 << 20


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit Rabin-Karp hash of each data[start:end] of bytes, from prefix sums; equal slices hash alike. Slices are in order and apart."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):  # in steps, so that long texts take little memory
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + _STEP, "right")))
        a, b = starts[at:to] - base, ends[at:to] - base
        part = data[base : base + int(b[-1])]
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_CODE[part] * powers(BASE, len(part)), out=prefix[1:])
        out[at:to] = (prefix[b] - prefix[a]) * powers(BASE_INV, len(part) + 1)[a]
        at = to
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Bytes of [\x20\x09-\x0D].
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all width-long windows of a sequence of 64-bit word codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, _STEP):
        part = codes[at : at + _STEP + width - 1]
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(BASE, len(part)), out=prefix[1:])
        own = prefix[width:] - prefix[:-width]
        out[at : at + len(own)] = own * powers(BASE_INV, len(own))
    return mix(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, .. of every slice, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def texts_in(batch, column: str) -> list[bytes]:
    """The column's texts as UTF-8; null: empty."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def released(batches):
    """The batches; when they end, memory that Arrow and the C library keep goes back to the system, as workers live on between stages."""
    import ctypes

    import pyarrow as pa

    yield from batches
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
