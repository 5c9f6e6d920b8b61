"""Helpers shared by the text operators.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, which is what ``bytes.split()`` yields,
and lower-casing touches A-Z only, which is what ``bytes.lower()`` does.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(20240501)).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def give_memory_back() -> None:
    """Python workers outlive their tasks: large arrays that they free go back to the system at once, instead of staying in their heaps."""
    try:
        ctypes.CDLL(None).mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD, which then no longer grows
        pa.set_memory_pool(pa.system_memory_pool())
    except (AttributeError, OSError):
        pass  # another C library


if TaskContext.get() is not None:
    give_memory_back()


def trim_memory() -> None:
    """Small objects that a worker has dropped leave its heap for the system."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: the session's Arrow batches hold at most so many rows, as an executor's tasks keep several batches in and outside the JVM."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text (null: empty), so that extra columns cannot clash with the operators' own."""
    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as remainder 0 (held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(0))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session. One is set only where none is and driver and executors are one process (tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        own = "file://" + tempfile.mkdtemp(prefix="pathweave-")
        spark.sparkContext.setCheckpointDir(own)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors.

    The shuffle files of what was written are released afterwards, since nothing refers to them any more.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what ``materialise`` wrote, once all that was made of it has been written too."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


class IdFilter:
    """A Bloom filter of 64-bit ids, 2^26 bits whatever their number: tells which rows of a large table can have no partner in a join.

    Rows that pass are joined as ever, so a filter that is too full costs time and never results.
    """

    BITS = 26

    def __init__(self, ids: DataFrame) -> None:
        """ids: one column of longs; nulls are left out."""
        name = ids.columns[0]

        def slots(batches):
            found = [self._slots(b.column(0).drop_null().to_numpy(zero_copy_only=False)) for b in batches]
            both = np.unique(np.concatenate([s.astype(np.uint32) for pair in found for s in pair])) if found else np.zeros(0, np.uint32)
            dense = len(both) * 4 > 1 << (self.BITS - 3)
            if dense:
                bits = np.zeros(1 << self.BITS, bool)
                bits[both] = True
            yield pa.RecordBatch.from_pydict({"dense": [dense], "slots": [np.packbits(bits).tobytes() if dense else both.tobytes()]})

        # at most 8 MB from each of 8 tasks
        got = ids.select(F.col(name).cast("long").alias(name)).repartition(8).mapInArrow(slots, "dense boolean, slots binary").toArrow().to_pylist()
        bits = np.zeros(1 << (self.BITS - 3), np.uint8)
        for r in got:
            if r["dense"]:
                bits |= np.frombuffer(r["slots"], np.uint8)
            else:
                at = np.frombuffer(r["slots"], np.uint32)
                np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        self.shared = ids.sparkSession.sparkContext.broadcast(bits.tobytes())

    @classmethod
    def _slots(cls, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(ids.astype(np.int64).view(U))
        return (h >> U(64 - cls.BITS)).astype(np.int64), (h & U((1 << cls.BITS) - 1)).astype(np.int64)

    def rows(self, table: DataFrame, column: str, among: bool = True) -> DataFrame:
        """Rows whose id may be among the filter's, or with ``among=False`` all others (null ids too)."""
        shared, at = self.shared, table.columns.index(column)
        short_batches(table.sparkSession)

        def pick(batches):
            bits = np.frombuffer(shared.value, np.uint8)
            for batch in batches:
                ids = batch.column(at)
                a, b = IdFilter._slots(ids.fill_null(0).to_numpy(zero_copy_only=False))
                hit = (bits[a >> 3] >> (7 - (a & 7)).astype(np.uint8) & bits[b >> 3] >> (7 - (b & 7)).astype(np.uint8) & 1).astype(bool)
                yield batch.filter(pa.array((hit & ids.is_valid().to_numpy(zero_copy_only=False)) == among))

        return table.mapInArrow(pick, table.schema)


def pieces(sizes: list[int], limit: int) -> Iterator[slice]:
    """Consecutive slices whose sizes sum to about ``limit``; at least one element each."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def packed(values: np.ndarray) -> bytes:
    """An array of numbers as its byte planes under zstd: small numbers leave whole planes empty."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes), "zstd", asbytes=True)


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    """What ``packed`` got."""
    if not blob:
        return np.zeros(0, kind)
    n, width = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(memoryview(blob)[8:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def rising(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as packed differences."""
    return packed(np.diff(values, prepend=values.dtype.type(0)))


def risen(blob: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpacked(blob, kind), dtype=kind)


def record(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2^64, grown as texts need them."""

    def __init__(self, multiplier: int = _MULT) -> None:
        self.multiplier, self.inverse = multiplier, pow(multiplier, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(10, int(n - 1).bit_length())
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size, m, U)])) for m in (self.multiplier, self.inverse))
        return self.up, self.down


POWERS = Powers()
#: A second, independent family for verification.
CHECKS = Powers(0xD6E8FEB86659FD93)


def prefix_sums(values: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """S[i] = sum of values[j] * m^j below i, modulo 2^64; any run's hash follows from two of them."""
    up, _ = powers.get(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """64-bit hashes of values[start:end] from ``prefix_sums``."""
    _, down = powers.get(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values."""
    if len(values) < k:
        return np.zeros(0, U)
    sums, (_, down) = prefix_sums(values), POWERS.get(len(values) + 1)
    return mix((sums[k:] - sums[:-k]) * down[: len(values) - k + 1] + U(k))


def byte_values(text: bytes) -> np.ndarray:
    return _TABLE[np.frombuffer(text, np.uint8)]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of a text start and end."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(text, np.uint8)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash for each word."""
    starts, ends = word_bounds(text)
    return run_hashes(prefix_sums(byte_values(text)), starts, ends) if len(starts) else np.zeros(0, U)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
