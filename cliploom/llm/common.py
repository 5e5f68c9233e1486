"""Helpers that the operators share: shared-folder tables, Arrow slices, byte hashes."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass holds (the passes need about twelve times as much memory).
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch between the JVM and Python.
BATCH_ROWS = 256
#: Bytes of one, about.
BATCH_BYTES = 16 << 20
#: Settings of the allocators of Python workers: large arrays that a pass frees go back to the system at once.
ALLOCATION = {"MALLOC_MMAP_THRESHOLD_": "8388608", "MALLOC_TRIM_THRESHOLD_": "33554432", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    for name, value in ALLOCATION.items():
        env.setdefault(name, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and Spark runs in one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        folder = "file://" + tempfile.mkdtemp(prefix="cliploom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Folders of the tables that this process has stored and not deleted, oldest first.
_stored: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    The table stays until discard() or sweep(), as the DataFrame that an operator returns is still to be read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    _stored.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _stored:
        _stored.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote; others are left alone."""
    for df in tables:
        if path := getattr(df, "stored_path", None):
            _delete(df.sparkSession, path)


def sweep(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables stored since there were `since` of them, but for those to keep: for when all results that rest on them are written."""
    kept = {getattr(df, "stored_path", None) for df in keep}
    for path in [x for x in _stored[since:] if x not in kept]:
        _delete(spark, path)


def n_stored() -> int:
    return len(_stored)


def settle(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished phases: it acts when the JVM collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Keys given to rows whose doc_id is null or not theirs alone begin here.
STAND_INS = 1 << 62


def keyed(docs: DataFrame, key: str = "key") -> DataFrame:
    """docs with a long that tells documents apart: doc_id, or a stand-in by content where that is null or repeated.

    Rows of equal doc_id and text share one. Only the ids are counted; texts shuffle only if some id is repeated.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    shared = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id", F.lit(True).alias("_shared"))
    if shared.isEmpty():
        return docs.withColumn(key, F.col("doc_id"))
    docs = docs.alias("d").join(shared.alias("s"), F.expr("d.doc_id <=> s.doc_id"), "left").select("d.*", "_shared")
    own = STAND_INS + F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(STAND_INS - 1))
    return docs.withColumn(key, F.when(F.col("_shared"), own).otherwise(F.col("doc_id"))).drop("_shared")


_resident: dict[str, object] = {}


def resident(key: str, build: Callable[[], object]) -> object:
    """What `build` makes, kept in this worker until another key is asked for: a worker serves one operator after another."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = build()
    return _resident[key]


def binary(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A text column as one large_binary array, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with about `most` bytes of text (a longer row stays whole): part, offsets, bytes."""
    column = binary(batch.column(batch.schema.get_field_index(text)))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, len(column))
        yield batch.slice(at, end - at), offsets[at : end + 1] - offsets[at], data[offsets[at] : offsets[end]]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash; x is overwritten."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


PRIME = (1 << 31) - 1


class Ranges:
    """Names of byte ranges of one buffer: equal bytes give equal 64-bit names.

    A running sum of table[byte] * base**position, modulo 2**64, gives the name of any range in O(1). Strings that double
    by a rule (Thue and Morse) can agree modulo a power of two whatever the base is, so with `prime` a second sum, modulo
    2**31 - 1, goes into the name too.
    """

    def __init__(self, data: np.ndarray, seed: int = 1, prime: bool = False) -> None:
        rng = np.random.default_rng(seed)
        table = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(0, 2**63)) * 8 + 5 & (2**64 - 1)
        n = len(data)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * powers(base, n), out=self.sum[1:])
        self.undo = powers(pow(base, -1, 2**64), n + 1)
        self.prime = prime
        if prime:
            table = rng.integers(1, PRIME, 256, dtype=np.uint64)
            base = int(rng.integers(2, PRIME))
            self.second = np.zeros(n + 1, np.uint64)  # terms are below 2**31, so 2**33 bytes fit
            np.cumsum(table[data] * powers(base, n, PRIME) % np.uint64(PRIME), out=self.second[1:])
            self.undo_second = powers(pow(base, -1, PRIME), n + 1, PRIME)

    def name(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = mix((self.sum[end] - self.sum[start]) * self.undo[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if self.prime:
            out += mix((self.second[end] - self.second[start]) % np.uint64(PRIME) * self.undo_second[start] % np.uint64(PRIME))
        return out


def powers(base: int, n: int, modulus: int = 0) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64 or a modulus under 2**32."""
    kept = resident("powers", dict)
    have = kept.get((base, modulus))
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (1 << 17))
        have = np.full(size, base, np.uint64)
        have[0] = 1
        if modulus:
            done, step = 1, base
            while done < size:  # what is done, times base**done
                have[done : 2 * done] = have[: min(done, size - done)] * np.uint64(step) % np.uint64(modulus)
                done, step = 2 * done, step * step % modulus
        else:
            have = np.multiply.accumulate(have)
        if size <= SLICE_BYTES * 4:
            kept[base, modulus] = have
    return have[:n]
