"""Helpers shared by the training-data operators.

Text leaves Arrow as UTF-8 bytes, null as empty; numpy work runs over chunks of a quarter
megabyte or so, so that the memory of a task depends neither on the batch nor on the partition.
"""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 18
_SEED = np.random.default_rng(20240611)
#: Multipliers of the polynomial hashes, both 5 mod 8.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in BASES)
BYTE_VALUES = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Folders of the tables that are stored, by the innermost scratch; the first list is of those outside of any.
_scratch: list[list[str]] = [[]]
#: Stored tables hold hashes, which no dictionary shortens; small row groups keep writers small.
_WRITE = {"parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20)}
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, base: int = 0, inverse: bool = False) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), or those of its inverse, mod 2**64."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        step = np.full(size, (INVERSES if inverse else BASES)[base], np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= 1 << 20:  # what a worker keeps
            _powers[base, inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of x moves about half of the result's."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(values: np.ndarray, base: int = 0) -> np.ndarray:
    """out[i] is the sum of values[j] * B**j over j < i; one longer than values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), base), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """Hashes of [start, end): equal strings have equal ones wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), base, True)[start]


def utf8(column: pa.Array) -> list[bytes]:
    """Values as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about limit bytes; a longer text is alone in its range."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and the first word of each text (one more entry than texts)."""
    data = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
    start, end = edge[0::2], edge[1::2]
    prefix = prefix_hashes(BYTE_VALUES[data])
    at = np.cumsum([0, *(len(x) + 1 for x in texts)])
    return mix(span_hashes(prefix, start, end) ^ (end - start).astype(np.uint64)), np.searchsorted(start, at)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only a session in one process, as in tests, may name none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at or "/tmp/checkpoints/quire"


def stored(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """df written as Parquet in the shared checkpoint folder and read again: its lineage is cut and no executor's loss can lose it.
    small: rows of a few numbers, which so many files as there are cores hold, not one a shuffle partition."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"
    _scratch[-1].append(path)
    (df.coalesce(df.sparkSession.sparkContext.defaultParallelism) if small else df).write.options(**_WRITE).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Removes the files of a stored table."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are stored within go at its end, but for those stored by the function it gives."""
    _scratch.append([])

    def kept(df: DataFrame) -> DataFrame:
        own, _scratch[-1] = _scratch[-1], _scratch[-2]
        try:
            return stored(df, "result")
        finally:
            _scratch[-1] = own

    try:
        yield kept
    finally:
        for folder in _scratch.pop():
            _delete(spark, folder)
        release(spark)


def release(spark) -> None:
    """Lets Spark delete the shuffle files of plans that are done. Listeners hold a plan for a moment after its end, so on a cluster the garbage is collected twice."""
    for pause in (0,) if spark.sparkContext.master.startswith("local[") else (0.2, 0.3):
        time.sleep(pause)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of fewer rows than Spark's usual ones, for rows that carry texts: a worker holds a few copies of a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def crc32_bucket(doc_id, modulus: int):
    """crc32 of the id as text, mod modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): connected components of edges (a, b), each named by its smallest node.

    Alternating large-star and small-star steps; each needs groups by node only to find a minimum,
    which is combined before the shuffle. A node of very many links stays a stream of rows.
    Each round is written to the checkpoint folder.
    """
    known = F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", small=True)
    before = None
    for _ in range(rounds):
        both = current.union(current.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = stored(small, "edges", small=True)
        after = new.agg(*known).first()
        dropped(current)
        current = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
