"""What the operators share: tables in the cluster's shared folder, row keys, hypergeometric draws."""

from __future__ import annotations

import ctypes
import math
import random
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine, one of our own where it is unset."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="foliospark-")  # one machine, as in tests
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Bytes of an Arrow batch that a Python worker is sent while a table is written.
BATCH_BYTES = "4m"
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends its workers batches of BATCH_BYTES at most, so that long texts don't add up."""
    before = spark.conf.get(BATCHES)
    spark.conf.set(BATCHES, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCHES, before)


def keep_batches_small(spark: SparkSession) -> None:
    """From now on the session sends workers batches of BATCH_BYTES at most: for results that the caller writes, when
    small_batches has ended."""
    spark.conf.set(BATCHES, BATCH_BYTES)


def give_back() -> None:
    """Memory that this process has freed, but not returned, goes back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, for mapInArrow: when it has ended, its worker, which stays for later tasks, gives back what it has freed."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder so that lineage ends there.

    A written table survives the loss of any executor; what is no longer needed is dropped at once."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.at = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, repeats: bool = True) -> DataFrame:
        """Writes df and reads it back; repeats: whether values repeat, so that it pays to look for a dictionary."""
        with small_batches(self.spark):
            df.write.mode("overwrite").option("parquet.enable.dictionary", str(repeats).lower()).parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the filter that says which keys a table may hold (16 MB, whatever the table's size).
FILTER_BITS = 1 << 27


class MayHold:
    """A filter of fixed size of a written table's keys, 64-bit hashes: a key that it denies isn't there.

    It is sent to all workers, so that of large rows only those that may have a partner in the table are shuffled for
    the join that decides. Up to some 100 million keys it denies most others; beyond, more rows go through the join."""

    def __init__(self, table: DataFrame, key: str):
        spark = table.sparkSession
        at = F.shiftrightunsigned(F.col(key), 1).bitwiseAND(F.lit(FILTER_BITS - 1)) + 1  # bitmaps count from 1
        parts = table.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        self.empty, bits = True, np.zeros(FILTER_BITS // 8, np.uint8)
        for k, x in parts.collect():  # FILTER_BITS / 32,768 rows of 4 KB at most
            self.empty = False
            bits[(k - 1) * len(x) : k * len(x)] = np.frombuffer(x, np.uint8)
        self.bits = spark.sparkContext.broadcast(bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys (on an executor) the table may hold."""
        at = (keys.view(np.uint64) >> np.uint64(1)) & np.uint64(FILTER_BITS - 1)
        return (self.bits.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def column(self, key: str) -> Column:
        """Whether the table may hold a row's key; only keys go to Python, and a null key is denied."""
        if self.empty:
            return F.lit(False)
        bits = self.bits

        @F.arrow_udf("boolean")
        def may(x: pa.Array) -> pa.Array:
            at = (x.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(1)) & np.uint64(FILTER_BITS - 1)
            got = (bits.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            return pa.array(got & x.is_valid().to_numpy(zero_copy_only=False))

        return may(F.col(key))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(has_map(f.dataType) for f in kind)
    return has_map(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, (T.MapType, T.VariantType))


def row_key(df: DataFrame, seed: int) -> Column:
    """A 64-bit hash of the whole row (columns with maps left out) and the seed: the same on each run and each machine."""
    return F.xxhash64(F.lit(seed), *[F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("\x00")) if isinstance(f.dataType, T.AtomicType) else F.col(f"`{f.name}`") for f in df.schema if not has_map(f.dataType)])


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Rows that the driver holds, as an Arrow table: no Python worker makes it. Structs are dicts."""
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))


def told_apart(keyed: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """keyed, its column `key` (row_key; `keys` is a written table of it) made different for copies of a repeated row: the
    k-th copy gets a hash of the key and k. Which copy is which doesn't matter. Only a table that has repeated rows is
    shuffled for this."""
    if keys.groupBy(key).count().where("count > 1").isEmpty():
        return keyed
    k = F.row_number().over(Window.partitionBy(key).orderBy(key))
    return keyed.withColumn(key, F.when(k > 1, F.xxhash64(key, k)).otherwise(F.col(key)))


def hypergeometric(rng: random.Random, total: int, good: int, draws: int) -> int:
    """How many good ones are among `draws` drawn without replacement from `total`: exact inversion outward from the mode."""
    low, high = max(0, draws - (total - good)), min(good, draws)
    if low >= high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    f = math.lgamma
    choose = lambda n, k: f(n + 1) - f(k + 1) - f(n - k + 1)
    p = math.exp(choose(good, mode) + choose(total - good, draws - mode) - choose(total, draws))
    u, up, down, k, j = rng.random() - p, p, p, mode, mode
    while u > 0:
        moved = False
        if k < high:
            up *= (good - k) * (draws - k) / ((k + 1) * (total - good - draws + k + 1))
            k, moved = k + 1, True
            u -= up
            if u <= 0:
                return k
        if j > low:
            down *= j * (total - good - draws + j) / ((good - j + 1) * (draws - j + 1))
            j, moved = j - 1, True
            u -= down
            if u <= 0:
                return j
        if not moved:
            return mode
    return mode


def deal(rng: random.Random, counts: list[int], draws: int) -> list[int]:
    """A multivariate hypergeometric draw: how many of each kind are among `draws` of all."""
    left, out = sum(counts), []
    for c in counts:
        x = hypergeometric(rng, left, c, draws)
        out.append(x)
        left, draws = left - c, draws - x
    return out
