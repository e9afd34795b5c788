"""What the operators of this subpackage share: table reading, shared-folder tables, rolling hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_WORD = (1 << 64) - 1


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Arrow batches of texts small enough for executors of a few GB; a setting that is stricter already stays."""
    for key, most, now in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows, 10_000), ("spark.sql.execution.arrow.maxBytesPerBatch", size, 64 << 20)):
        held = re.match(r"(-?\d+)", spark.conf.get(key, str(now)))
        if held and (int(held[1]) <= 0 or int(held[1]) >= now):
            spark.conf.set(key, str(most))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only in local mode, where all is one machine, a temporary
    one takes its place if none is set; a cluster without one raises an error, as each executor would write to a disk of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="loamstack-shared-")
        atexit.register(shutil.rmtree, base[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files behind a table of ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def require(df: DataFrame, **columns: type[T.DataType]) -> None:
    """Fails early, with the name, where a column is missing or of another type."""
    for name, kind in columns.items():
        if name not in df.columns:
            raise ValueError(f"column {name!r} is missing; there are {df.columns}")
        if not isinstance(df.schema[name].dataType, kind):
            raise TypeError(f"column {name!r} is {df.schema[name].dataType.simpleString()}")


def fold_bucket(column: str, modulus: int):
    """crc32 of the value as text, modulo ``modulus``: the folds that held-out rows are chosen by."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def free_name(df: DataFrame, *names: str) -> None:
    """Fails early where a column that is to be added is there already: its values would be lost or mixed up."""
    if taken := [n for n in names if n.lower() in {c.lower() for c in df.columns}]:
        raise ValueError(f"columns {taken} are there already; rename them, or choose another name for the result")


def low_hash(key: Column, most: int, rows: Column | int) -> Column:
    """Whether a row can be among the first ``most`` of ``rows`` in the order of the hash ``key``: lets about twice as many and a
    thousand through, all of a small table, so that a sample costs the same shuffle on any number of tasks."""
    return key / F.lit(2.0**64) + 0.5 < F.lit(2.0 * most + 1000) / rows


def key_sample(rows: DataFrame, *, key: str, by: str, most: int) -> DataFrame:
    """(by, key): for each value of ``by`` its first ``most`` distinct values of the hash ``key``, ascending.

    Repeated keys count once and collapse before the shuffle, so rows that are all alike make no large group. Where that many
    repeat that too few keys pass ``low_hash``, the values of ``by`` concerned are drawn again from all their keys. A row per
    value of ``by`` is counted on the driver's side and broadcast."""
    sizes = written(rows.groupBy(by).agg(F.count("*").alias("_n")), "sizes")
    order = Window.partitionBy(by).orderBy(key)
    first = lambda df: df.select(by, key).distinct().withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).select(by, key)
    drawn = written(first(rows.join(F.broadcast(sizes), by).filter(low_hash(F.col(key), most, F.col("_n")))), "drawn")
    got = drawn.groupBy(by).agg(F.count("*").alias("_got"))
    short = sizes.join(got, by, "left").filter(F.coalesce("_got", F.lit(0)) < F.least("_n", F.lit(most))).filter(F.col("_n") > 2 * most + 1000).select(by)
    if not short.head(1):
        return drawn
    return drawn.join(F.broadcast(short), by, "left_anti").unionByName(first(rows.join(F.broadcast(short), by, "left_semi")))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int = _BASE) -> None:
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches all output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(codes: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Hash of each ``width`` consecutive codes (uint64); empty if there are fewer."""
    n = len(codes)
    if n < width:
        return np.empty(0, np.uint64)
    powers.grow(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * powers.up[:n], out=total[1:])
    return mixed((total[width:] - total[:-width]) * powers.down[: n - width + 1])


def free_memory() -> None:
    """Gives what a task has freed back to the system: workers live on, and an operator's leavings would burden the next one."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def in_batches(batches: Iterable[pa.RecordBatch], most_bytes: int = 16 << 20, most_rows: int = 20_000) -> Iterator[pa.Table]:
    """Joins small Arrow batches into tables of bounded size; frees what the task has left when they end."""
    held, rows, size = [], 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= most_rows or size >= most_bytes:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)
    held = []
    free_memory()
