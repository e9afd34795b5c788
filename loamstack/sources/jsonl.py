"""JSON Lines: a strict reader that reports its bad lines, a lenient one for files that may be missing, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BAD = "_corrupt_record"


class BadLines(ValueError):
    """Lines that are no JSON objects; ``lines`` has the first of them."""

    def __init__(self, lines: list[str]) -> None:
        super().__init__(f"{len(lines)} or more bad lines: " + "; ".join(x[:80] for x in lines[:5]))
        self.lines = lines


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_strict(spark: SparkSession, path: str, schema: T.StructType, report: int = 20) -> DataFrame:
    """Raises ``BadLines`` with the first bad lines if there are any; blank lines are skipped."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("r"))
    bad = parsed.filter(F.col(f"r.{_BAD}").isNotNull() | F.col("r").isNull() | ~F.trim("value").startswith("{")).limit(report).collect()
    if bad:
        raise BadLines([b.value for b in bad])
    return parsed.select(*(F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields))


def read_lenient(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An empty table if the path is missing; a bad line raises when read."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_many(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """All of the paths that exist, in one table; a bad line raises when read."""
    there = [p for p in paths if exists(spark, p)]
    return spark.read.schema(schema).option("mode", "FAILFAST").json(there) if there else spark.createDataFrame([], schema)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Fields that are null are left out; the commit is atomic."""
    rows.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)
