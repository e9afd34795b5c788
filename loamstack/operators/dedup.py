"""First-wins deduplication as windows: by canonical URL, by text hash, and unique ids with a suffix from the second use on.

``seq`` gives the order in which rows come first. Groups are ranked by a window over their key; the text itself never moves, only
its hash. Null keys are never duplicates of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, fingerprint
from .urls import canonical_url


def first_wins(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """``rows`` whose key comes for the first time; rows without a key all stay, and are kept out of the window."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(seq))
    first = rows.filter(F.col(key).isNotNull()).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    return first.unionByName(rows.filter(F.col(key).isNull()))


def by_text(rows: DataFrame, *, text: str = "text", id_col: str = "doc_id", seq: str | None = None) -> DataFrame:
    """(id, original_id, is_duplicate): the id of the first row of equal trimmed text."""
    seq = seq or id_col
    slim = rows.select(id_col, F.col(seq).alias("_seq"), content_hash(text).alias("_hash"))
    # the first of each hash by partial aggregation, so a hot text costs a row per task
    first = slim.filter("_hash IS NOT NULL").groupBy("_hash").agg(F.min_by(id_col, "_seq").alias("original_id"), F.min("_seq").alias("_first"))
    joined = slim.join(first, "_hash", "left")
    again = F.coalesce(F.col("_seq") != F.col("_first"), F.lit(False))
    return joined.select(id_col, F.when(again, F.col("original_id")).alias("original_id"), again.alias("is_duplicate"))


def distinct_texts(rows: DataFrame, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows that no earlier row repeats."""
    kept = by_text(rows.select(id_col, text), text=text, id_col=id_col).filter(~F.col("is_duplicate")).select(F.col(id_col).alias("_kept"))
    return rows.join(kept, F.col(id_col).eqNullSafe(F.col("_kept")), "left_semi")


def by_url(rows: DataFrame, *, url: str = "url", seq: str) -> DataFrame:
    """``rows`` whose canonical URL comes for the first time."""
    return first_wins(rows.withColumn("_canonical", canonical_url(url)), "_canonical", seq).drop("_canonical")


def unique_ids(rows: DataFrame, *, base: str, url: str, seq: str, name: str = "id") -> DataFrame:
    """``rows`` with an id: the base at its first use, then the base and six digits of the URL's SHA-1."""
    rank = F.row_number().over(Window.partitionBy(base).orderBy(seq))
    return rows.withColumn("_use", rank).withColumn(name, F.when(F.col("_use") == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), F.substring(F.sha1(url), 1, 6)))).drop("_use")


def duplicate_groups(rows: DataFrame, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(fingerprint, n, first_id): texts that differ in case, accents and punctuation only."""
    return rows.groupBy(fingerprint(text).alias("fingerprint")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).filter("n > 1")


def duplicate_values(rows: DataFrame, key: str) -> DataFrame:
    """Values that occur more than once, in order."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").orderBy(key)
