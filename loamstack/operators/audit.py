"""Integrity audits and quality reports of parents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, token_count


def orphans(children: DataFrame, parents: DataFrame, *, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is not there (null keys have none)."""
    known = parents.select(F.col(parent_key).alias("_parent"))
    return children.join(known, F.col(child_key) == F.col("_parent"), "left_anti")


def with_active_parents(children: DataFrame, parents: DataFrame, active: Column, *, child_key: str, parent_key: str) -> DataFrame:
    known = parents.filter(active).select(F.col(parent_key).alias("_parent"))
    return children.join(known, F.col(child_key) == F.col("_parent"), "left_semi")


def without_active_parents(children: DataFrame, parents: DataFrame, active: Column, *, child_key: str, parent_key: str) -> DataFrame:
    """The complement: children of inactive parents and orphans."""
    known = parents.filter(active).select(F.col(parent_key).alias("_parent"))
    return children.join(known, F.col(child_key) == F.col("_parent"), "left_anti")


def token_report(chunks: DataFrame, *, text: str = "text", most: int = 650, short: int = 50) -> DataFrame:
    """One row: number of chunks, tokens (min, max, mean to two places, median), how many are over and under the limits, empties."""
    n = chunks.select(token_count(text).alias("t"), (F.trim(F.coalesce(F.col(text), F.lit(""))) == "").alias("e"))
    return n.agg(
        F.count("*").alias("chunk_count"), F.min("t").alias("min_tokens"), F.max("t").alias("max_tokens"), F.round(F.avg("t"), 2).alias("mean_tokens"), F.median("t").alias("median_tokens"),
        F.count_if(F.col("t") > most).alias("over_limit"), F.count_if(F.col("t") < short).alias("under_limit"), F.count_if("e").alias("empty"),
    )


def empty_fields(rows: DataFrame, fields: list[str], *, key: str) -> DataFrame:
    """(field, n_empty, first_key): which named fields are null or blank, per field, in long form."""
    long = rows.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")).select(key, "x.*")
    return long.filter(F.coalesce(F.trim("value"), F.lit("")) == "").groupBy("field").agg(F.count("*").alias("n_empty"), F.min(key).alias("first_key"))


def counters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(counter, value, n): one pass over the rows for a count by each key."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("counter"), F.col(k).cast("string").alias("value")) for k in keys))).alias("x")).select("x.*")
    return long.groupBy("counter", "value").agg(F.count("*").alias("n"))


def coverage(found: DataFrame, wanted: DataFrame, *, key: str) -> DataFrame:
    """(key, state): keys that are missing, and keys that nobody asked for."""
    missing = wanted.select(key).join(found.select(key), key, "left_anti").select(key, F.lit("missing").alias("state"))
    extra = found.select(key).join(wanted.select(key), key, "left_anti").select(key, F.lit("extra").alias("state"))
    return missing.unionByName(extra)


def ranges(rows: DataFrame, value: str, *, by: list[str]) -> DataFrame:
    """(by, first, last, label): runs of consecutive integers per group, repeats ignored; label is ``3`` or ``3-7``."""
    distinct = rows.select(*by, value).filter(F.col(value).isNotNull()).distinct()
    island = F.col(value) - F.row_number().over(Window.partitionBy(*by).orderBy(value))
    grouped = distinct.withColumn("_island", island).groupBy(*by, "_island").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("_island")
    return grouped.withColumn("label", F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string"))))


def capped(rows: DataFrame, *, by: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group: a limit that is the feature (pages per source)."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_rank") <= most).drop("_rank")


def lookup(rows: DataFrame, table: DataFrame, *, key: str, values: dict[str, object]) -> DataFrame:
    """Left join with a default record for what the table does not know."""
    joined = rows.join(table, key, "left")
    return joined.select(*rows.columns, *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in values.items()))


def fallback_summary(c: Column | str) -> Column:
    """A profile in fixed lines from nested JSON; unknown values are N/D."""
    at = lambda path: F.coalesce(F.get_json_object(col(c), path), F.lit("N/D"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("- Nombre: "), at("$.identity.razon_social"), F.lit(" ("), at("$.ruc"), F.lit(")")),
        F.concat(F.lit("- Estado: "), at("$.identity.estado"), F.lit(" / "), at("$.identity.condicion")),
        F.concat(F.lit("- Rubro: "), at("$.activity.ciiu_principal"), F.lit(" / "), at("$.activity.tipo_contribuyente")),
        F.concat(F.lit("- Lugar: "), at("$.activity.distrito"), F.lit(" / "), at("$.activity.nro_trabajadores")),
    )


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key)
