"""Tables that other systems read: the vector collection, reports and named cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.retrieval import flat_metadata


def rebuild_collection(chunks: DataFrame, path: str, *, id_col: str = "id", document: str = "page_content", vector: str = "embedding", metadata: str = "metadata") -> None:
    """Replaces a vector collection (id, document, embedding, metadata) as a whole; null metadata are left out."""
    chunks.select(F.col(id_col).alias("id"), F.col(document).alias("document"), F.col(vector).cast("array<float>").alias("embedding"), flat_metadata(metadata).alias("metadata")).write.mode("overwrite").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON Lines file."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def named_cells(rows: DataFrame, names: tuple[str, ...], *, cells: str = "cells") -> DataFrame:
    """Table rows with a column per cell."""
    return rows.select(*(c for c in rows.columns if c != cells), *(F.try_element_at(F.col(cells), F.lit(i)).alias(n) for i, n in enumerate(names, start=1)))
