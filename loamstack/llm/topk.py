"""Exact top-k by inner product: a Voronoi kNN join on integer vectors.

Vectors are floor(scale * x). Pivots (from a bounded sample, refined by a few k-means steps) split the rows into Voronoi cells;
each cell is summarised by its count, its radius around the pivot and its greatest norm. A cell is cut into blocks of bounded
size, so a vector that a third of all rows share is no unbounded group.

A query block takes from the summaries and the pivot sample a lower bound on each of its queries' k-th best score: the k-th best
over the sample, itself excluded. A cell is needed by a query only if the upper bound q.p + |q| * radius (or |q| * greatest norm)
reaches that score; only the blocks of needed cells are replicated to the query block. Each (query block, data block) is solved
by one matrix product, keeps at most k candidates per query at or above the bound, and the candidates meet once per query.

Bounds only save work: no row is dropped unless a proof excludes it, and ties go to the smaller id.

Defined results. Vectors that are null or hold null or non-finite components take no part. Vectors of different lengths are
padded with zeros, and an empty one scores 0 with all. Rows with the query's own id are never its candidates. Repeated rows are
candidates each on its own, and a repeated query is answered once. Null ids take no part. Empty tables give empty results. Scores
beyond a signed 64-bit integer raise an error. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import in_batches, low_hash, require, written

_MARGIN = 1e-6


def integer_vectors(table: DataFrame, *, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, dim, vec): each usable vector as little-endian int64 bytes."""
    require(table, **{vector: T.ArrayType})
    usable = F.col(vector).isNotNull() & F.col(id_col).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))

    def pack(batches):
        for table in in_batches(batches, 16 << 20):
            lists = table.column(1).combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            x = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            scaled = np.floor(scale * x)
            if len(scaled) and np.abs(scaled).max() >= 2**62:
                raise OverflowError("a component doesn't fit a 64-bit integer")
            n = np.asarray(lists.value_lengths())
            data, ends = scaled.astype("<i8"), np.cumsum(n)
            yield pa.record_batch({"id": table.column(0).combine_chunks(), "dim": pa.array(n.astype(np.int32)), "vec": pa.array([data[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())})

    return table.filter(usable).select(F.col(id_col).cast("long").alias("id"), vector).mapInArrow(pack, "id long, dim int, vec binary")


def matrix(blobs, dim: int) -> np.ndarray:
    """The vectors as rows of int64, padded with zeros."""
    blobs = list(blobs)
    if all(len(b) == 8 * dim for b in blobs):
        return np.frombuffer(b"".join(blobs), "<i8").reshape(len(blobs), dim)
    out = np.zeros((len(blobs), dim), np.int64)
    for row, b in zip(out, blobs, strict=True):
        row[: len(b) // 8] = np.frombuffer(b, "<i8")
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in the narrowest floating type that holds every partial sum, else in integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound >= 1 << 63:
        raise OverflowError("an inner product may not fit a 64-bit integer")
    return a @ b.T


class Pivots:
    """Pivots, and the sample they were made from (which also gives the lower bounds)."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, count: int, steps: int = 5) -> None:
        self.ids, self.sample, self.dim = ids, sample, sample.shape[1]
        points = sample.astype(np.float64)
        self.at = points[np.unique(np.linspace(0, len(points) - 1, count).astype(int))].copy()
        for _ in range(steps):
            cell, _ = self.nearest(points)
            for k in range(len(self.at)):
                if (own := cell == k).any():
                    self.at[k] = points[own].mean(axis=0)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        square = (points**2).sum(axis=1)[:, None] - 2 * points @ self.at.T + (self.at**2).sum(axis=1)[None, :]
        cell = square.argmin(axis=1)
        return cell, np.sqrt(np.maximum(square[np.arange(len(points)), cell], 0))


def query_blocks(counts: dict[int, int], most: int) -> tuple[dict[int, int], dict[int, int]]:
    """For each cell its first query block and its number of blocks, for about ``most`` queries a block."""
    first, parts, block, held = {}, {}, -1, most
    for cell, n in sorted(counts.items()):
        parts[cell] = max(1, -(-n // most))
        if held + n > most:
            block, held = block + 1, 0
        first[cell] = block
        block, held = block + parts[cell] - 1, held + n if parts[cell] == 1 else most
    return first, parts


def top_k(table: DataFrame, *, k: int = 20, every: int = 20, id_col: str = "vec_id", vector: str = "embedding", scale: int = 64, sample_rows: int = 4096, block_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row whose id is divisible by ``every``."""
    spark = table.sparkSession
    data = written(integer_vectors(table, id_col=id_col, vector=vector, scale=scale), "vectors")
    shape = data.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    kind = "query_id long, rank int, vec_id long, score long"
    if not shape.n:
        return spark.createDataFrame([], kind)
    dim = max(1, shape.dim)
    # a bounded sample in the order of a hash of whole rows, whatever the size of the table; where that many rows are alike that
    # hardly any passes the filter, all rows are ordered
    key = F.xxhash64(F.lit(29), "id", "vec")
    first = lambda rows: rows.orderBy(key, "id").limit(sample_rows).collect()
    drawn = first(data.filter(low_hash(key, sample_rows, shape.n)))
    if len(drawn) < min(sample_rows, shape.n):
        drawn = first(data)
    count = int(min(1024, max(4, shape.n // 4096)))
    pivots = Pivots(np.array([r.id for r in drawn], np.int64), matrix((bytes(r.vec) for r in drawn), dim), count)
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        p = shared.value
        for t in in_batches(batches, 16 << 20):
            m = matrix(t.column(2).to_pylist(), dim).astype(np.float64)
            cell, far = p.nearest(m)
            yield pa.record_batch({"id": t.column(0).combine_chunks(), "vec": t.column(2).combine_chunks(), "cell": pa.array(cell.astype(np.int32)), "far": pa.array(far), "norm": pa.array(np.sqrt((m**2).sum(axis=1))), "salt": pa.array(np.arange(len(m)))})

    cells = written(data.mapInArrow(assign, "id long, vec binary, cell int, far double, norm double, salt long"), "cells")
    summary = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect()  # a row per pivot
    split = {r.cell: -(-r.n // block_rows) for r in summary}
    splits = F.element_at(F.create_map(*[F.lit(x) for r in summary for x in (r.cell, split[r.cell])]), F.col("cell"))
    # rows are dealt by place, not by id: rows that share one id, or are all alike, fill no block
    blocks = cells.withColumn("part", F.pmod(F.xxhash64("salt", F.lit(5)), splits).cast("int")).select("id", "vec", "cell", "part")
    # of rows that repeat a query's id the least vector asks, so that every run asks alike
    asked = cells.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("vec", "cell")).alias("v")).select("id", "v.*")
    # queries of one cell lie together: small cells share a block, a cell with more queries than a block holds has several
    first, parts = query_blocks({r.cell: r.n for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}, query_rows)  # a row per pivot
    of_cell = lambda x: F.element_at(F.create_map(*[F.lit(v) for c in first for v in (c, x[c])]), F.col("cell")) if first else F.lit(1)
    order = asked.select("id", "vec", "cell", (of_cell(first) + F.pmod(F.xxhash64("id"), of_cell(parts))).cast("int").alias("q"))
    far = {r.cell: (r.far, r.norm) for r in summary}

    def bounds(batches):
        """Each query's lower bound, and the cells that may beat it."""
        p = shared.value
        names = np.array(sorted(far))
        radius, norm = (np.array([far[c][i] for c in names.tolist()]) for i in (0, 1))
        for t in in_batches(batches, 4 << 20, 4096):
            q, ids = matrix(t.column(1).to_pylist(), dim), t.column(0).to_numpy()
            score = products(q, p.sample)
            score[ids[:, None] == p.ids[None, :]] = np.iinfo(np.int64).min
            least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(q), np.iinfo(np.int64).min)
            qf = q.astype(np.float64)
            size = np.sqrt((qf**2).sum(axis=1))
            upper = np.minimum(qf @ p.at[names].T + size[:, None] * radius[None, :], size[:, None] * norm[None, :])
            need = upper * (1 + _MARGIN) + np.abs(upper) * 2 * _MARGIN + 1e-3 >= least[:, None].astype(np.float64)
            yield pa.record_batch({"id": t.column(0).combine_chunks(), "vec": t.column(1).combine_chunks(), "q": t.column(3).combine_chunks(), "least": pa.array(least), "cells": pa.array([names[x].tolist() for x in need], pa.list_(pa.int32()))})

    queries = written(order.mapInArrow(bounds, "id long, vec binary, q int, least long, cells array<int>"), "queries")
    needed = queries.select(F.col("q").alias("dq"), F.explode("cells").alias("cell")).distinct()
    data_side = blocks.join(needed, "cell").select("dq", "cell", "part", "id", "vec")
    asked_of = queries.select("q", "id", "vec", "least", F.explode("cells").alias("cell"))
    query_side = asked_of.withColumn("part", F.explode(F.sequence(F.lit(0), (splits - 1).cast("int"))))

    def solve(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            right = right.sort_values("id", ignore_index=True)
            d, ids = matrix(right["vec"], dim), right["id"].to_numpy()
            for a in range(0, len(left), 512):
                some = left[a : a + 512]
                score = products(matrix(some["vec"], dim), d)
                own, least = some["id"].to_numpy(), some["least"].to_numpy()
                usable = (score >= least[:, None]) & (ids[None, :] != own[:, None])
                for i in np.flatnonzero(usable.any(axis=1)).tolist():
                    at = np.flatnonzero(usable[i])
                    s = score[i, at]
                    if len(at) > k:  # all above the k-th, then those equal to it by least id (ids ascend)
                        cut = np.partition(s, -k)[-k]
                        above, equal = at[s > cut], at[s == cut]
                        at = np.concatenate([above, equal[: k - len(above)]])
                    found.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[at], "score": score[i, at]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    from pyspark.sql import Window

    near = query_side.groupBy("q", "cell", "part").cogroup(data_side.groupBy("dq", "cell", "part")).applyInPandas(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings.select("vec_id", "embedding"))
