"""Best-fit packing of tokenised documents into sequences, by a grouping genetic algorithm on islands.

A document is its token ids and then id 0. Only documents longer than a sequence are cut, into sequence-long pieces of which
the last may be shorter; a full piece is a sequence by itself, and the rest are items of a bin-packing problem.

Search. Items are dealt by hash to blocks of bounded size; each block is a problem of its own, solved on several islands. A
chromosome is a list of bins (groups). Crossover injects whole well-filled bins of one parent into the other, drops the bins
that now hold duplicates, and best-fits the displaced documents; mutation dissolves the emptiest bins. After an epoch the
islands' elites migrate to a common population that evolves on. A block that meets its lower bound stops at once. Bins that
are well filled are final; documents of all others meet in fewer blocks in the next round, so that what the blocks waste at
their edges is packed together in the end.

Memory: a task holds a few thousand sizes, whatever the table's size; token ids never leave the task that made them.

Defined results. Null text is empty: one piece of one token (id 0). Repeated rows are packed each on its own. An empty table
gives an empty result. Extra columns are ignored. The result is the same for the same input partitions.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import in_batches, partitions, require, written

# --- tokens ------------------------------------------------------------------------------------------------------------

#: Characters for which the tokenizer's own normalisation and word pattern are restated below; other texts go to the tokenizer whole.
_PLAIN = re.compile(r"[^\t-\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")
#: What a tokenizer must be for its words to be looked up one by one.
_WORDWISE = {"normalizer": ["NFC", "Replace", "Lowercase"], "pre": ["Split", "ByteLevel"]}


def _byte_spelling() -> dict[int, int]:
    """Byte-level tokenizers spell each byte as a printable character: itself, or the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(rest)}


_SPELT = _byte_spelling()
_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """One encoder per worker process: what it remembers serves all of the worker's tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder(dict):
    """Token ids of whole texts as little-endian uint32 bytes; single words are remembered, as many as fit."""

    def __init__(self, path: str, most_words: int = 250_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most_words
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        # a text that may hold an added token (in any case, as it may be matched after normalisation) goes to the tokenizer whole
        self.added = [t["content"].lower() for t in spec["added_tokens"]]
        parts = lambda x, k: [p["type"] for p in (x or {}).get(k, [x or {"type": ""}])]
        self.wordwise = parts(spec["normalizer"], "normalizers") == _WORDWISE["normalizer"] and parts(spec["pre_tokenizer"], "pretokenizers") == _WORDWISE["pre"] and not spec["pre_tokenizer"]["pretokenizers"][1]["use_regex"]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        # a word is one piece: only the model's merges are left to do, on the byte-level spelling
        ids = self[word] = np.array([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_SPELT))], "<u4").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if not self.wordwise or _PLAIN.search(text):
            return self.whole(text)
        low = text.lower()
        if any(t in low for t in self.added):
            return self.whole(text)
        return b"".join(map(self.__getitem__, _WORD.findall(low)))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: uid (unique in this run), the id, piece, start, length, ids_crc32."""
    require(docs, **{text: T.StringType})
    path, tail = vocabulary or default_vocabulary(), int(end_id).to_bytes(4, "little")
    kind = T.StructType([T.StructField("uid", T.LongType()), docs.schema[id_col], *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long").fields])

    def cut(batches):
        encoder, uid = encoder_for(path), TaskContext.get().partitionId() << 33
        for table in in_batches(batches, 8 << 20):
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(table.column(1).to_pylist()):
                ids = (encoder.encode(t) if t else b"") + tail
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[a : a + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            ids = table.column(0).combine_chunks().take(pa.array(row, pa.int64()))
            out = {"uid": pa.array(np.arange(uid, uid + len(row))), id_col: ids, "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            uid += len(row)
            yield from pa.table(out).combine_chunks().to_batches()

    return docs.select(id_col, text).mapInArrow(cut, kind)


# --- the grouping genetic algorithm ------------------------------------------------------------------------------------


def best_fit(bins: list[list[int]], fills: list[int], items: list[int], sizes: list[int], capacity: int) -> None:
    """Adds ``items``, in their order, each to the fullest bin that has room; opens bins as needed."""
    room = sorted((capacity - f, b) for b, f in enumerate(fills) if f < capacity)
    for i in items:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
            fills.append(0)
        fills[b] += sizes[i]
        if left > sizes[i]:
            insort(room, (left - sizes[i], b))


class Packing:
    """A chromosome: bins of item numbers, how full they are, and the fitness (mean squared fill)."""

    __slots__ = ("bins", "fills", "fitness")

    def __init__(self, bins: list[list[int]], fills: list[int], capacity: int) -> None:
        self.bins, self.fills = bins, fills
        self.fitness = float(np.mean((np.array(fills) / capacity) ** 2)) if fills else 1.0

    @property
    def rank(self) -> tuple[int, float]:
        return len(self.bins), -self.fitness


def seeded(order: list[int], sizes: list[int], capacity: int) -> Packing:
    bins, fills = [], []
    best_fit(bins, fills, order, sizes, capacity)
    return Packing(bins, fills, capacity)


def crossed(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """The better bins of ``b`` whole into ``a``; bins of ``a`` with duplicates go, their other items are best-fitted."""
    order = np.argsort(-np.array(b.fills) + rng.integers(0, max(2, capacity // 64), len(b.fills)))
    chosen = order[: max(1, int(len(order) * rng.uniform(0.1, 0.6)))].tolist()
    taken = {i for k in chosen for i in b.bins[k]}
    bins, fills = [b.bins[k][:] for k in chosen], [b.fills[k] for k in chosen]
    loose = []
    for own, fill in zip(a.bins, a.fills, strict=True):
        if taken.isdisjoint(own):
            bins.append(own[:])
            fills.append(fill)
        else:
            loose += [i for i in own if i not in taken]
    loose.sort(key=sizes.__getitem__, reverse=True)
    best_fit(bins, fills, loose, sizes, capacity)
    return Packing(bins, fills, capacity)


def mutated(a: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """Dissolves the emptiest bins and a few others, and best-fits what they held."""
    order = np.argsort(a.fills, kind="stable")
    gone = set(order[:2].tolist()) | set(rng.integers(0, len(order), 3).tolist())
    bins = [x[:] for k, x in enumerate(a.bins) if k not in gone]
    fills = [f for k, f in enumerate(a.fills) if k not in gone]
    loose = [i for k in gone for i in a.bins[k]]
    loose.sort(key=lambda i: sizes[i] * rng.uniform(0.8, 1.2), reverse=True)
    best_fit(bins, fills, loose, sizes, capacity)
    return Packing(bins, fills, capacity)


def evolve(population: list[Packing], sizes: list[int], capacity: int, generations: int, rng: np.random.Generator) -> Packing:
    """The elite after some generations, or as soon as no packing can have fewer bins."""
    least = -(-sum(sizes) // capacity)
    population = sorted(population, key=lambda p: p.rank)
    for _ in range(generations):
        if len(population[0].bins) <= least:
            break
        size = len(population)
        young = []
        for _ in range(max(2, size // 2)):
            i, j = rng.integers(0, size, 2)
            child = crossed(population[min(i, j)], population[max(i, j)] if i != j else population[-1], sizes, capacity, rng)
            young.append(mutated(child, sizes, capacity, rng) if rng.random() < 0.5 else child)
        population = sorted([*population, *young], key=lambda p: p.rank)[:size]
    return population[0]


def founders(sizes: list[int], capacity: int, count: int, rng: np.random.Generator) -> list[Packing]:
    down = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    out = [seeded(down, sizes, capacity)]
    if len(out[0].bins) <= -(-sum(sizes) // capacity):
        return out
    for _ in range(count - 1):
        noise = rng.uniform(0.85, 1.15, len(sizes))
        out.append(seeded(sorted(down, key=lambda i: -sizes[i] * noise[i]), sizes, capacity))
    return out


# --- distribution ------------------------------------------------------------------------------------------------------


def _solve(items: DataFrame, *, round_no: int, blocks: int, capacity: int, islands: int, population: int, generations: int) -> DataFrame:
    """``items`` with block, bin and fill; two epochs with a migration of elites between them."""
    base = items.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(round_no)), F.lit(blocks)))
    spread = base.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    lone = T.StructType([*base.schema.fields, T.StructField("island", T.IntegerType()), T.StructField("bin", T.LongType())])
    done = T.StructType([*base.schema.fields, T.StructField("bin", T.LongType()), T.StructField("fill", T.LongType())])

    def island(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        sizes, rng = pdf["length"].tolist(), np.random.default_rng([round_no, int(key[0]), int(key[1])])
        best = evolve(founders(sizes, capacity, population, rng), sizes, capacity, generations, rng)
        bins = np.empty(len(sizes), np.int64)
        for b, own in enumerate(best.bins):
            bins[own] = b
        return pdf.assign(bin=bins)

    def migrate(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["island", "uid"], ignore_index=True)
        n = len(pdf) // islands
        sizes, rng, elites = pdf["length"][:n].tolist(), np.random.default_rng([round_no, int(key[0]), 1 << 20]), []
        for k in range(islands):
            place = pdf["bin"].to_numpy()[k * n : (k + 1) * n]
            order = np.argsort(place, kind="stable")
            bins = [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(place[order])) + 1)]
            elites.append(Packing(bins, [sum(sizes[i] for i in x) for x in bins], capacity))
        best = evolve([*elites, mutated(elites[0], sizes, capacity, rng)], sizes, capacity, generations, rng)
        out, bins, fills = pdf[:n].drop(columns=["island"]), np.empty(n, np.int64), np.empty(n, np.int64)
        for b, own in enumerate(best.bins):
            bins[own], fills[own] = b, best.fills[b]
        return out.assign(bin=bins, fill=fills)

    # rows are tiny, so their bytes say nothing of the work: the number of partitions is given, lest a few tasks get all blocks
    least = partitions(items.sparkSession)
    alone = spread.repartition(max(1, min(blocks * islands, 4 * least)), "block", "island").groupBy("block", "island").applyInPandas(island, lone)
    return alone.repartition(max(1, min(blocks, 4 * least)), "block").groupBy("block").applyInPandas(migrate, done)


def pack(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None, block_items: int = 3000, islands: int = 2, population: int = 5, generations: int = 12, rounds: int = 4, well_filled: float = 0.999) -> DataFrame:
    """One row per piece, with sequence_id and offset: the piece's place in its sequence."""
    cut = written(pieces(docs, text=text, id_col=id_col, capacity=capacity, end_id=end_id, vocabulary=vocabulary), "pieces")
    columns = [c for c in cut.columns if c != "uid"]
    results = [cut.filter(F.col("length") == capacity).select(*columns, F.col("uid").bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = cut.filter(F.col("length") < capacity)
    for r in range(rounds):
        n = left.count()
        if not n:
            break
        blocks = -(-n // block_items)
        last = blocks == 1 or r == rounds - 1
        solved = written(_solve(left, round_no=r, blocks=blocks, capacity=capacity, islands=islands, population=population, generations=generations), "packed")
        final = solved if last else solved.filter(F.col("fill") >= int(capacity * well_filled))
        results.append(_placed(final, r, columns))
        if last:
            break
        left = solved.filter(F.col("fill") < int(capacity * well_filled)).select(cut.columns)
    out = results[0]
    for x in results[1:]:
        out = out.unionByName(x)
    return out


def _placed(solved: DataFrame, round_no: int, columns: list[str]) -> DataFrame:
    """Numbers the sequences, and lays the pieces of each end to end: a bin is a few documents, so its window is small."""
    from pyspark.sql import Window

    before = Window.partitionBy("block", "bin").orderBy(F.desc("length"), "uid").rowsBetween(Window.unboundedPreceding, -1)
    return solved.select(
        *columns,
        (F.lit(round_no << 58) + F.shiftleft(F.col("block"), 20) + F.col("bin")).alias("sequence_id"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"),
    )


def report(docs: DataFrame) -> DataFrame:
    return pack(docs.select("doc_id", "text"))
