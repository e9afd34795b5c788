"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned against every token window.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A test item gives its windows of ``width``
consecutive words; an item of fewer words, but not none, is one window. Each training text is scanned whole: its words
become ids of the test vocabulary, rolling hashes of the id windows are looked up in a sorted hash set, and every hit is
verified against the ids themselves, so that a hash collision never counts.

Defined results. Null text: no words, no hit. A null or wordless test item gives no window. Null item ids are left out of
item lists. Repeated rows are scanned each on its own. An empty table gives an empty result; an empty test set hits nothing.
Extra columns of the training table pass through untouched; a table that has columns of the results' names is refused.

Size. The test set is broadcast in slices of at most ``slice_bytes`` of text, each of which becomes flat arrays of about eight times
its size (and an entry per distinct word). One slice is the usual case. A larger test set takes one scan per slice; what a scan
finds is written to the shared folder, so that a task holds one slice at a time, and the spans are merged per document.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Powers, drop_written, free_name, in_batches, require, rolling, written

_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Appended columns.
PREFIX = "_dc_"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class NgramSet:
    """The windows of some test items in flat arrays: per width the distinct windows' hashes (sorted), one place of each in the
    items' words, and the items that hold it."""

    def __init__(self, items: list[tuple[object, bytes | None]], width: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names = [None if item is None else str(item) for item, _ in items]
        words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32) for _, text in items]
        self.flat = np.concatenate([np.empty(0, np.int32), *words])
        sizes = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(sizes) - sizes
        self.widths: dict[int, tuple[np.ndarray, ...]] = {}
        for k in sorted({min(width, n) for n in sizes.tolist()} - {0}):
            own = np.flatnonzero(np.minimum(sizes, width) == k)
            n = sizes[own] - k + 1
            item = np.repeat(own, n)
            start = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            self.widths[k] = self._grouped(k, item.astype(np.int32), start)

    def _grouped(self, k: int, item: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
        """(hashes, a start of each, base of the hash, first of each window's items, items)."""
        base = Powers().base
        while True:
            h = rolling(self.flat.astype(np.uint64), k, Powers(base))[start]
            order = np.lexsort((item, h))
            new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
            run, heads = np.cumsum(new) - 1, start[order[new]]
            same = np.ones(len(order), bool)
            for j in range(k):  # windows of one hash must be equal; else another base tells them apart
                same &= self.flat[start[order] + j] == self.flat[heads[run] + j]
            if same.all():
                break
            base += 2
        once = new | np.concatenate([[True], item[order[1:]] != item[order[:-1]]])
        return h[order[new]], heads, base, np.searchsorted(run[once], np.arange(len(heads) + 1)).astype(np.int32), item[order[once]]

    def scan(self, words: list[bytes], powers: dict[int, Powers]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the items found."""
        n = len(words)
        hit, items = np.zeros(n, bool), set()
        if not n or not self.widths:
            return hit, items
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, n)
        if not ids.any():
            return hit, items
        known = np.zeros(n + 1, np.int64)
        np.cumsum(ids != 0, out=known[1:])
        codes = None
        for k, (hashes, heads, base, first, owners) in self.widths.items():
            if n < k:
                continue
            starts = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(starts):
                continue
            codes = ids.astype(np.uint64) if codes is None else codes
            h = rolling(codes, k, powers.setdefault(base, Powers(base)))[starts]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            found = np.flatnonzero(hashes[at] == h)
            for i, w in zip(starts[found].tolist(), at[found].tolist(), strict=True):
                if (ids[i : i + k] == self.flat[heads[w] : heads[w] + k]).all():
                    hit[i : i + k] = True
                    items.update(owners[first[w] : first[w + 1]].tolist())
        return hit, items


def _slices(benchmark: DataFrame, item: str, text: str, slice_bytes: int):
    """The test set in driver-sized slices, in the order of the items."""
    held, size = [], 0
    for row in benchmark.select(F.col(item), F.col(text).cast("binary")).toLocalIterator(prefetchPartitions=False):
        raw = None if row[1] is None else bytes(row[1])
        held.append((row[0], raw))
        size += len(raw or b"")
        if size >= slice_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 13, slice_bytes: int = 12 << 20, clean: bool = False) -> DataFrame:
    """``docs`` with ``_dc_n_words``, ``_dc_n_hit``, ``_dc_items`` (sorted ids as strings) and ``_dc_spans`` (hit [start, end)
    word spans as int pairs); with ``clean``, also ``_dc_clean``: the text whose hit words are cut out (unchanged if none is)."""
    require(docs, **{text: T.StringType})
    context, out, names, last = docs.sparkSession.sparkContext, docs, [], None
    free_name(docs, *(f"{PREFIX}{n}" for n in ("n_words", "n_hit", "items", "spans", "clean", "0")))
    for held in _slices(benchmark, item, item_text, slice_bytes):
        if last is not None:
            names.append(f"{PREFIX}{len(names)}")
            step = _scanner(last, out.columns.index(text), names[-1])
            found = written(out.mapInArrow(_each(step), T.StructType([*out.schema.fields, _found_field(names[-1])])), "scanned")
            if len(names) > 1:
                drop_written(out)
            out = found
            last.destroy()  # what it found is written
        last = context.broadcast(NgramSet(held, width))
    last = last or context.broadcast(NgramSet([], width))
    names.append(f"{PREFIX}{len(names)}")
    # the last scan and the merge are one step: a task has one Python worker
    scan, (merge, schema) = _scanner(last, out.columns.index(text), names[-1]), _merger(docs.schema, names, text, clean)
    return out.mapInArrow(_each(lambda table: merge(scan(table))), schema)


def _each(step):
    def run(batches):
        for table in in_batches(batches):
            yield from step(table).combine_chunks().to_batches()

    return run


def _found_field(name: str) -> T.StructField:
    return T.StructField(name, T.StructType([T.StructField("n", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))]))


def _scanner(shared, at: int, name: str):
    """Table to table: adds a struct of what one slice hits."""
    kind = pa.struct([("n", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])

    def scan(table: pa.Table) -> pa.Table:
        grams, powers, found = shared.value, {}, []
        for raw in table.column(at).cast(pa.binary()).to_pylist():
            hit, items = grams.scan(words_of(raw), powers)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))) if items else ()
            found.append({"n": len(hit), "spans": list(map(int, edge)), "items": sorted({grams.names[i] for i in items} - {None})})
        return table.append_column(name, pa.array(found, kind))

    return scan


def _merger(docs: T.StructType, names: list[str], text: str, clean: bool):
    """(table to table, schema): sums the slices up per document, still in the document's own row."""
    added = [T.StructField(f"{PREFIX}n_words", T.LongType()), T.StructField(f"{PREFIX}n_hit", T.LongType()), T.StructField(f"{PREFIX}items", T.ArrayType(T.StringType())), T.StructField(f"{PREFIX}spans", T.ArrayType(T.IntegerType()))]
    if clean:
        added.append(T.StructField(f"{PREFIX}clean", T.StringType()))
    width, at = len(docs.fields), docs.names.index(text)
    kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": pa.list_(pa.int32()), "clean": pa.string()}

    def merge(table: pa.Table) -> pa.Table:
        rows = {f.name: [] for f in added}
        raws = table.column(at).cast(pa.binary()).to_pylist()
        parts = [table.column(width + k).to_pylist() for k in range(len(names))]
        for i, raw in enumerate(raws):
            n = parts[0][i]["n"]
            hit, items = np.zeros(n, bool), set()
            for p in parts:
                edge = p[i]["spans"]
                for a, b in zip(edge[::2], edge[1::2], strict=True):
                    hit[a:b] = True
                items.update(p[i]["items"])
            edge = [int(x) for x in np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))] if n else []
            rows[f"{PREFIX}n_words"].append(n)
            rows[f"{PREFIX}n_hit"].append(int(hit.sum()))
            rows[f"{PREFIX}items"].append(sorted(items))
            rows[f"{PREFIX}spans"].append(edge)
            if clean:
                rows[f"{PREFIX}clean"].append(None if raw is None else cut(raw, edge).decode("utf-8", "replace"))
        done = table.select(range(width))
        for f in added:
            done = done.append_column(f.name, pa.array(rows[f.name], kinds[f.name.removeprefix(PREFIX)]))
        return done

    return merge, T.StructType([*docs.fields, *added])


def cut(raw: bytes, edges: list[int]) -> bytes:
    """``raw`` without the bytes from the first to the last word of each hit span."""
    if not edges:
        return raw
    flat = raw.translate(_WORDS)
    spans, at = [], 0
    for w in flat.split():
        at = flat.index(w, at)
        spans.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out.append(raw[last : spans[a][0]])
        last = spans[b - 1][1]
    return b"".join([*out, raw[last:]])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: how many of its words are hit, by which items, and whether it is contaminated (a 20th of its words)."""
    found = scan_benchmark(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        F.col(f"{PREFIX}n_words").alias("n_words"),
        F.col(f"{PREFIX}n_hit").alias("n_hit"),
        F.size(f"{PREFIX}items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{PREFIX}items", ","), 256).alias("items_sha256"),
        ((F.col(f"{PREFIX}n_hit") > 0) & (F.col(f"{PREFIX}n_hit") * 20 >= F.col(f"{PREFIX}n_words"))).alias("contaminated"),
    )
