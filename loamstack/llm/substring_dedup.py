"""Exact substring dedup over word windows: windows meet by a prefix, in groups that fit in memory.

A window is ``width`` consecutive words (``[^\\x20\\x09-\\x0D]+``) of one document; every word under a window whose words
also start anywhere else (same document included) is removed.

Method. The dealt one - suffix trees over suffixes partitioned by variable-length prefixes - would ship each suffix with its
``width`` words, many times the corpus, and is not what is done here. Only its first step is kept: suffixes meet by a prefix. The
prefix has a fixed length and a place chosen by content: in each window, the ``prefix``-gram of least hash (a minimiser). Equal
windows choose equal prefixes at equal offsets, so all occurrences of a repeated window meet in the group of one prefix, and
groups are dealt to memory-sized buckets. Two rounds:

1. count the prefixes; those that occur once cannot be part of a repeat and drop out (most do);
2. for the rest only, ship per anchor the 64-bit signatures of the windows it owns; in a bucket, sort by (prefix, window): every
   run of two or more is a repeat, and goes back to its documents. There is no tree of pointers.

Each round combines before its shuffle: of occurrences that repeat inside one batch all are marked on the spot, and a single
one travels with a mark. A passage that a third of the corpus shares is therefore one record per batch, not one per document.

Equality rests on hashes, words are not compared again: two windows count as equal if the hash of the prefix and that of the window
agree. Each is of 64 bits, and they are made from different halves of each word's 128-bit code, so they are independent: among
10^12 windows about 10^-15 wrong pairs are due. Documents are named by two hashes of id and text, 128 bits as well.

Defined results. Null or wordless text: no words, nothing removed. Texts of fewer than ``width`` words never lose a word.
Repeated rows are occurrences of each other. Extra columns pass through ``remove_repeats``, which refuses a table that has columns
of its results' names; an empty table stays empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Powers, free_name, in_batches, mixed, partitions, require, rolling

_KEY, _OTHER_KEY, _FOUND = "_ss_key", "_ss_other", "_ss_found"
_NAME = [_KEY, _OTHER_KEY]  # of a document
_U64, _U32 = np.dtype("<u8"), np.dtype("<u4")
#: A second, independent base for the windows.
_OTHER = 0xD6E8FEB86659FD93


class Codes(dict):
    """Word to 128-bit code; forgets all when full, so memory stays bounded."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 200_000:
            self.clear()
        code = self[word] = xxhash.xxh3_128_digest(word, 7)
        return code


class Anchors:
    """Splits a text into owned windows: for each anchor its prefix hash, first window and number of windows."""

    def __init__(self, width: int, prefix: int) -> None:
        self.width, self.prefix, self.codes, self.powers, self.other = width, prefix, Codes(), Powers(), Powers(_OTHER)

    def word_codes(self, raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Two codes of each word, of which the first makes prefixes and the second windows."""
        both = np.frombuffer(b"".join(map(self.codes.__getitem__, raw.split())) if raw else b"", _U64)
        return both[::2], both[1::2]

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(prefix hashes, first windows, counts) in text order."""
        n = len(codes) - self.width + 1
        if n <= 0:
            return np.empty(0, _U64), np.empty(0, np.int64), np.empty(0, np.int64)
        g, span = rolling(codes, self.prefix, self.powers), self.width - self.prefix + 1
        own = np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1) + np.arange(n)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        return g[own[first]], first, np.diff(np.append(first, n))

    def windows(self, codes: np.ndarray) -> np.ndarray:
        return rolling(codes, self.width, self.other)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order by the keys, the start of each run of equal keys in it, and the run of each place."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _expanded(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... first[0]+count[0]-1, first[1], ..."""
    total = int(count.sum())
    start = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if total else np.empty(0, np.int64)
    return start + np.arange(total)


#: What travels to a bucket: records to compare, or finds that are sure already (documents' keys and places in them).
_SENT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("sure", T.BooleanType()), T.StructField("blob", T.BinaryType())])
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("sure", pa.bool_()), ("blob", pa.binary())])
_FOUND_ARROW = pa.schema([(_KEY, pa.int64()), (_OTHER_KEY, pa.int64()), (_FOUND, pa.binary())])
_PLACE = np.dtype([("key", _U64), ("other", _U64), ("place", _U32)])


def _places(count: int, key: int, other: int, place: np.ndarray) -> np.ndarray:
    out = np.empty(count, _PLACE)
    out["key"], out["other"], out["place"] = np.uint64(key % (1 << 64)), np.uint64(other % (1 << 64)), place
    return out


def _sure(at: np.ndarray, buckets: int) -> list[tuple[int, bool, bytes]]:
    """Finds, packed by the bucket of their document: a few large rows, however many documents there are."""
    return [(b, True, x.tobytes()) for b, x in _by_bucket(at, mixed(at["key"]), buckets)]


def _by_bucket(records: np.ndarray, deal: np.ndarray, buckets: int):
    to = (deal % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    at = np.searchsorted(to[by], np.arange(buckets + 1))
    return [(b, records[by[at[b] : at[b + 1]]]) for b in range(buckets) if at[b + 1] > at[b]]


def _sent(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _SENT_ARROW.field(i).type) for i in range(3)], schema=_SENT_ARROW)


def _record(keys: int) -> np.dtype:
    return np.dtype([*((f"k{i}", _U64) for i in range(keys)), *((n, _PLACE[n]) for n in _PLACE.names), ("more", np.uint8)])


def _collapsed(buckets: int, deal: np.ndarray, keys: tuple[np.ndarray, ...], at: np.ndarray):
    """Marks what repeats inside this batch; lets one occurrence per distinct record travel.

    ``keys`` decide equality, ``deal`` the bucket, ``at`` is the document and the place in it."""
    order, starts, run = _runs(*keys)
    size = np.bincount(run, minlength=len(starts)) if len(order) else np.empty(0, np.int64)
    again = size[run] > 1
    rows = _sure(at[order[again]], buckets) if again.any() else []
    one = order[starts]
    record = np.empty(len(one), _record(len(keys)))
    for i, k in enumerate(keys):
        record[f"k{i}"] = k[one]
    for n in _PLACE.names:
        record[n] = at[n][one]
    record["more"] = size > 1
    return rows + [(b, False, x.tobytes()) for b, x in _by_bucket(record, mixed(deal[one]), buckets)]


def _meet(keys: int, buckets: int):
    """In a bucket: records that meet an equal one, or come marked, are found; a marked one is known at home."""
    kind = _record(keys)

    def meet(batches):
        """A bucket may come as several batches; its partition holds whole buckets. What is sure passes through."""
        blobs: dict[int, list[bytes]] = {}
        for b in batches:
            if (sure := b.filter(b.column(1))).num_rows:
                yield sure
            b = b.filter(pc.invert(b.column(1)))
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                blobs.setdefault(bucket, []).append(blob)
        for held in blobs.values():
            r = np.frombuffer(b"".join(held), kind)
            order, starts, run = _runs(*(r[f"k{i}"] for i in range(keys)))
            size = np.bincount(run, minlength=len(starts))
            found = order[(size[run] > 1) & (r["more"][order] == 0)]
            if len(found):
                at = np.empty(len(found), _PLACE)
                for n in _PLACE.names:
                    at[n] = r[n][found]
                yield _sent(_sure(at, buckets))

    return meet


def _gather(batches):
    """One row per document, with all its finds: a partition holds whole documents."""
    held = [np.frombuffer(x, _PLACE) for b in batches for x in b.column(2).to_pylist()]
    if not held:
        return
    r = np.concatenate(held)
    order, starts, _ = _runs(r["key"], r["other"], r["place"].astype(_U64))
    r = r[order[starts]]
    new = np.ones(len(r), bool)
    new[1:] = (r["key"][1:] != r["key"][:-1]) | (r["other"][1:] != r["other"][:-1])
    edge, place = np.flatnonzero(new), np.ascontiguousarray(r["place"])
    ends = np.append(edge[1:], len(r)).tolist()
    for s in range(0, len(edge), 10_000):
        some = edge[s : s + 10_000]
        names = [pa.array(r[n][some].astype(np.int64)) for n in ("key", "other")]
        yield pa.RecordBatch.from_arrays([*names, pa.array([place[a:b].tobytes() for a, b in zip(some.tolist(), ends[s : s + 10_000], strict=True)], pa.binary())], schema=_FOUND_ARROW)


def _gathered(sent: DataFrame, keys: int, buckets: int) -> DataFrame:
    """One row per document: its key and the places found in it."""
    met = sent.repartition(buckets, "bucket").mapInArrow(_meet(keys, buckets), _SENT)
    return met.repartition(buckets, "bucket").mapInArrow(_gather, f"{_KEY} long, {_OTHER_KEY} long, {_FOUND} binary")


def find_repeats(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", width: int = 35, prefix: int = 18, bucket_rows: int = 4_000_000) -> DataFrame:
    """``docs`` with its two keys and ``_ss_found``: the uint32 starts of repeated windows (null: none)."""
    require(docs, **{text: T.StringType})
    free_name(docs, *_NAME, _FOUND)
    if not 0 < prefix <= width:
        raise ValueError("prefix must lie in 1..width")
    spark = docs.sparkSession
    keyed = docs.withColumn(_KEY, F.xxhash64(F.col(id_col), F.col(text))).withColumn(_OTHER_KEY, F.xxhash64(F.lit(11), F.col(id_col), F.col(text)))
    slim = keyed.select(_KEY, _OTHER_KEY, text)
    # a word takes two bytes at least, one anchor in (width - prefix + 2) / 2 words
    size = slim.select(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = partitions(spark, 1 + int(size / 5 * 2 / (width - prefix + 2)) // bucket_rows)

    def count(batches):
        split = Anchors(width, prefix)
        for table in in_batches(batches, 12 << 20):
            parts = []
            for key, other, raw in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), table.column(2).cast(pa.binary()).to_pylist(), strict=True):
                g, first, _ = split.of(split.word_codes(raw)[0])
                if len(g):
                    parts.append((g, _places(len(g), key, other, first)))
            if parts:
                g, at = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield _sent(_collapsed(buckets, g, (g,), at))

    anchors = _gathered(slim.mapInArrow(count, _SENT), 1, buckets)
    place, last = keyed.columns.index(text), len(keyed.columns)

    def compare(batches):
        split = Anchors(width, prefix)
        for table in in_batches(batches, 12 << 20):
            parts = []
            for key, other, raw, blobs in zip(table.column(last - 2).to_pylist(), table.column(last - 1).to_pylist(), table.column(place).cast(pa.binary()).to_pylist(), table.column(last).to_pylist(), strict=True):
                codes, others = split.word_codes(raw)
                g, first, n = split.of(codes)
                wanted = np.frombuffer(blobs, _U32).astype(np.int64)
                at = np.flatnonzero(np.isin(first, wanted, assume_unique=True))
                starts = _expanded(first[at], n[at])
                parts.append((np.repeat(g[at], n[at]), split.windows(others)[starts], _places(len(starts), key, other, starts)))
            g, h, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(g):
                yield _sent(_collapsed(buckets, g, (g, h), at))

    # both joins deal all columns of the documents by the same key, so that Spark shuffles the texts once and reads them twice
    suspects = keyed.join(anchors, _NAME).select(*keyed.columns, _FOUND)
    windows = _gathered(suspects.mapInArrow(compare, _SENT), 2, buckets)
    return keyed.join(windows, _NAME, "left").select(*keyed.columns, _FOUND)


def _removed(n: int, found: bytes | None, width: int) -> np.ndarray:
    """Which of ``n`` words a repeated window covers."""
    if not found:
        return np.zeros(n, bool)
    starts = np.frombuffer(found, _U32).astype(np.int64)
    edge = np.bincount(starts, minlength=n + 1)[: n + 1] > 0
    level = np.cumsum(edge) - np.cumsum(np.concatenate([np.zeros(width, bool), edge])[: n + 1])
    return level[:n] > 0


def remove_repeats(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", width: int = 35, prefix: int = 18) -> DataFrame:
    """``docs`` with ``_ss_n_words``, ``_ss_n_removed`` and ``_ss_kept`` (kept words joined by one space; the text itself where
    nothing is removed, null for null)."""
    free_name(docs, "_ss_n_words", "_ss_n_removed", "_ss_kept")
    found = find_repeats(docs, text=text, id_col=id_col, width=width, prefix=prefix)
    keep = [f for f in docs.schema.fields]
    schema = T.StructType([*keep, T.StructField("_ss_n_words", T.LongType()), T.StructField("_ss_n_removed", T.LongType()), T.StructField("_ss_kept", T.StringType())])
    at, m = docs.columns.index(text), len(docs.columns)

    def apply(batches):
        for table in in_batches(batches, 12 << 20):
            total, gone, kept = [], [], []
            for raw, blobs in zip(table.column(at).cast(pa.binary()).to_pylist(), table.column(m).to_pylist(), strict=True):
                words = raw.split() if raw else []
                out = _removed(len(words), blobs, width)
                total.append(len(words))
                gone.append(int(out.sum()))
                kept.append(raw if not gone[-1] else b" ".join([words[i] for i in np.flatnonzero(~out).tolist()]))
            done = table.select(range(m))
            done = done.append_column("_ss_n_words", pa.array(total, pa.int64())).append_column("_ss_n_removed", pa.array(gone, pa.int64()))
            done = done.append_column("_ss_kept", pa.array(kept, pa.binary()).cast(pa.string()))
            yield from done.combine_chunks().to_batches()

    return found.select(*docs.columns, _FOUND).mapInArrow(apply, schema)


def report(docs: DataFrame, *, width: int = 35) -> DataFrame:
    """One row per document: words, removed words and the SHA-256 of the kept words joined by one space."""
    found = find_repeats(docs.select("doc_id", "text"), width=width).select("doc_id", "text", _FOUND)

    def digest(batches):
        for table in in_batches(batches, 12 << 20):
            total, gone, sums = [], [], []
            for raw, blobs in zip(table.column(1).cast(pa.binary()).to_pylist(), table.column(2).to_pylist(), strict=True):
                words = raw.split() if raw else []
                out = _removed(len(words), blobs, width)
                total.append(len(words))
                gone.append(int(out.sum()))
                kept = [words[i] for i in np.flatnonzero(~out).tolist()] if gone[-1] else words
                sums.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield from pa.table({"doc_id": table.column(0), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sums)}).combine_chunks().to_batches()

    return found.mapInArrow(digest, T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_words long, n_removed long, kept_sha256 string").fields]))
