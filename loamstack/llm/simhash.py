"""SimHash near-duplicates by anchor-point covering.

Fingerprint: over the XXH64 (seed 42) of all word shingles of the whole text, a bit is set if it is set in over half of them.
Fingerprints within ``distance`` differing bits are linked.

Search. Exact copies collapse first: from here on there is one row per distinct fingerprint. The 64 bits are cut into
segments; if two fingerprints differ in at most ``distance`` bits, some segment differs in at most ``distance // segments``
(pigeonhole). Within a segment the anchors are the words of a covering code: the product of perfect Hamming (7,4) codes, so
each value lies within the covering radius (one bit per block of seven) of exactly one anchor, its home. A fingerprint goes
to the home of every value within the segment's threshold of its own, which are the anchors within covering radius plus
threshold that a partner can call home. Each anchor compares its residents with all its visitors.

More rows take more bits per segment: three segments of 21 bits (4096 anchors each, about nine visits per fingerprint and
segment) up to ``two_from`` distinct fingerprints, then two of 28 bits (65536 anchors each). Both find every pair.

An anchor emits no pairs, but one edge per fingerprint to the head of its local group; a star-contraction turns the edges
into components. The residents of a full anchor are dealt to parts of bounded size by their hash, and its visitors (and the other
parts' residents) go to each part, so thousands of near copies with one home are several tasks.

``drop_near_duplicates`` leaves one row of each group of these links. As fingerprints tell few of the copies with many edits, texts
whose sets of shingles are similar are linked too: bands of min-hashes of the sets find the candidates, the whole sets decide.

Defined results. No words, or null text: fingerprint zero, linked like any other. Fewer words than a shingle has: the whole
sequence is the single shingle. Repeated rows share their fingerprint. A null id never becomes a component id unless its
whole component has none. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import free_name, in_batches, mixed, partitions, require, written
from .components import components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _digests(words: list[bytes], shingle: int, digest, seed: int = 42) -> bytes:
    """The digests of all shingles of a text that has words, end to end; fewer words than a shingle has are one shingle."""
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    return b"".join([digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)])


def _majority(packed: bytes, width: int) -> bytes:
    """The bits that are set in over half of the digests of ``width`` bytes."""
    rows = np.frombuffer(packed, np.uint8).reshape(-1, width)
    total = np.zeros(8 * width, np.int64)
    for i in range(0, len(rows), 1 << 16):
        total += np.unpackbits(rows[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(rows)).tobytes()


def _words_fingerprint(words: list[bytes], shingle: int) -> int:
    return int.from_bytes(_majority(_digests(words, shingle, xxhash.xxh64_digest), 8), "big") if words else 0


def fingerprint(raw: bytes | None, shingle: int = 4) -> int:
    return _words_fingerprint(raw.translate(_LOWER).split() if raw else [], shingle)


def with_fingerprints(docs: DataFrame, *, text: str = "text", shingle: int = 4, name: str = "fp") -> DataFrame:
    """``docs`` without its text, with the fingerprint as a signed long."""
    require(docs, **{text: T.StringType})
    at, keep = docs.columns.index(text), [c for c in docs.columns if c != text]
    positions = [docs.columns.index(c) for c in keep]

    def scan(batches):
        for table in in_batches(batches, 8 << 20):
            fps = np.array([fingerprint(x, shingle) for x in table.column(at).cast(pa.binary()).to_pylist()], np.uint64)
            yield from table.select(positions).append_column(name, pa.array(fps.view(np.int64))).combine_chunks().to_batches()

    return docs.mapInArrow(scan, T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.LongType())]))


# --- the covering code ------------------------------------------------------------------------------------------------


def _hamming_homes() -> np.ndarray:
    """For each 7-bit value, the index (0 to 15) of its only code word within one bit."""
    check = [0] * 128
    words = []
    for v in range(128):
        syndrome = 0
        for i in range(7):
            if v >> i & 1:
                syndrome ^= i + 1
        check[v] = syndrome
        if not syndrome:
            words.append(v)
    rank = {w: k for k, w in enumerate(words)}
    return np.array([rank[v ^ (1 << (check[v] - 1)) if check[v] else v] for v in range(128)], np.uint32)


_HOMES = _hamming_homes()


def _homes(values: np.ndarray, blocks: int) -> np.ndarray:
    out = np.zeros(values.shape, np.uint32)
    for b in range(blocks):
        out |= _HOMES[(values >> np.uint32(7 * b)) & np.uint32(127)] << np.uint32(4 * b)
    return out


#: Names of anchors, of all segments: at most 3 * 16**3 or 2 * 16**4.
_ANCHOR_BITS = 17


def segments(count: int) -> list[tuple[int, int]]:
    """(first bit, blocks of seven) of each segment: three of 21 or two of 28 bits; spare bits are only compared."""
    return [(0, 3), (21, 3), (42, 3)] if count == 3 else [(0, 4), (32, 4)]


def _visits(fps: np.ndarray, first: int, blocks: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) for the anchors each fingerprint goes to in a segment."""
    width = 7 * blocks
    masks = np.array([sum(1 << b for b in bits) for k in range(threshold + 1) for bits in combinations(range(width), k)], np.uint32)
    value = ((fps >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.uint32)
    anchors = _homes(value[:, None] ^ masks[None, :], blocks)
    home = anchors[:, 0].copy()
    anchors.sort(axis=1)
    new = np.ones(anchors.shape, bool)
    new[:, 1:] = anchors[:, 1:] != anchors[:, :-1]
    row, col = np.nonzero(new)
    found = anchors[row, col]
    return row, found, found == home[row]


def _within(words: np.ndarray, limits: tuple[tuple[int, int], ...]):
    """near(i, j): which rows i and j of ``words`` (row x column) agree. ``limits`` are (columns, bits): the first so many columns may
    differ in so many bits together, then the next ones."""
    first, most = limits[0]

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        found = sum(np.bitwise_count(words[i, c][:, None] ^ words[j, c][None, :]) for c in range(first)) <= most
        at = first
        for columns, bits in limits[1:]:
            a, b = np.nonzero(found)
            apart = sum(np.bitwise_count(words[i[a], c] ^ words[j[b], c]).astype(np.int64) for c in range(at, at + columns)) > bits
            found[a[apart], b[apart]] = False
            at += columns
        return found

    return near


def _local_edges(names: np.ndarray, resident: np.ndarray, near) -> list[tuple[int, int]]:
    """A forest over the links of one anchor: (name, head's name) by breadth-first search from each unreached resident.

    A resident is reached once. A visitor can be reached from several heads: the link between it and a resident may be seen
    nowhere else. Links between two visitors are left to the anchors where one of them is at home."""
    every, step = np.arange(len(names)), 1 << 15
    homes = np.flatnonzero(resident)
    linked = [h for a in range(0, len(homes), 256) for h in homes[a : a + 256][sum(near(homes[a : a + 256], every[s : s + step]).sum(axis=1) for s in range(0, len(names), step)) > 1].tolist()]
    edges, fresh = [], resident.copy()
    for head in linked:
        if not fresh[head]:
            continue
        open_ = fresh | ~resident
        open_[head] = fresh[head] = False
        frontier = np.array([head])
        while len(frontier):
            rest = np.flatnonzero(open_)
            reached = np.zeros(len(rest), bool)
            for a in range(0, len(frontier), 256):
                for s in range(0, len(rest), step):
                    reached[s : s + step] |= near(frontier[a : a + 256], rest[s : s + step]).any(axis=0)
            got = rest[reached]
            open_[got] = False
            edges += [(x, int(names[head])) for x in names[got].tolist()]
            frontier = got[resident[got]]
            fresh[frontier] = False
    return edges


def link_fingerprints(fps: DataFrame, *, distance: int = 4, two_from: int = 200_000_000, check: tuple[str, ...] = (), check_distance: int = 0, name: str = "fp", most_residents: int = 4096) -> DataFrame:
    """Edges (u, v) over the distinct fingerprints of column ``fp``: their components are those of all links.

    With ``check``, further fingerprints (longs) travel along, and a link also needs them to differ in at most ``check_distance``
    bits together; ``name`` is the column (long) that edges call a row by."""
    count = 3 if fps.count() < two_from else 2
    parts, threshold = segments(count), distance // count
    carried = [*dict.fromkeys(("fp", *check, name))]
    limits = ((1, distance), (len(check), check_distance)) if check else ((1, distance),)
    named = carried.index(name)

    def residents(batches):
        total = np.zeros(1 << _ANCHOR_BITS, np.int64)
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k, (first, blocks) in enumerate(parts):
                total += np.bincount(_homes(((own >> np.uint64(first)) & np.uint64((1 << 7 * blocks) - 1)).astype(np.uint32), blocks).astype(np.int64) * count + k, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch({"anchor": pa.array(some), "n": pa.array(total[some])})

    full = fps.select("fp").mapInArrow(residents, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter(F.col("n") > most_residents).collect()  # the code has so many words only
    split = {r.anchor: -(-r.n // most_residents) for r in full}

    def deal(batches):
        pieces = np.ones(1 << _ANCHOR_BITS, np.int64)
        pieces[list(split)] = list(split.values())
        for b in batches:
            own = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)
            for s in range(0, len(own), 8192):
                some = own[s : s + 8192]
                for k, (first, blocks) in enumerate(parts):
                    row, anchor, home = _visits(some[:, 0].copy().view(np.uint64), first, blocks, threshold)
                    anchor = anchor.astype(np.int64) * count + k
                    if split:
                        times = pieces[anchor]
                        piece = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                        row, anchor, home = np.repeat(row, times), np.repeat(anchor, times), np.repeat(home, times)
                        home &= piece == (mixed(some[row, 0].view(np.uint64)) % pieces[anchor].astype(np.uint64)).astype(np.int64)
                        anchor |= piece << _ANCHOR_BITS
                    yield pa.record_batch({"anchor": pa.array(anchor), "home": pa.array(home)} | {c: pa.array(some[row, i]) for i, c in enumerate(carried)})

    n = partitions(fps.sparkSession)
    kind = "anchor long, home boolean, " + ", ".join(f"{c} long" for c in carried)
    dealt = fps.select(*carried).mapInArrow(deal, kind).repartition(n, "anchor").sortWithinPartitions("anchor")

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def solved(table: pa.Table):
            anchor, home = table.column(0).to_numpy(), table.column(1).to_numpy()
            own = np.stack([table.column(2 + i).to_numpy() for i in range(len(carried))], axis=1).view(np.uint64)
            cut = np.flatnonzero(np.diff(anchor)) + 1
            edges = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(anchor)], strict=True):
                if b - a > 1 and home[a:b].any():
                    edges += _local_edges(own[a:b, named], home[a:b], _within(own[a:b], limits))
            if edges:
                e = np.array(edges, np.uint64).view(np.int64)
                yield pa.record_batch({"u": pa.array(e[:, 0].copy()), "v": pa.array(e[:, 1].copy())})

        for b in batches:  # sorted by anchor: a group ends where the next begins
            if not b.num_rows:
                continue
            if held and held[-1].column(0)[-1] != b.column(0)[0]:
                yield from solved(pa.Table.from_batches(held))
                held = []
            last = b.column(0)[-1].as_py()
            edge = int(np.searchsorted(b.column(0).to_numpy(), last))
            if edge:
                yield from solved(pa.Table.from_batches([*held, b.slice(0, edge)]))
                held = []
            held.append(b.slice(edge))
        if held:
            yield from solved(pa.Table.from_batches(held))

    return dealt.mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """(id, fp, component): one row per document; component is the least id reachable."""
    printed = written(with_fingerprints(docs.select(id_col, text), text=text, shingle=shingle), "fingerprints")
    classes = written(printed.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    roots = components(link_fingerprints(classes, distance=distance))
    # only linked fingerprints need more than their own least id
    tied = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    of_root = tied.groupBy("root").agg(F.min("least").alias("component"))
    by_class = tied.join(of_root, "root").select("fp", "component")
    return printed.join(by_class, "fp").select(id_col, "fp", "component")


def _shingle_set(packed: bytes) -> np.ndarray:
    """The distinct shingles of 16-byte digests, sorted: the first half of each digest stands for its shingle."""
    return np.unique(np.frombuffer(packed, "<u8")[::2])


#: Min-hashes a band has, and bands. Two sets of Jaccard similarity s share a band with probability 1 - (1 - s**6)**32, whatever
#: the edits between their texts were: all but 6 in 100,000 pairs at 0.8, all but 3 in ten million at 0.85.
_ROWS, _BANDS = 6, 32
_FACTORS = np.random.default_rng(42).integers(0, 1 << 31, _ROWS * _BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MIXERS = np.random.default_rng(43).integers(0, 1 << 63, (_ROWS, _BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: What the search knows of a text: its set of shingles (digest, and a long of it), the bands of its min-hashes (longs, end to end), and
#: its fingerprint (null if it has no word).
_PRINTED = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("node", T.LongType()), T.StructField("bands", T.BinaryType()), T.StructField("fp", T.LongType())])


def _bands(shingles: np.ndarray) -> bytes:
    """A long for each band of min-hashes of a set; none for the empty set."""
    if not len(shingles):
        return b""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(_ROWS * _BANDS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(least, (_FACTORS[:, None] * x[None, i : i + 2048]).min(axis=1), out=least)
    sums = (least.reshape(_ROWS, _BANDS).astype(np.uint64) * _MIXERS).sum(axis=0, dtype=np.uint64)
    return mixed(sums + np.arange(_BANDS, dtype=np.uint64) * _MIXERS[0, 0]).tobytes()


def _printed(slim: DataFrame, shingle: int, print_shingle: int = 4) -> DataFrame:
    """(_sh_id, key, node, bands, fp) of (_sh_id, text)."""

    def scan(batches):
        for table in in_batches(batches, 8 << 20):
            keys, bands, fps = [], [], []
            for raw in table.column(1).cast(pa.binary()).to_pylist():
                words = raw.translate(_LOWER).split() if raw else []
                own = _shingle_set(_digests(words, shingle, xxhash.xxh3_128_digest) if words else b"")
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                bands.append(_bands(own))
                fps.append(_words_fingerprint(words, print_shingle))
            nodes = [int.from_bytes(k[:8], "big", signed=True) for k in keys]
            yield pa.record_batch({"_sh_id": table.column(0).combine_chunks(), "key": pa.array(keys, pa.binary()), "node": pa.array(nodes, pa.int64()), "bands": pa.array(bands, pa.binary()), "fp": pa.array(np.array(fps, np.uint64).view(np.int64), mask=np.array([not x for x in bands], bool))})

    return slim.mapInArrow(scan, T.StructType([slim.schema["_sh_id"], *_PRINTED.fields]))


def link_bands(classes: DataFrame) -> DataFrame:
    """Edges (u, v) over ``node``: of the texts that share a band, each with the first."""

    def deal(batches):
        for b in batches:
            nodes, held = b.column(0).to_numpy(), b.column(1).to_pylist()
            yield pa.record_batch({"band": pa.array(np.frombuffer(b"".join(held), np.int64)), "node": pa.array(np.repeat(nodes, [len(x) // 8 for x in held]))})

    dealt = classes.select("node", "bands").mapInArrow(deal, "band long, node long").repartition(partitions(classes.sparkSession), "band").sortWithinPartitions("band", "node")

    def link(batches):
        last = head = None
        for b in batches:  # sorted by band: a group ends where the next begins
            if not b.num_rows:
                continue
            band, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
            heads = node[starts].copy()
            if last is not None and band[0] == last:
                heads[0] = head
            last, head = band[-1], heads[-1]
            first = np.repeat(heads, np.diff(np.append(starts, len(band))))
            far = node != first
            yield pa.record_batch({"u": pa.array(node[far]), "v": pa.array(first[far])})

    return dealt.mapInArrow(link, "u long, v long")


def link_prints(printed: DataFrame, distance: int) -> DataFrame:
    """Edges (u, v) over ``node``: texts whose fingerprints differ in at most ``distance`` bits hang together.

    A text of each fingerprint stands for it in the search; the others that share it are tied to that one. Texts that differ only
    in how often a shingle occurs have one node, and may have several fingerprints."""
    marks = printed.filter("fp IS NOT NULL").select("node", "fp")
    fps = written(marks.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("last")), "fps")
    shared = marks.distinct().join(fps.filter("first <> last").select("fp", "first"), "fp").filter("node <> first")
    return link_fingerprints(fps, distance=distance, name="first").unionByName(shared.select(F.col("node").alias("u"), F.col("first").alias("v")))


def _sets(slim: DataFrame, family: DataFrame, shingle: int) -> DataFrame:
    """(root, key, node, least, set): the shingles of each text of a family (key, node, root, least)."""
    chosen = slim.join(family.withColumnRenamed("least", "_sh_id"), "_sh_id").select("_sh_id", slim.columns[1], "key", "node", "root")

    def read(batches):
        for table in in_batches(batches, 8 << 20):
            found = []
            for raw in table.column(1).cast(pa.binary()).to_pylist():
                words = raw.translate(_LOWER).split() if raw else []
                found.append(_shingle_set(_digests(words, shingle, xxhash.xxh3_128_digest) if words else b"").tobytes())
            own = pa.array([xxhash.xxh3_128_digest(x) == k for x, k in zip(found, table.column(2).to_pylist(), strict=True)], pa.bool_())  # an id may stand for several texts
            out = pa.table({"root": table.column(4), "key": table.column(2), "node": table.column(3), "least": table.column(0), "set": pa.array(found, pa.binary())})
            yield from out.filter(own).combine_chunks().to_batches()

    kind = T.StructType([T.StructField("root", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("node", T.LongType()), T.StructField("least", slim.schema["_sh_id"].dataType), T.StructField("set", T.BinaryType())])
    return chosen.mapInArrow(read, kind).dropDuplicates(["key"])


def _across(tied: DataFrame, edges: DataFrame, similarity: float, block: int) -> DataFrame:
    """Edges (u, v) between similar texts of ``tied`` (root, key, node, set) that ``edges`` leave in different groups of their family.

    Each block of a family meets itself and each other one in a task of its own, which gives fewer edges than it has groups."""
    grouped = tied.select("root", "key", "node", "set").join(components(edges).withColumnRenamed("root", "group"), "node")
    several = grouped.groupBy("root").agg(F.min("group").alias("a"), F.max("group").alias("b"), F.ceil(F.count("*") / block).alias("parts")).filter("a <> b").select("root", "parts")
    dealt = written(grouped.join(several, "root").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))), "across")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    met = dealt.select("root", "node", "group", "set", "part", every.alias("other")).select("root", "node", "group", "set", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), (F.col("part") <= F.col("other")).alias("first"))

    def compare(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        sets, nodes, groups = [np.frombuffer(x, "<u8") for x in own["set"]], own["node"].tolist(), own["group"].to_numpy().copy()
        first, sizes, out = own["first"].to_numpy(), np.array([len(x) for x in sets]), []
        for i, x in enumerate(sets):
            may = (np.minimum(sizes, len(x)) >= similarity * np.maximum(sizes, len(x))) & (np.arange(len(sets)) > i) & (groups != groups[i])
            if key[1] != key[2]:
                may &= first != first[i]
            for j in np.flatnonzero(may).tolist():
                if groups[i] != groups[j]:
                    both = len(np.intersect1d(x, sets[j], assume_unique=True))
                    if both >= similarity * (len(x) + len(sets[j]) - both):
                        out.append((nodes[i], nodes[j]))
                        groups[groups == groups[j]] = groups[i]
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return met.groupBy("root", "p", "q").applyInPandas(compare, "u long, v long")


def _verified(sets: DataFrame, similarity: float, *, heads: int = 32, most_heads: int = 1024, block: int = 500) -> DataFrame:
    """Edges (u, v) over ``node`` between texts of one family that are as similar as that.

    In a round the first texts of each family that nothing is similar to yet are its heads; all texts of the family are compared
    with them, in blocks. A text gives one edge, to its first head, and a block at most one per pair of heads that a text lies
    between. Rounds go on, with twice as many heads, until every text is a head or similar to one. Texts that are no heads, and that
    these edges leave in different groups of their family, are then compared with each other (``_across``)."""
    split = sets.groupBy("root").agg(F.ceil(F.count("*") / block).alias("parts"))
    dealt = written(sets.join(split, "root").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))), "sets")
    active, edges, met = dealt.select("root", "key", "least"), None, None
    order = Window.partitionBy("root").orderBy("least", "key")

    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("rank", ignore_index=True)
        first, names = [np.frombuffer(x, "<u8") for x in left["set"]], left["node"].tolist()
        out, between = [], set()
        for node, blob in zip(right["node"].tolist(), right["set"], strict=True):
            x = np.frombuffer(blob, "<u8")
            near = []
            for h, own in enumerate(first):
                if names[h] != node and min(len(x), len(own)) >= similarity * max(len(x), len(own)):
                    both = len(np.intersect1d(x, own, assume_unique=True))
                    if both >= similarity * (len(x) + len(own) - both):
                        near.append(h)
            if near:
                out.append((node, names[near[0]]))
                between.update((names[h], names[near[0]]) for h in near[1:])
        return pd.DataFrame([*out, *between], columns=["u", "v"]).astype("int64")

    while True:
        first = active.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= heads).select("key", "rank")
        chosen = written(dealt.join(first, "key").select("root", "key", "rank", "node", "parts", "set"), "heads")
        if not chosen.count():
            return edges if edges is None else edges.unionByName(_across(dealt.join(met, "key", "left_anti"), edges, similarity, block))
        wanted = chosen.select("root", "rank", "node", "set", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        others = dealt.join(chosen.select("root").distinct(), "root", "left_semi").select("root", "part", "node", "set")
        found = written(wanted.groupBy("root", "part").cogroup(others.groupBy("root", "part")).applyInPandas(compare, "u long, v long"), "links")
        edges = found if edges is None else edges.unionByName(found)
        met = chosen.select("key") if met is None else met.unionByName(chosen.select("key"))  # compared with their whole family
        tied = dealt.select("key", "node").join(found.select(F.col("u").alias("node")).distinct(), "node", "left_semi").select("key")
        active = written(active.join(chosen.select("key").unionByName(tied), "key", "left_anti").select("root", "key", "least"), "active")
        heads = min(most_heads, 2 * heads)


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, print_shingle: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` without the rows that are near copies: of each group one row stays, the one of the least id.

    Two texts are linked if their fingerprints (over ``print_shingle`` words, as in ``near_duplicates``) differ in at most ``distance``
    bits, all such pairs being found; or if their sets of shingles have a Jaccard similarity of ``similarity`` or more, checked on the
    whole sets of texts that share a band of min-hashes. Groups hang together by links of both kinds. Texts without a word are equal,
    and linked to no others.
    Rows are told apart by a key of their own: an id may be repeated, or stand for several texts, or be null (a null id stays only
    where its whole group has none). Extra columns pass through; an empty table stays empty."""
    free_name(docs, "_sh_row")
    rows = written(docs.withColumn("_sh_row", F.monotonically_increasing_id()), "rows")  # written, so that a row keeps its key
    slim = rows.select(F.col("_sh_row").alias("_sh_id"), F.col(text).alias("_sh_text"))
    printed = written(_printed(slim, shingle, print_shingle), "prints")
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), F.col("_sh_row").alias("row"))
    placed = printed.join(rows.select(F.col("_sh_row").alias("_sh_id"), place.alias("place")), "_sh_id")
    # texts of equal sets are one from here on; their bands are equal too
    classes = written(placed.groupBy("key", "node").agg(F.min("place").alias("place"), F.count("*").alias("n"), F.first("bands").alias("bands")), "classes")
    classes = classes.withColumn("least", F.col("place.row"))
    roots = components(link_bands(classes))
    family = classes.join(roots, "node").select("key", "node", "root", "least")
    alike, links = _verified(_sets(slim, family, shingle), similarity), link_prints(printed, distance)
    links = links if alike is None else links.unionByName(alike)
    groups = classes.select("node", "place").join(components(links), "node")
    stay = groups.groupBy("root").agg(F.min("place").alias("stay"))
    tied = classes.select("key", "node", "least", "n").join(groups.join(stay, "root").select("node", F.col("stay.row").alias("stay")), "node", "left").withColumn("stay", F.coalesce("stay", "least")).filter((F.col("n") > 1) | (F.col("stay") != F.col("least")))
    gone = printed.select("_sh_id", "key").join(tied.select("key", "stay"), "key").filter(F.col("_sh_id") != F.col("stay")).select(F.col("_sh_id").alias("_sh_row"))
    return rows.join(gone, "_sh_row", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprint in hex and component."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
