"""WARC archives, written and read index first.

Writing. Each task writes one archive of gzip members (one per record) and one index row per record: archive, offset, length,
URL, digest, type. Payload digests decide types on ids and digests alone: of records with equal payloads that with the greatest
id is a response, the others are revisits that carry its headers but not its payload.

Reading. The index comes first: the wanted records are chosen by joining or filtering index rows; the chosen rows of an archive
are sorted by offset and cut into runs of bounded size; a task joins byte ranges that touch or nearly touch into one read,
splits the members again and checks each payload against its digest.

Archives lie in the shared folder and are reached through ``pyarrow.fs``, which takes file, HDFS and object-store URIs. An
archive is written under its final name only when complete; a repeated task attempt writes a file of its own, and the index,
which is a Spark table, names the one whose attempt was committed.

Defined results. Null html is an empty payload. A null id sorts below all others; rows equal in id and payload are all
responses if one is. Null URLs are written as ``urn:none``. An empty table writes no archive. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh_path, in_batches, partitions, require, written

INDEX = "page_id long, archive string, offset long, length long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
_INDEX_ARROW = pa.schema([("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
_READ_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:loamstack:page:{'null' if page_id is None else page_id}>"


def _page_of(record_id: str) -> int | None:
    name = record_id.strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    clean = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else "urn:none"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def parse(member: bytes) -> dict[str, object]:
    """The headers (lower-case names) of a record, and its payload; raises ValueError if it isn't one."""
    raw = gzip.decompress(member)
    top, found, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head: dict[str, object] = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(str(head["content-length"]))]
    if len(block) != int(str(head["content-length"])):
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return head | {"payload": payload, "full_bytes": sizes[0] if sizes else len(payload)}


def with_types(pages: DataFrame, *, least_bytes: int = 0, most_groups: int = 500_000) -> DataFrame:
    """``pages`` with ``_w_to`` (the response's id) and ``_w_again`` (whether the row is a revisit).

    Groups of equal payloads are found on digests and ids alone. The largest ``most_groups`` of them are broadcast, so no payload
    moves for them and a payload that a third of all pages share is no large task; only if there are more groups, the rows
    of the other ones are joined by a shuffle."""
    keyed = pages.withColumn("_w_sha", F.unhex(F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))))
    size = F.octet_length(F.coalesce(F.col("html"), F.lit("")))
    groups = keyed.filter(size >= least_bytes).groupBy(F.col("_w_sha").alias("_w_key")).agg(F.max("page_id").alias("_w_id"), F.count("*").alias("_w_n")).filter("_w_n > 1 AND _w_id IS NOT NULL")
    groups = written(groups, "payloads")
    large = groups if (few := groups.count() <= most_groups) else written(groups.orderBy(F.desc("_w_n"), "_w_key").limit(most_groups), "payloads")
    to = lambda df, name: df.select("_w_key", F.col("_w_id").alias(name))
    found = keyed.join(F.broadcast(to(large, "_w_to")), (F.col("_w_sha") == F.col("_w_key")) & (size >= least_bytes), "left").drop("_w_key")
    if not few:
        small = to(groups.join(F.broadcast(large.select("_w_key")), "_w_key", "left_anti"), "_w_small")
        rest = found.filter("_w_to IS NULL").join(small, (F.col("_w_sha") == F.col("_w_key")) & (size >= least_bytes), "left")
        found = found.filter("_w_to IS NOT NULL").unionByName(rest.withColumn("_w_to", F.col("_w_small")).drop("_w_key", "_w_small"))
    again = F.col("_w_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_w_to"))
    return found.withColumn("_w_again", again).withColumn("_w_to", F.when(again, F.col("_w_to"))).drop("_w_sha")


def write_archives(pages: DataFrame, folder: str, *, least_bytes: int = 0, most_groups: int = 500_000) -> DataFrame:
    """Writes the archives of ``pages`` (page_id, url, html) into ``folder``; returns the index, itself a written table."""
    require(pages)
    typed = with_types(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), least_bytes=least_bytes, most_groups=most_groups)

    def write(batches) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        out, name, at = None, "", 0
        store, base = fs.FileSystem.from_uri(folder)
        try:
            for table in in_batches(batches, 8 << 20):
                rows = []
                for r in table.to_pylist():
                    payload = (r["html"] or "").encode("utf-8", "surrogatepass")
                    digest = digest_of(payload)
                    member = record(r["page_id"], r["url"], payload, digest, r["_w_to"], r["_w_again"])
                    if out is None:
                        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(member)
                    rows.append((r["page_id"], name, at, len(member), r["url"], digest, len(payload), "revisit" if r["_w_again"] else "response", r["_w_to"]))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(_INDEX_ARROW)], schema=_INDEX_ARROW)
        finally:
            if out is not None:
                out.close()

    return written(typed.select("page_id", "url", "html", "_w_to", "_w_again").mapInArrow(write, INDEX), "warc-index")


def runs(chosen: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, list[int]]]:
    """Byte ranges (offset, length, rows) that serve sorted (offset, length) pairs: neighbours at most ``gap`` bytes apart join."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (at, size) in enumerate(chosen):
        if out and at - (out[-1][0] + out[-1][1]) <= gap and at + size - out[-1][0] <= most:
            start, length, rows = out[-1]
            rows.append(i)
            out[-1] = (start, max(length, at + size - start), rows)
        else:
            out.append((at, size, [i]))
    return out


def read_records(index: DataFrame, folder: str, *, gap: int = 64 << 10, most: int = 8 << 20, segment: int = 16 << 20, payloads: bool = True) -> DataFrame:
    """The records of the chosen ``index`` rows. A task gets segments of archives, sorted by offset, and reads each run at once."""
    # index rows are tiny, so their own bytes say nothing of the work: the chosen records' bytes give the number of tasks
    chosen = index.select(F.sum("length")).first()[0] or 0
    tasks = partitions(index.sparkSession, 1 + int(chosen // segment))
    cut = index.select("archive", "offset", "length").withColumn("segment", F.floor(F.col("offset") / segment))
    dealt = cut.repartition(tasks, "archive", "segment").sortWithinPartitions("archive", "offset")

    def read(batches) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        source, name = None, None
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns[:3]), strict=True))
            start = 0
            while start < len(rows):
                stop = start
                while stop < len(rows) and rows[stop][0] == rows[start][0]:
                    stop += 1
                if name != rows[start][0]:
                    if source is not None:
                        source.close()
                    name = rows[start][0]
                    source = store.open_input_file(f"{base}/{name}")
                own = [(r[1], r[2]) for r in rows[start:stop]]
                for at, size, members in runs(own, gap, most):
                    data = source.read_at(size, at)
                    out = []
                    for i in members:
                        offset, length = own[i]
                        head = parse(data[offset - at : offset - at + length])
                        digest, revisit = str(head["warc-payload-digest"]).removeprefix("sha1:"), head["warc-type"] == "revisit"
                        if not revisit and (digest_of(head["payload"]) != digest or len(head["payload"]) != head["full_bytes"]):
                            raise ValueError(f"{name} at {offset}: the payload doesn't match its digest")
                        out.append((_page_of(str(head["warc-record-id"])), head["full_bytes"], digest, str(head["warc-type"]), _page_of(str(head["warc-refers-to"])) if revisit else None, head["warc-target-uri"], None if revisit or not payloads else head["payload"]))
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_READ_ARROW)], schema=_READ_ARROW)
                start = stop
        if source is not None:
            source.close()

    return dealt.mapInArrow(read, _READ)


def report(pages: DataFrame) -> DataFrame:
    """Writes an archive record per page, and reads all of them back through the index."""
    folder = fresh_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder)
    return read_records(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
