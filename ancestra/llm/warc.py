"""WARC archives: writing with revisit records, and a salvage reader.

Archives are real .warc.gz files, one gzip member a record, in a folder that driver and
executors share. The reader checks every member and record; after a failed check it searches
for the next valid member (or, in plain files, version line), goes on there, and logs the
bytes between as a quarantined gap. Of a damaged member the records before the damage are kept.
Members are inflated as they are read, and a large record goes through its digests in parts, so
records and members may be of any size.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, filesystem, fresh_path, pieces

MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/(?:0\.1[78]|1\.[01])\r?\n")
#: Where a record may begin: a gzip member, or a version line.
BEGIN = re.compile(rb"\x1f\x8b\x08|WARC/(?:0\.1[78]|1\.[01])\r?\n")
#: Bytes of an archive read at a time, those that a record's headers may take, and those of a block that is held in memory; larger ones pass in parts.
STEP, HEADERS, INLINE = 1 << 20, 1 << 20, 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes after which a writer starts another file.
ROLL = 8 << 20
LEVEL = 3


def digest(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(name: str, url: str | None, payload: bytes, refers_to: str | None = None, payload_digest: str | None = None, date: str = "1970-01-01T00:00:00Z", payload_bytes: int | None = None) -> bytes:
    """One record: a response with its payload or, with refers_to, a revisit without it."""
    n = len(payload) if payload_bytes is None else payload_bytes
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest or digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Source:
    """A file's bytes, read as they are asked for; the last ones read are kept."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.kept = file, size, 0, b""

    def read(self, a: int, b: int) -> bytes:
        b = min(b, self.size)
        if a < self.start or b > self.start + len(self.kept):
            self.start, self.kept = a, self.file.read_at(max(b - a, min(STEP, self.size - a)), a)
        return self.kept[a - self.start : b - self.start]

    def find(self, pattern: re.Pattern, at: int) -> int | None:
        """Where the pattern, of 16 bytes at most, is next found."""
        while part := self.read(at, at + STEP):
            if m := pattern.search(part):
                return at + m.start()
            if len(part) < STEP:
                return None
            at += STEP - 16  # it may lie across two parts
        return None

    def begin(self, at: int) -> int:
        """Where the next member or version line may begin, the end if nowhere."""
        found = self.find(BEGIN, at)
        return self.size if found is None else found


class Contents(Source):
    """Bytes that are in memory."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, a: int, b: int) -> bytes:
        return self.data[a:b]


class Member(Source):
    """A gzip member's contents, inflated as they are read. Some of them are kept; what was let go is inflated anew from the beginning.

    Once all is inflated, `end` is where the member ends in its file, or `fault` says why it doesn't; what came before the fault can be read.
    """

    def __init__(self, source: Source, at: int):
        self.source, self.at, self.end, self.fault = source, at, None, ""
        self._again()

    def _again(self) -> None:
        self.z, self.place, self.start, self.held, self.over = zlib.decompressobj(31), self.at, 0, bytearray(), False

    def _more(self) -> None:
        chunk = self.z.unconsumed_tail
        if not chunk:
            chunk = self.source.read(self.place, self.place + (1 << 16))
            self.place += len(chunk)
        before = self.z.copy()
        try:
            self.held += self.z.decompress(chunk, STEP)
            self.over = self.z.eof or not chunk
            if self.z.eof:
                self.end = self.place - len(self.z.unused_data)
            elif not chunk:
                self.fault = "invalid gzip member"
        except zlib.error:
            self.over, self.fault = True, "invalid gzip member"
            for i in range(len(chunk)):  # what comes before the fault, byte by byte
                try:
                    self.held += before.decompress(chunk[i : i + 1])
                except zlib.error:
                    break

    def read(self, a: int, b: int) -> bytes:
        if a < self.start:
            self._again()
        while self.start + len(self.held) < b and not self.over:
            if (far := min(a - self.start, len(self.held))) > INLINE:
                del self.held[:far]
                self.start += far
            self._more()
        return bytes(self.held[max(0, a - self.start) : max(0, b - self.start)])


def _block(source: Source, start: int, end: int, sink=None) -> tuple[dict, str] | str:
    """(what a block says, its digest), or what is wrong with it.

    A block of up to INLINE bytes is kept as `block`. A larger one is read in parts: kept are its HTTP headers
    as `block`, the payload's bytes and digest, and, with a sink, the file to which the payload was written.
    """
    if end - start <= INLINE:
        block = source.read(start, end)
        return ({"block": block}, digest(block)) if len(block) == end - start else "truncated"
    whole, body, front, size, at = hashlib.sha1(usedforsecurity=False), hashlib.sha1(usedforsecurity=False), b"", None, start
    out = sink() if sink else None
    while at < end:
        part = source.read(at, min(at + STEP, end))
        if not part:
            if out:
                out.drop()
            return "truncated"
        at += len(part)
        whole.update(part)
        if size is None:
            seen = max(0, len(front) - 3)
            front += part
            if (cut_at := front.find(b"\r\n\r\n", seen)) < 0:
                if len(front) > HEADERS:  # no headers that any reader would take; all that follows is looked through, but not kept
                    front = front[-3:]
                continue
            front, part, size = front[: cut_at + 4], front[cut_at + 4 :], 0
        size += len(part)
        body.update(part)
        if out:
            out.write(part)
    code = lambda h: base64.b32encode(h.digest()).decode()
    return {"block": front if size is not None else b"", "payload_bytes": size or 0, "payload_digest": code(body), "payload_file": out}, code(whole)


def _record(source: Source, at: int, sink=None) -> tuple[dict, int] | str:
    """(record, end) at a version line, or what is wrong with it."""
    if not (v := VERSION.match(source.read(at, at + 16))):
        return "no version line"
    step = 1 << 12
    while (stop := (front := source.read(at, at + step)).find(b"\r\n\r\n", v.end() - 2)) < 0:
        if len(front) < step or step >= HEADERS:
            return "headers don't end"
        step *= 4
    head = {}
    for row in front[v.end() : stop].split(b"\r\n"):
        key, colon, value = row.partition(b":")
        if row and not colon:
            return "malformed header"
        head[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not (size := head.get("content-length", "")).isdecimal():
        return "no length"
    start, end = at + stop + 4, at + stop + 4 + int(size)
    got = _block(source, start, end, sink)
    if isinstance(got, str):
        return got
    found, code = got
    fault = ""
    if (want := head.get("warc-block-digest", "")).startswith("sha1:") and want[5:] != code:
        fault = "block digest differs"
    elif (tail := source.read(end, end + 4)) not in (b"\r\n\r\n", b""):
        fault = "no end of record"
    if fault and found.get("payload_file"):
        found["payload_file"].drop()
    return fault or ({"head": head} | found, end + len(tail))


def salvage(content: bytes | Source, sink=None) -> Iterator[dict]:
    """Records ({offset, head, block, ...}) and gaps ({offset, end, reason}) of an archive, in order.

    Together they cover every byte. Empty contents give nothing. Contents are gzip members,
    plain records or both; of a member that is damaged, or holds a damaged record, the other records are given, and
    the gap is the whole member or, where its end isn't known, reaches to what is found next. The record at which a
    damaged member's contents end isn't given: only the member's own check would vouch for its end. The others are
    vouched for by their block digests; their headers have no check of their own, so a damaged member's records have the
    offset of its gap, by which they can be told. In memory are
    a record of up to INLINE bytes, as much of its member, and a window of the file.

    sink: makes something with write(), close() (its name) and drop(), for payloads of larger records.
    """
    source = content if isinstance(content, Source) else Contents(content)
    at, bad, why = 0, None, ""

    def closed(until: int) -> Iterator[dict]:
        nonlocal bad
        if bad is not None:
            yield {"offset": bad, "end": until, "reason": why}
        bad = None

    def given(rec: dict) -> dict:
        if rec.get("payload_file"):
            rec["payload_file"] = rec["payload_file"].close()
        return rec | {"offset": at}

    while at < source.size:
        if source.read(at, at + 3) == MAGIC:
            inside, p, some, fault, held = Member(source, at), 0, False, "", None

            def passed() -> Iterator[dict]:
                nonlocal some, held
                if held is not None:
                    if not some:
                        yield from closed(at)
                    some = True
                    yield given(held)
                held = None

            while inside.read(p, p + 1):
                yield from passed()
                one = _record(inside, p, sink)
                if isinstance(one, str):
                    fault = fault or one
                    following = inside.find(VERSION, p + 1)
                    if following is None:
                        break
                    p = following
                    continue
                held, p = one
            while not inside.over:  # to the member's end, or its fault
                inside.read(inside.start + len(inside.held), inside.start + len(inside.held) + STEP)
            fault = inside.fault or fault
            if not inside.fault:
                yield from passed()
            elif held is not None and held.get("payload_file"):
                held["payload_file"].drop()
            if inside.end is not None and (some or not fault):
                yield from closed(at)
                if fault:  # part of the member only
                    yield {"offset": at, "end": inside.end, "reason": fault}
                at = inside.end
                continue
        else:
            one = _record(source, at, sink)
            if not isinstance(one, str):
                yield from closed(at)
                yield given(one[0])
                at = one[1]
                continue
            fault = one
        if bad is None:
            bad, why = at, fault
        at = source.begin(at + 1)
    yield from closed(source.size)


def payload_of(rec: dict) -> bytes:
    """What follows the HTTP headers of a record's block."""
    return rec["block"].partition(b"\r\n\r\n")[2]


def _stated_bytes(rec: dict) -> int | None:
    m = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", rec["block"].partition(b"\r\n\r\n")[0])
    return int(m[1]) if m else None


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 0) -> DataFrame:
    """Write a record for every row into .warc.gz files below `path`; returns (file, records, bytes).

    Of records with equal payloads of at least revisit_from bytes, that of the largest id is a
    response and the others revisit it; rows that repeat its id and payload are responses, too.
    A null payload is empty; a very long one is a record like any other, held whole while it is
    written. Null ids are below all others. A file is written under a hidden
    name and then renamed; its name and its rows follow from the partition alone, so that a
    task that runs again replaces its own files.
    """
    source = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[payload_col].cast("string"), F.lit("")).cast("binary").alias("payload"))
    hashed = source.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    first = hashed.groupBy("sha", "size").agg(F.max("id").alias("first")).withColumnsRenamed({"sha": "s", "size": "z"})
    typed = hashed.join(first, (F.col("sha") == F.col("s")) & (F.col("size") == F.col("z"))).select(
        "id", "url", "sha", "size", F.when(F.col("id").eqNullSafe(F.col("first")) | (F.col("size") < revisit_from), F.col("payload")).alias("payload"), "first"
    ).sortWithinPartitions("id", "sha")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(path)
        store.create_dir(folder, recursive=True)
        task = TaskContext.get()
        out, held, rows, files = [], 0, 0, []

        def close() -> None:
            nonlocal out, held, rows
            name = f"{task.partitionId():06d}-{len(files):05d}.warc.gz"
            hidden = f"{folder}/_{task.taskAttemptId()}-{name}"
            with store.open_output_stream(hidden, compression=None) as f:
                for x in out:
                    f.write(x)
            store.move(hidden, f"{folder}/{name}")
            files.append((name, rows, held))
            out, held, rows = [], 0, 0

        for batch in batches:
            ids, urls, shas, sizes, first_ids = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5))
            for start, payloads in pieces(batch, "payload"):
                for i, payload in enumerate(payloads, start):
                    name = f"urn:x-page:{ids[i]}"
                    code = base64.b32encode(shas[i]).decode()
                    refers = None if payload is not None else f"urn:x-page:{first_ids[i]}"
                    packed = member(record(name, urls[i], payload or b"", refers, code, payload_bytes=sizes[i]))
                    out.append(packed)
                    held += len(packed)
                    rows += 1
                    if held >= ROLL:
                        close()
        if rows:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64()), pa.array([f[2] for f in files], pa.int64())], names=["file", "records", "bytes"])

    return cut(typed.mapInArrow(run, "file string, records long, bytes long"))


SCHEMA = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("gap_end", T.LongType()), T.StructField("reason", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("payload_file", T.StringType()),
])


class Spill:
    """A file for the payload of a large record; tasks that run again write others."""

    count = 0

    def __init__(self, folder: str):
        store, inner = filesystem(folder)
        store.create_dir(inner, recursive=True)
        Spill.count += 1
        name = f"{TaskContext.get().taskAttemptId()}-{Spill.count:06d}"
        self.store, self.inner, self.path = store, f"{inner}/{name}", f"{folder}/{name}"
        self.file = store.open_output_stream(self.inner, compression=None)

    def write(self, data: bytes) -> None:
        self.file.write(data)

    def close(self) -> str:
        self.file.close()
        return self.path

    def drop(self) -> None:
        self.file.close()
        self.store.delete_file(self.inner)


def read_archives(spark: SparkSession, path: str, payloads: bool = True, pattern: str = "*.warc*") -> DataFrame:
    """Every record and every quarantined gap of the archives below `path`, one row each.

    A gap has its byte range (offset, gap_end) and the reason of the first failed check;
    reason is null for records. A response's payload_bytes and payload_digest are those of the
    payload read; a revisit's are those that its headers state. Without payloads the columns payload and
    payload_file are null. Files are listed by Spark and read in windows, members inflated as they are read. A
    record's block of over 64 MiB isn't held in memory: its payload goes through the digest in parts and, where
    payloads are asked for, into a file of the shared folder that payload_file names.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    folder = fresh_path(spark, "warc-payloads") if payloads else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, held = batch.column(0)[i].as_py(), [], 0
                store, inner = filesystem(name)
                for x in salvage(Source(store.open_input_file(inner), batch.column(1)[i].as_py()), (lambda: Spill(folder)) if payloads else None):
                    if "reason" in x:
                        rows.append((name, x["offset"], x["end"], x["reason"], *[None] * 8))
                    else:
                        head, kind = x["head"], x["head"].get("warc-type")
                        strip = lambda k, head=head: head[k].strip("<>") if k in head else None
                        body = payload_of(x)
                        size, code = (x["payload_bytes"], x["payload_digest"]) if "payload_bytes" in x else (len(body), digest(body))
                        stated = (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                        own, file = kind != "revisit", x.get("payload_file")
                        rows.append((
                            name, x["offset"], None, None, kind, strip("warc-record-id"), strip("warc-refers-to"), head.get("warc-target-uri"), size if own else _stated_bytes(x), code if own else stated,
                            body if payloads and "payload_bytes" not in x else None, file,
                        ))
                        held += len(body) if payloads else 200
                    if held >= 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=SCHEMA.names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=SCHEMA.names)

    return files.mapInArrow(run, SCHEMA)


TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]


def page_number(column: str) -> Column:
    """The id in a record name that write_archives() gave; null for the record of a null id."""
    return F.regexp_extract(column, r"urn:x-page:(-?\d+)$", 1).try_cast("long")


def round_trip(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 0) -> DataFrame:
    """Write the pages' archives below `path` and read them back: id, payload_bytes, payload_digest, record_type, refers_to."""
    written = write_archives(pages, path, id_col, url_col, payload_col, revisit_from)
    if not written.where("records > 0").limit(1).count():
        return pages.sparkSession.createDataFrame([], f"{id_col} long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    back = read_archives(pages.sparkSession, path, payloads=False)
    gap = F.raise_error(F.concat_ws(" ", F.lit("an archive came back damaged:"), "file", "offset", "reason"))  # own archives have none
    return back.select(F.when(F.col("reason").isNotNull(), gap).otherwise(page_number("record_id")).cast("long").alias(id_col), "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to"))
