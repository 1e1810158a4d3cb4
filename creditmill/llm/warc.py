"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

The writer makes a gzip member (or a plain record) per page. Of pages with equal payloads of at
least ``least`` bytes, that with the largest id is a response and the others are revisits of it;
smaller payloads are all responses.

The reader checks every record: the gzip member's own check sum, the version line, the length,
the blank lines at its end, and the digests of block and payload. When a check fails, it looks
for the next place where a member or a version line begins a record that passes, goes on from
there, and logs the bytes in between as a quarantined gap with the reason. A member may hold
several records; those that pass are read, what lies between them is a gap of the member. A
member that is cut off or broken gives the records before the damage; the rest is a gap, and so
is the record next to the damage, since the check that failed was its own too.

Defined cases: a null payload is empty; a null or unprintable URL is left out or escaped; pages
without an id are responses and come back without one; rows of one id are records of their own;
an empty file has no records and no gaps; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import apart, publish, scratch_dir, stored

VERSION = b"WARC/1.1\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_START = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|WARC/1\.[01]\r\n")
#: Where a header ends: at its blank line, or at the version line of another record.
_STOP = re.compile(rb"\r\n(?:\r\n|WARC/1\.[01]\r\n)")
_REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Bytes read at once, and those of a header that are read first.
STEP, HEADER = 1 << 20, 1 << 16


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, refers_to, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record: a response with its payload, or a revisit without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", page_urn(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else None),
        ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(block)),
        ("WARC-Profile", None if refers_to is None else REVISIT),
        ("WARC-Refers-To", None if refers_to is None else page_urn(refers_to)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member of its own."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Record(NamedTuple):
    """A record that passed its checks, and where it lies in the file."""

    start: int
    end: int | None
    fields: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    """Quarantined bytes, and the check that failed at their start.

    ``inside``: in a member that gave records too, the unpacked bytes before the gap.
    """

    start: int
    end: int | None
    reason: str
    inside: int | None = None


class Damaged(Exception):
    """A check failed."""


class _Held:
    """The content of a member, as a file."""

    def __init__(self, data: bytes):
        self.data = data

    def read_at(self, n: int, at: int) -> bytes:
        return self.data[at : at + n]


class Archive:
    """Random access to a file, a step at a time. ``packed``: its records may be members."""

    def __init__(self, file, size: int, packed: bool = True):
        self.file, self.size, self.packed = file, size, packed
        self._at, self._held = 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not self._at <= at <= at + n <= self._at + len(self._held):
            self._at, self._held = at, self.file.read_at(min(max(n, STEP), self.size - at), at) if n else b""
        return self._held[at - self._at : at - self._at + n]

    def _head(self, data: bytes) -> tuple[dict[str, str], int]:
        """Fields of a record that starts ``data``, and where its block starts."""
        end = data.find(b"\r\n\r\n")
        lines = data[:end].split(b"\r\n") if end >= 0 else []
        if not lines or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
            raise Damaged("no version line" if data[:5] != b"WARC/" else "header without an end")
        fields = {}
        for line in lines[1:]:
            name, colon, value = line.partition(b":")
            if not colon:
                raise Damaged("header line without a name")
            fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        if missing := [f for f in _REQUIRED if not fields.get(f)]:
            raise Damaged(f"no {missing[0]}")
        if not fields["content-length"].isdigit():
            raise Damaged("no length")
        return fields, end + 4

    def _checked(self, start: int, end: int, fields: dict[str, str], block: bytes, tail: bytes) -> Record:
        if len(block) != int(fields["content-length"]):
            raise Damaged("cut off")
        if tail != b"\r\n\r\n":
            raise Damaged("no blank lines at the end")
        if fields.get("warc-block-digest", digest(block)) != digest(block):
            raise Damaged("block digest differs")
        if fields.get("warc-type") == "response":
            _, _, payload = block.partition(b"\r\n\r\n")
            if fields.get("warc-payload-digest", digest(payload)) != digest(payload):
                raise Damaged("payload digest differs")
        return Record(start, end, fields, block)

    def _plain(self, at: int) -> Record:
        n = HEADER
        data = self.read(at, n)
        # A header of any length is read to its end; where none can begin, nothing is.
        while data.startswith(b"WARC/") and not _STOP.search(data) and at + len(data) < self.size:
            n *= 2
            data = self.read(at, n)
        stop = _STOP.search(data)
        fields, start = self._head(data[: stop.end()] if stop else data)
        length = int(fields["content-length"])
        if at + start + length > self.size:
            raise Damaged("cut off")
        end = at + start + length + 4
        return self._checked(at, end, fields, self.read(at + start, length), self.read(end - 4, 4))

    def _member(self, at: int) -> list[Record | Gap]:
        unpacker, parts, place, step, broken = zlib.decompressobj(31), [], at, 4096, ""
        while not unpacker.eof and not broken:
            data, step = self.read(place, step), min(4 * step, STEP)  # most members are short
            try:
                parts.append(unpacker.decompress(data))
                broken = "" if data else "member cut off"
            except zlib.error as error:
                broken = f"member broken ({str(error).rpartition(':')[2].strip() or 'data'})"
                parts = self._until_broken(at, place + len(data))
            if len(parts) == 1 and len(parts[0]) >= 5 and not parts[0].startswith(b"WARC/"):
                raise Damaged("member without a version line")
            place += len(data)
        data = b"".join(parts)
        found = [e._replace(inside=e.start) if isinstance(e, Gap) else e for e in Archive(_Held(data), len(data), packed=False).entries()]
        rest = None
        if broken and found:  # the last record is next to the damage, and no check of the member covers it
            last = max((k for k, e in enumerate(found) if isinstance(e, Record)), default=0)
            rest, found = Gap(at, None, broken, found[last].start), found[:last]
        if not any(isinstance(e, Record) for e in found):
            raise Damaged(broken or (found[0].reason if found else "no version line"))
        if rest is None:
            return [e._replace(start=at, end=place - len(unpacker.unused_data)) for e in found]
        return [*[e._replace(start=at, end=None) for e in found], rest]  # where the member ends is not known

    def _until_broken(self, at: int, end: int) -> list[bytes]:
        """What a damaged member gives before the error."""
        unpacker, parts = zlib.decompressobj(31), []
        for place in range(at, end, 4096):
            data, before = self.read(place, min(4096, end - place)), unpacker.copy()
            try:
                parts.append(unpacker.decompress(data))
            except zlib.error:  # a byte at a time, up to the one that fails
                try:
                    parts.extend(before.decompress(data[k : k + 1]) for k in range(len(data)))
                except zlib.error:
                    pass
                break
        return [b"".join(parts)]

    def records(self, at: int) -> list[Record | Gap]:
        """The record at a place, or all that the member there holds; or Damaged."""
        head = self.read(at, 3)
        return self._member(at) if self.packed and head == b"\x1f\x8b\x08" else [self._plain(at)]

    def _next(self, at: int) -> list[Record | Gap]:
        """The first record or member that passes from a place on."""
        while at < self.size:
            data = self.read(at, STEP)
            found = _START.search(data)
            if not found:
                at += max(1, len(data) - 9)  # a start may lie across two steps
                continue
            at += found.start()
            try:
                return self.records(at)
            except Damaged:
                at += 1
        return []

    def entries(self) -> Iterator[Record | Gap]:
        """Records and gaps in the order of the file; together they cover it. Those of one member share its place."""
        at, found = 0, []
        while at < self.size:
            if not found:
                try:
                    found = self.records(at)
                except Damaged as damage:
                    found = [Gap(at, None, str(damage))]
            following = []
            if found[-1].end is None:  # up to the next one that passes
                following = self._next(at + 1)
                found = [e._replace(end=following[0].start if following else self.size) for e in found]
            yield from found
            at, found = found[-1].end, following


# ---- over tables ----------------------------------------------------------------------------


def with_originals(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``page_id, url, payload, refers_to``: which pages revisit which."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha1", F.unhex(F.sha1("payload")))
    long = F.octet_length("payload") >= least
    equal = rows.where(long).groupBy("sha1").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
    # Stored, so that both sides of the join are shuffled for it and a frequent payload's rows can be split.
    equal = stored(equal.where("n > 1 and original is not null").select(F.col("sha1").alias("same"), "original"))
    refers = F.when(F.col("page_id") != F.col("original"), F.col("original"))
    return rows.join(equal, long & (F.col("sha1") == F.col("same")), "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 1000, packed: bool = True) -> DataFrame:
    """Write one archive per task; the list of files: ``file, records``."""
    folder = folder or f"{scratch_dir(pages.sparkSession)}/warc"
    files, place = fs.FileSystem.from_uri(folder)
    files.create_dir(place)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files, place = fs.FileSystem.from_uri(folder)
        draft = f"{place}/draft-{context.partitionId():06d}-{context.taskAttemptId()}"
        name = f"pages-{context.partitionId():06d}.warc" + ".gz" * packed
        out, records = None, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to")]
            for row in zip(*columns, strict=True):
                out = out or files.open_output_stream(draft, compression=None)
                one = record(*(x.as_py() for x in row))
                out.write(member(one) if packed else one)
                records += 1
        if out is not None:
            out.close()
            publish(files, draft, f"{place}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": pa.array([records], pa.int64())})

    return stored(with_originals(pages, least).mapInArrow(write, "file string, records long"))


_ENTRY = "file string, start long, end long, reason string, inside long, warc_type string, record_id string, url string, " \
    "payload_bytes long, payload_digest string, refers_to string, payload binary"  # fmt: skip
_NAMES = [f.split()[0] for f in _ENTRY.split(", ")]


def _entry(file: str, entry: Record | Gap, with_payload: bool) -> tuple:
    if isinstance(entry, Gap):
        return (file, *entry, *[None] * 7)
    fields = entry.fields
    head, _, payload = entry.block.partition(b"\r\n\r\n")
    if fields.get("warc-type") == "revisit":  # the full payload is elsewhere: what the headers say of it
        said = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        size, payload = int(said[1]) if said else None, None
        sha1 = fields.get("warc-payload-digest", "").partition(":")[2]
        sha1 = base64.b32decode(sha1).hex() if len(sha1) == 32 else None
    else:
        size, sha1 = len(payload), hashlib.sha1(payload).hexdigest()
    names = (fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"))
    return (file, entry.start, entry.end, None, None, *names, size, sha1, fields.get("warc-refers-to"), payload if with_payload else None)


def read_archives(listed: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps (rows with a ``reason``) of the files in column ``file``, every file by a task.

    A gap in a member that gave records too says in ``inside`` how many unpacked bytes came before it.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.binary() if k == "binary" else pa.int64() if k == "long" else pa.string()) for n, k in (f.split() for f in _ENTRY.split(", "))])
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                files, place = fs.FileSystem.from_uri(uri)
                with files.open_input_file(place) as file:
                    rows, held = [], 0
                    for entry in Archive(file, file.size()).entries():
                        rows.append(_entry(uri, entry, with_payload))
                        held += len(entry.block) if isinstance(entry, Record) and with_payload else 200
                        if held > STEP:
                            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r, strict=True)) for r in rows], schema)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r, strict=True)) for r in rows], schema)

    return apart(listed.select("file")).mapInArrow(read, _ENTRY)


def pages_from_archives(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of pages written and read back; no page may be lost."""
    entries = read_archives(write_archives(pages, least=least), with_payload=False)
    lost = F.raise_error(F.concat(F.lit("a page was lost: "), "reason", F.lit(" in "), "file")).cast("long")
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^<urn:x-page:(-?[0-9]*)>$', 1), '') as bigint)")
    return entries.select(
        F.when(F.col("reason").isNotNull(), lost).otherwise(number("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )
