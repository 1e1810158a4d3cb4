"""Token ids of all documents in binary files, with document boundaries in Elias-Fano form.

A file holds the ids of a run of documents in ascending order of id, strung together in the
narrowest of 16 or 32 bits, then two Elias-Fano sequences (boundaries and document ids) and a
footer. Boundaries take about two bits and the logarithm of the mean length each; a select
structure of one position in every 256 gives any of them without reading the others. Files are
written under a name of the attempt and renamed, so that a task that runs again does no harm.

Defined cases: a null or empty text has the end id alone; rows without an id come first, in a
file of their own kind of entry (no id); equal ids stay next to each other, as many as there are;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import apart, publish, scratch_dir, slices, stored
from creditmill.llm.tokens import encoder
from creditmill.llm.vocabulary import Vocabulary

#: Ids that a task reads back, at least where there are more than cores can share.
READ = 1 << 25
MAGIC = b"TOKENS01"
_FOOTER = "<QQQQQQ8s"  # documents, without id, ids, bytes per id, bytes of either sequence, magic
#: Ones between two remembered positions of the select structure.
EVERY = 256


class EliasFano:
    """A sequence of integers that do not descend, near the least space that it can take."""

    _HEAD = "<QQqQ"  # length, low bits, first value, bytes of the low part

    def __init__(self, data: bytes):
        self.n, self.low_bits, self.base, low = struct.unpack_from(self._HEAD, data)
        at = struct.calcsize(self._HEAD)
        self.low = np.frombuffer(data, np.uint8, low, at)
        n_marks = -(-self.n // EVERY)
        self.marks = np.frombuffer(data, np.uint32, 2 * n_marks, at + low).view(np.uint64) if n_marks else np.zeros(0, np.uint64)
        self.high = np.frombuffer(data, np.uint8, -1, at + low + 8 * n_marks)

    @classmethod
    def of(cls, values: np.ndarray) -> bytes:
        """The sequence as bytes: low bits packed, high parts in unary, sampled positions of ones."""
        values = np.asarray(values, np.int64)
        n, base = len(values), int(values[0]) if len(values) else 0
        rest = (values - base).astype(np.uint64)
        span = int(rest[-1]) if n else 0
        low_bits = max(0, (span // n).bit_length() - 1) if n else 0
        bits = (rest[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :] & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little").tobytes()
        ones = (rest >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return struct.pack(cls._HEAD, n, low_bits, base, len(low)) + low + ones[::EVERY].tobytes() + np.packbits(unary, bitorder="little").tobytes()

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.int64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        return (bits.reshape(-1, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def values(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Values ``first`` to ``last``, from the remembered position before the first of them on."""
        last = self.n if last is None else min(last, self.n)
        if first >= last:
            return np.zeros(0, np.int64)
        mark = first // EVERY
        start = int(self.marks[mark])
        after = -(-last // EVERY)
        end = int(self.marks[after]) + 1 if after < len(self.marks) else 8 * len(self.high)
        bits = np.unpackbits(self.high[start // 8 : -(-end // 8)], bitorder="little")
        bits[: start % 8] = 0
        ones = np.flatnonzero(bits)[first - mark * EVERY : last - mark * EVERY] + start // 8 * 8
        return ((ones - np.arange(first, last)) << self.low_bits | self._lows(first, last)) + self.base

    def select(self, i: int) -> int:
        """Value ``i`` alone."""
        return int(self.values(i, i + 1)[0])


def _write(docs: DataFrame, path: str, end_id: int, folder: str) -> DataFrame:
    """One file per range of ids; a row for each: ``part, file, documents, ids``."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        files, place = fs.FileSystem.from_uri(folder)
        draft, name = f"{place}/draft-{part:06d}-{attempt}", f"part-{part:06d}.tokens"
        ids_of, bounds, total, nameless, out = [], [0], 0, 0, None
        for batch in batches:
            own = batch.column("doc_id").to_numpy(zero_copy_only=False) if not batch.column("doc_id").null_count else None
            if own is None:
                own = np.array([x for x in batch.column("doc_id").to_pylist() if x is not None], np.int64)
            nameless += batch.num_rows - len(own)
            ids_of.append(own.astype(np.int64))
            for ids in encode(batch.column("text").to_pylist()):
                out = out or files.open_output_stream(draft)
                if total == 0:
                    out.write(MAGIC)
                out.write(np.append(ids, np.uint32(end_id)).astype(np.uint32 if wide else np.uint16).tobytes())
                total += len(ids) + 1
                bounds.append(total)
        if out is None:
            return
        ends, named = EliasFano.of(np.array(bounds)), EliasFano.of(np.concatenate(ids_of))
        out.write(ends + named + struct.pack(_FOOTER, len(bounds) - 1, nameless, total, 4 if wide else 2, len(ends), len(named), MAGIC))
        out.close()
        publish(files, draft, f"{place}/{name}")
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "file": [f"{folder}/{name}"], "documents": pa.array([len(bounds) - 1], pa.int64()), "ids": pa.array([total], pa.int64())}
        )

    wide = max(Vocabulary(path).base - 1, end_id) > 0xFFFF
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ("doc_id", F.xxhash64("text"))  # so that rows of one id, or without one, can be parted too
    dealt = rows.repartitionByRange(slices(docs.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(write, "part int, file string, documents long, ids long")


def write_store(docs: DataFrame, path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the ids of all texts; the list of files: ``file, documents, ids, before`` (ids in earlier files)."""
    folder = folder or f"{scratch_dir(docs.sparkSession)}/tokens"
    files, place = fs.FileSystem.from_uri(folder)
    files.create_dir(place)
    # One row per file: their number is that of the partitions, however much they hold.
    written = sorted(stored(_write(docs, path, end_id, folder)).collect(), key=lambda r: r["part"])
    rows, before = [], 0
    for r in written:
        rows.append((r["file"], r["documents"], r["ids"], before))
        before += r["ids"]
    return docs.sparkSession.createDataFrame(rows, "file string, documents long, ids long, before long")


class Store:
    """A file of the store, open for reading."""

    def __init__(self, uri: str):
        files, place = fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(place)
        size = self.file.size()
        foot = struct.calcsize(_FOOTER)
        footer = self.file.read_at(foot, size - foot)
        self.documents, self.nameless, self.ids, self.width, ends, named, magic = struct.unpack(_FOOTER, footer)
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is not a token file, or is cut off")
        at = size - foot - named
        self.named = EliasFano(self.file.read_at(named, at))
        self.ends = EliasFano(self.file.read_at(ends, at - ends))

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` of the file."""
        data = self.file.read_at((last - first) * self.width, len(MAGIC) + first * self.width)
        return np.frombuffer(data, np.uint16 if self.width == 2 else np.uint32).astype(np.uint32)

    def document(self, i: int) -> np.ndarray:
        """The ids of document ``i``, found through the select structure."""
        return self.read(self.ends.select(i), self.ends.select(i + 1))

    def blocks(self, documents: int = 2048) -> Iterator[tuple[list[int | None], np.ndarray]]:
        """Document ids and boundaries of runs of documents."""
        for a in range(0, self.documents, documents):
            b = min(a + documents, self.documents)
            named = self.named.values(max(0, a - self.nameless), max(0, b - self.nameless)).tolist()
            yield [None] * (b - a - len(named)) + named, self.ends.values(a, b + 1)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def read_store(listed: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with Store(row["file"]) as store:
                    for named, bounds in store.blocks():
                        checks = []
                        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                            checks.append(zlib.crc32(store.read(a, b).tobytes()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(named, pa.int64()), pa.array(bounds[:-1] + row["before"]), pa.array(np.diff(bounds)), pa.array(checks, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    # A task for each core at least, and for every READ ids.
    size = listed.agg(F.sum("ids")).first()[0] or 0
    tasks = max(listed.sparkSession.sparkContext.defaultParallelism, -(-size // READ))
    return apart(listed.select("file", "before"), tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored_tokens(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """The ids of all texts written and read back."""
    return read_store(write_store(docs, path, end_id))
