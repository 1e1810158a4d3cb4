"""Substring de-duplication over sliding runs of sentences.

From every sentence on, a run of consecutive sentences is hashed: as many as it takes to have
``run`` of them and ``least`` words; so is the shortest such run that ends with the sentence, and
a single sentence of ``least`` words. Together they cover every longer run to its last sentence.
Hashes meet in one join over all documents. A run that an earlier document holds, or that stood earlier in the
same text, is a repeat, and every sentence that a repeat covers is taken out. Documents are
ordered by id. Shorter repeats, such as a shared opening line, stay.

A sentence ends at a word that ends with ``.``, ``!`` or ``?``, at a line break, and at the end
of the text. Sentences are equal if their words are, A-Z in lower case.

Defined cases: a null or empty text has no sentences and stays as it is; copies of a row (same
id, same text) are one document and lose the same sentences; rows without an id are neither
counted nor changed; a text may lose all its sentences and is empty then; an empty table gives
an empty table; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditmill.llm.common import stored
from creditmill.llm.shingles import chunks, mixed, word_bounds, word_hashes

_U = np.uint64
_ENDS = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_KEYS = (_U(0x8CB92BA72F3D8DD7), _U(0xC2B2AE3D27D4EB4F))


class Runs:
    """Sentences and runs of a chunk of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, run: int, least: int):
        starts, ends, bounds = word_bounds(data, offsets)
        hashes = word_hashes(data, starts, ends)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        last = _ENDS[data[ends - 1]] if len(ends) else np.zeros(0, bool)
        if len(ends):
            last[:-1] |= (breaks[starts[1:]] > breaks[ends[:-1]]) | (row[1:] != row[:-1])
            last[-1] = True
        first = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(last) else np.zeros(0, np.int64)
        #: First byte and row of every sentence, and the sentences before every row.
        self.starts, self.row = starts[first], row[first]
        self.bounds = np.searchsorted(self.row, np.arange(len(offsets)))
        words = np.diff(np.append(first, len(hashes)))
        place = (np.arange(len(hashes)) - np.repeat(first, words)).astype(_U)
        sentences = [np.add.reduceat(mixed(hashes ^ mixed(place + k)), first) if len(first) else hashes for k in _KEYS]
        count = np.concatenate([[0], np.cumsum(words)])
        n = len(first)
        at = np.arange(n)
        end = np.maximum(at + run, np.searchsorted(count, count[:n] + least))
        whole = end <= self.bounds[self.row + 1] if n else np.zeros(0, bool)
        #: Sentences of the run that begins at each sentence, 0 where the text ends before.
        self.reach = np.where(whole, end - at, 0)
        begin = np.minimum(at + 1 - run, np.searchsorted(count, count[1:] - least, "right") - 1)
        whole_back = begin >= self.bounds[self.row] if n else np.zeros(0, bool)
        #: Sentences of the run that ends with each sentence, 0 where the text begins after.
        self.back = np.where(whole_back, at + 1 - begin, 0)
        other = np.flatnonzero(whole_back)
        other = other[self.reach[begin[other]] != self.back[other]]  # the rest are runs from their first sentence on
        single = words >= least
        forth = np.flatnonzero(whole)
        first_of, length = np.concatenate([forth, begin[other]]), np.concatenate([self.reach[forth], self.back[other]])
        self.at = np.concatenate([first_of, at[single]])
        self.length = np.concatenate([length, np.ones(int(single.sum()), np.int64)])
        #: A number of each run in its chunk: three for every sentence, for runs from it on, itself, and runs up to it.
        self.number = np.concatenate([3 * forth, 3 * other + 2, 3 * at[single] + 1])
        self.hash = []
        for k, own in zip(_KEYS, sentences, strict=True):
            total = np.zeros(len(length), _U)
            for j in range(int(length.max(initial=0))):
                more = np.flatnonzero(j < length)
                total[more] = mixed(total[more] + mixed(own[first_of[more] + j] + _U(j)))
            total = mixed(total + length.astype(_U) * k)
            self.hash.append(np.concatenate([total, mixed(own[single] + k)]))

    def covered(self, number: int) -> slice:
        """The sentences of a run, by its number."""
        at, kind = divmod(number, 3)
        return slice(at + 1 - int(self.back[at]), at + 1) if kind == 2 else slice(at, at + (1 if kind else int(self.reach[at])))

    def again(self) -> np.ndarray:
        """Which runs stood earlier in the same text."""
        key = mixed(self.hash[0] + mixed(self.row[self.at].astype(_U) + _U(1)))
        order = np.lexsort((self.at, key))
        repeat = np.zeros(len(key), bool)
        repeat[order[1:]] = key[order][1:] == key[order][:-1]
        return repeat


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("version"), F.col("text").cast("string").alias("text"))


def _all_runs(docs: DataFrame, run: int, least: int) -> DataFrame:
    """``h1, h2, id, version, at``: each run once per text. ``at`` numbers the runs of a text."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            versions = batch.column("version").to_numpy()
            for first, data, offsets in chunks(batch.column("text")):
                runs = Runs(data, offsets, run, least)
                keep = ~runs.again()
                row = runs.row[runs.at[keep]]
                at = runs.number[keep] - 3 * runs.bounds[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs.hash[0][keep].view(np.int64)), pa.array(runs.hash[1][keep].view(np.int64)),
                     pa.array(ids[first + row].astype(np.int64)), pa.array(versions[first + row]), pa.array(at, pa.int64())],
                    names=["h1", "h2", "id", "version", "at"],
                )

    named = _text(docs).where("id is not null and text is not null")
    return named.mapInArrow(find, "h1 long, h2 long, id long, version long, at long")


def repeated_runs(docs: DataFrame, run: int = 2, least: int = 15) -> DataFrame:
    """``id, version, runs``: the runs of a text that an earlier document holds."""
    runs = _all_runs(docs, run, least)
    firsts = runs.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    # Stored, so that both sides of the join are shuffled for it and a frequent run's rows can be split.
    shared = stored(firsts.where(F.col("first") < F.col("last")).drop("last"))
    later = runs.join(shared, ["h1", "h2"]).where(F.col("id") > F.col("first"))
    return later.groupBy("id", "version").agg(F.collect_set("at").alias("runs"))


def dedup_spans(docs: DataFrame, run: int = 2, least: int = 15) -> DataFrame:
    """``docs`` in a struct ``row``, with ``kept_text``, ``n_sentences``, ``n_removed``."""
    gone = repeated_runs(docs, run, least).select(F.col("id").alias("gone_id"), F.col("version").alias("gone_version"), "runs")
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"])
    rows = docs.select(row.alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"]).alias("version"), docs["text"].cast("string").alias("text"))
    joined = rows.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("version") == F.col("gone_version")), "left")

    def rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_sentences, n_removed = batch.column("text").to_pylist(), [], []
            repeated, ids = batch.column("runs").to_pylist(), batch.column("id").to_pylist()
            for first, data, offsets in chunks(batch.column("text")):
                found = Runs(data, offsets, run, least)
                covered = np.zeros(len(found.starts), bool)
                again = found.again()
                for number in found.number[again].tolist():
                    covered[found.covered(number)] = True
                for i in range(len(offsets) - 1):
                    a, b = int(found.bounds[i]), int(found.bounds[i + 1])
                    for place in repeated[first + i] or ():
                        covered[found.covered(3 * a + place)] = True
                    if ids[first + i] is None:
                        covered[a:b] = False
                    n_sentences.append(b - a)
                    n_removed.append(int(covered[a:b].sum()))
                    if n_removed[-1]:
                        edges = [*found.starts[a:b].tolist(), int(offsets[i + 1])]
                        head = data[int(offsets[i]) : edges[0]].tobytes()
                        kept = [data[edges[k - a] : edges[k - a + 1]].tobytes() for k in range(a, b) if not covered[k]]
                        texts[first + i] = (head + b"".join(kept)).decode()
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), pa.array(n_sentences, pa.int64()), pa.array(n_removed, pa.int64())],
                names=["row", "kept_text", "n_sentences", "n_removed"],
            )

    needed = joined.select("row", "id", "text", "runs")
    counts = [T.StructField(c, T.LongType()) for c in ("n_sentences", "n_removed")]
    kinds = T.StructType([joined.schema["row"], T.StructField("kept_text", T.StringType()), *counts])
    return needed.mapInArrow(rebuild, kinds)


def drop_repeated_spans(docs: DataFrame, run: int = 2, least: int = 15) -> DataFrame:
    """``docs`` with the same columns, repeated sentences taken out of ``text``."""
    done = dedup_spans(docs, run, least)
    return done.select(*[(F.col("kept_text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def span_report(docs: DataFrame, run: int = 2, least: int = 15) -> DataFrame:
    """One row per document: ``doc_id, n_sentences, n_removed, text`` (what is left)."""
    done = dedup_spans(docs.select("doc_id", "text"), run, least)
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_sentences", "n_removed", F.col("kept_text").alias("text"))
