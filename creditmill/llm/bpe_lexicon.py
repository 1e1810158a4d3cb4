"""Byte-pair encoding and decoding through a minimal acyclic transducer of frequent words.

Frequent words are counted over all texts with mergeable bounded summaries and compiled into an
automaton whose words share prefixes and suffixes; the outputs on its edges add up to a word's
rank, which leads to its ids. Executors map the compiled file into memory, so that the workers
of a machine share it. Words outside it are merged exactly, pair by pair in the order of ranks.

Defined cases: a null or empty text has no ids and decodes to an empty text; added tokens of
the vocabulary are single ids; bytes that are no UTF-8 decode to the replacement character;
copies of a row give equal rows; an empty table gives an empty table (and an empty automaton).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import scratch_dir, stored
from creditmill.llm.quality_rules import bucket
from creditmill.llm.shingles import chunks
from creditmill.llm.vocabulary import Vocabulary
from creditmill.llm.word_split import LONGEST, Words, added_pattern

#: Words in the automaton, of at most ``LONGEST`` bytes; words a task's summary keeps.
LEXICON, SUMMARY = 65_536, 100_000
#: Bytes of text whose words are split, counted and looked up at once.
AT_ONCE = 1 << 21
#: Words outside the automaton that a task remembers.
REMEMBERED = 200_000


# ---- the automaton --------------------------------------------------------------------------


def compile_words(words: list[bytes], ids: Callable[[list[bytes]], list[bytes]]) -> dict[str, np.ndarray]:
    """The minimal automaton of ``words`` as arrays of edges, and the ids by rank.

    Words come in order; whatever no later word can change is frozen, and a frozen state equal
    to an earlier one is replaced by it. An edge's output is the number of words that branch off
    before it, so that outputs along a word add up to its rank.
    """
    words = sorted(set(words))
    edges: list[dict[int, int]] = [{}]
    final = [False]
    equal: dict[tuple, int] = {}
    path = [0]  # states of the previous word
    last = b""

    def freeze(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            same = equal.setdefault((final[state], tuple(edges[state].items())), state)
            edges[path[-1]][last[len(path) - 1]] = same

    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        freeze(shared)
        for b in word[shared:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][b] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        last = word
    freeze(0)

    below: dict[int, int] = {}
    numbers: dict[int, int] = {}
    stack = [0]
    while stack:  # words that end below a state, children first
        state = stack[-1]
        todo = [t for t in edges[state].values() if t not in below]
        if todo:
            stack.extend(todo)
            continue
        stack.pop()
        if state not in below:
            below[state] = final[state] + sum(below[t] for t in edges[state].values())
            numbers[state] = -1
    for number, state in enumerate(sorted(numbers)):
        numbers[state] = number  # the start is 0
    key, to, out = [], [], []
    for state, number in sorted(numbers.items()):
        passed = int(final[state])
        for b, target in sorted(edges[state].items()):
            key.append(number << 8 | b)
            to.append(numbers[target])
            out.append(passed)
            passed += below[target]
    found = ids(words)
    return {
        "key": np.array(key, np.uint32),
        "to": np.array(to, np.uint32),
        "out": np.array(out, np.uint32),
        "final": np.array([final[s] for s in sorted(numbers)], np.uint32),
        "starts": np.cumsum([0, *(len(f) // 4 for f in found)], dtype=np.uint32),
        "ids": np.frombuffer(b"".join(found), np.uint32),
    }


_ARRAYS = ("key", "to", "out", "final", "starts", "ids")


def to_file(arrays: dict[str, np.ndarray]) -> bytes:
    head = np.array([len(arrays[a]) for a in _ARRAYS], np.uint32)
    return b"".join([head.tobytes(), *(arrays[a].tobytes() for a in _ARRAYS)])


class Lexicon:
    """A compiled automaton mapped into memory."""

    def __init__(self, file: str):
        data = np.memmap(file, np.uint32, "r")
        ends = np.cumsum([len(_ARRAYS), *data[: len(_ARRAYS)].tolist()])
        for name, a, b in zip(_ARRAYS, ends[:-1], ends[1:], strict=True):
            setattr(self, name, data[a:b])

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 outside the lexicon."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.array([w[:LONGEST] for w in words], f"S{LONGEST}").view(np.uint8).reshape(-1, LONGEST)
        return self.walk(text, lengths)

    def walk(self, text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The same for words as rows of bytes: all words take a step at a time."""
        rank = np.full(len(lengths), -1, np.int64)
        if not len(self.key):
            return rank
        live = np.flatnonzero((lengths > 0) & (lengths <= LONGEST))
        text = text[live]
        rows = np.arange(len(live))
        state, total = np.zeros(len(live), np.uint32), np.zeros(len(live), np.int64)
        for step in range(LONGEST):
            done = rows[lengths[live[rows]] == step]
            ends = done[self.final[state[done]] == 1]
            rank[live[ends]] = total[ends]
            rows = rows[lengths[live[rows]] > step]
            if not len(rows):
                return rank
            key = state[rows] << np.uint32(8) | text[rows, step]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[at] == key
            rows, at = rows[hit], at[hit]
            state[rows] = self.to[at]
            total[rows] += self.out[at]
        ends = rows[self.final[state[rows]] == 1]
        rank[live[ends]] = total[ends]
        return rank


class Coder:
    """Ids of texts: words in the lexicon by their ranks, others merged and remembered; ``vocabulary`` decodes."""

    def __init__(self, path: str, file: str):
        self.vocabulary, self.lexicon, self.added = Vocabulary(path), Lexicon(file), added_pattern(path)
        self.own = {w.encode(): np.array([i], np.uint32).tobytes() for w, i in self.vocabulary.added.items()}
        self.outside: dict[bytes, bytes] = {}

    def chunks(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of some texts, strung together, and where each text's begin; some more; until all texts are done."""
        texts.validate(full=True)
        for _, data, offsets in chunks(texts, AT_ONCE):
            words = Words(data, offsets, self.added)
            place, number, rows = words.distinct()
            begin, n, pool = self._ids(words, place, rows)
            n, begin = n[number], begin[number]
            ends = np.concatenate([[0], np.cumsum(n)])
            yield pool[np.repeat(begin - ends[:-1], n) + np.arange(ends[-1])], ends[words.bounds]

    def _ids(self, words: Words, place: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words at some places, where the ids of each begin, their number, and all these ids."""
        ranks = self.lexicon.walk(rows.view(np.uint8), words.size[place])
        unseen = np.flatnonzero(ranks < 0)
        asked = words.bytes_of(place[unseen])
        if len(self.outside) > REMEMBERED or not self.outside:
            self.outside = dict(self.own)
        new = [w for w in asked if w not in self.outside]
        self.outside.update(zip(new, self.vocabulary.merge(new), strict=True))
        merged = [self.outside[w] for w in asked]
        starts = self.lexicon.starts.astype(np.int64)
        begin, n = starts[ranks], starts[np.minimum(ranks + 1, len(starts) - 1)] - starts[ranks]
        n[unseen] = np.fromiter((len(m) // 4 for m in merged), np.int64, len(merged))
        begin[unseen] = len(self.lexicon.ids) + np.cumsum(n[unseen]) - n[unseen]
        return begin, n, np.concatenate([self.lexicon.ids, np.frombuffer(b"".join(merged), np.uint32)])


def coder(path: str, file: str) -> tuple[Callable[[pa.Array | list[str | None]], Iterator[np.ndarray]], Vocabulary]:
    """A function from texts to arrays of ids, and the vocabulary, which decodes."""
    own = Coder(path, file)

    def encode(texts: pa.Array | list[str | None]) -> Iterator[np.ndarray]:
        for ids, bounds in own.chunks(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())):
            yield from (ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))

    return encode, own.vocabulary


# ---- over tables ----------------------------------------------------------------------------


def thinned(counts: Counter, keep: int) -> Counter:
    """A summary cut to ``keep`` words: every count loses the count of the first word that goes."""
    if len(counts) <= keep:
        return counts
    top = counts.most_common(keep + 1)
    floor = top[-1][1]
    return Counter({w: n - floor for w, n in top if n > floor})


def frequent_words(docs: DataFrame, path: str, size: int = LEXICON) -> list[str]:
    """About the most frequent words of all texts, from one bounded summary per task; at most ``size`` of them.

    Words whose counts fall into the bucket that would exceed ``size`` are left out.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added, counts = added_pattern(path), Counter()
        for batch in batches:
            batch.column("text").validate(full=True)
            for _, data, offsets in chunks(batch.column("text"), AT_ONCE):
                words = Words(data, offsets, added)
                place, number, _ = words.distinct()
                short = words.size[place] <= LONGEST
                for word, n in zip(words.bytes_of(place[short]), np.bincount(number, minlength=len(place))[short].tolist(), strict=True):
                    counts[word] += n
                if len(counts) > 4 * SUMMARY:
                    counts = thinned(counts, SUMMARY)
        counts = thinned(counts, SUMMARY)
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_pydict({"word": words, "n": pa.array(list(counts.values()), pa.int64())})

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    total = stored(found.groupBy("word").agg(F.sum("n").alias("n")))
    # A sketch of the counts, sixteen buckets to a power of two, says from which count on the words are few enough.
    held, least = 0, None
    for row in total.groupBy(bucket(F.col("n")).alias("n")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect():
        held += row["words"]
        if held > size:
            break
        least = row["n"]
    if least is None:
        return []
    # Bounded by ``size``: this list is what the automaton is compiled from.
    return [r["word"] for r in total.where(F.col("n") >= least).select("word").collect()]


def compiled_lexicon(docs: DataFrame, path: str, size: int = LEXICON) -> str:
    """Compile the frequent words of ``docs`` and send the file to all executors; its name there."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(path)
    words = [w.encode() for w in frequent_words(docs, path, size) if w not in vocabulary.added and "\0" not in w]
    folder = scratch_dir(spark)
    name = f"lexicon-{folder.rsplit('-', 1)[-1]}.bin"
    files, place = fs.FileSystem.from_uri(folder)
    with files.open_output_stream(f"{place}/{name}") as out:
        out.write(to_file(compile_words(words, vocabulary.merge)))
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def encode_documents(docs: DataFrame, path: str, lexicon: str) -> DataFrame:
    """``doc_id, ids``: the ids of every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = coder(path, SparkFiles.get(lexicon))
        for batch in batches:
            ids = pa.array(encode(batch.column("text")), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return _read(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Vocabulary(path).decoder()
        for batch in batches:
            texts = [decode(np.array(ids or (), np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, size: int = LEXICON) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text encoded, its ids decoded."""
    lexicon = compiled_lexicon(docs, path, size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Coder(path, SparkFiles.get(lexicon))
        spelled, decimal = own.vocabulary.spelled(), own.vocabulary.spelled(lambda i: b"%d," % i)
        for batch in batches:
            n, listed, decoded = [], [], []
            for ids, bounds in own.chunks(batch.column("text")):
                n += np.diff(bounds).tolist()
                listed += [hashlib.sha256(x[:-1]).hexdigest() for x in decimal(ids, bounds)]
                decoded += [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in spelled(ids, bounds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _read(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
