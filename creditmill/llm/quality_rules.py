"""Quality rules whose thresholds come from quantile sketches per language and source.

Counts of every text become whole-number metrics (per thousand words or lines). A sketch is a
table of counts per bucket of a metric, sixteen buckets to every power of two: sketches merge by
adding counts, in any order and over any number of tasks, and a quantile is within a sixteenth
of the true one. Thresholds are read from the sketch of a document's language and source; where
that has too few documents, from the merged sketch of the language; where that is small too,
from that of all. A threshold is the median and so many times the way from there to the end of
the bucket of an upper quantile: the sketch alone decides, no constant stands in for a spread.
Documents join their thresholds and those outside them are rejected.

Defined cases: a null text has no words and fails the base rules; a null language or source is
a group like any other; ties and copies of rows count one by one; rows without an id are judged
like others; an empty table gives an empty table; other columns are not read, or pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from creditmill.llm.common import stored
from creditmill.llm.shingles import chunks, mixed, word_bounds, word_hashes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_U = np.uint64

#: Metric -> its value from the counts, the upper quantile (in percent) whose distance from the median is
#: the group's spread, how many spreads a document may be from the median, and whether values below count too.
METRICS = {
    "symbols": ("1000 * n_symbols div nullif(n_words, 0)", 90, 4, False),
    "repeats": ("1000 * n_repeat_words div nullif(n_words, 0)", 98, 2, False),
    "dup_lines": ("1000 * n_dup_lines div nullif(n_lines, 0)", 98, 2, False),
    "word_length": ("100 * word_chars div nullif(n_words, 0)", 90, 5, True),
}
#: Documents that a sketch needs.
LEAST = 100


def _repeats(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values of rows: which occur again in their row, and which of those are not the first."""
    key = mixed(values + mixed(rows.astype(_U) + _U(1)))
    _, first, place, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return counts[place] > 1, first[place] != np.arange(len(key))


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text, as arrays."""
    out = {c: [] for c in COUNTS}
    for _, data, offsets in chunks(texts):
        n_rows = len(offsets) - 1
        starts, ends, bounds = word_bounds(data, offsets)
        row = np.repeat(np.arange(n_rows), np.diff(bounds))
        per_row = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        out["n_words"].append(np.diff(bounds))
        out["word_chars"].append(np.bincount(row, before[ends] - before[starts], n_rows).astype(np.int64))
        out["n_symbols"].append(per_row(_IS_SYMBOL[data]))

        breaks = np.flatnonzero(data == 10)
        line_starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
        line_starts = line_starts[line_starts < len(data)]
        own = np.searchsorted(offsets, line_starts, "right") - 1
        line_ends = np.append(line_starts[1:], len(data))
        line_ends = line_ends - (data[line_ends - 1] == 10) if len(line_ends) else line_ends
        with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        line_starts, line_ends, own = line_starts[with_word], line_ends[with_word], own[with_word]
        _, again = _repeats(own, word_hashes(data, line_starts, line_ends, lower=False))
        out["n_lines"].append(np.bincount(own, minlength=n_rows))
        out["n_dup_lines"].append(np.bincount(own[again], minlength=n_rows))

        hashes = word_hashes(data, starts, ends, lower=False)
        n = max(0, len(hashes) - 2)
        whole = np.flatnonzero(row[:n] == row[2:]) if n else np.zeros(0, np.int64)
        windows = mixed(mixed(mixed(hashes[whole]) + hashes[whole + 1]) + hashes[whole + 2]) if n else hashes[:0]
        twice, _ = _repeats(row[whole], windows)
        covered = np.zeros(len(hashes), bool)
        for k in range(3):
            covered[whole[twice] + k] = True
        out["n_repeat_words"].append(np.bincount(row[covered], minlength=n_rows))
    return {c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in out.items()}


def _verdict_key() -> list[Column]:
    """What a verdict depends on, as two hashes: rows equal in it are judged alike."""
    parts = [F.col(c).cast("string") for c in ("text", "lang", "source")]
    null = F.concat(*[F.col(c).isNull().cast("string") for c in ("text", "lang", "source")])
    return [F.xxhash64(F.lit(k), null, *parts) for k in (1, 2)]


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source``, ``key_1`` and ``key_2`` (see ``_verdict_key``) and the counts of every text."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = text_counts(batch.column("text"))
            keys = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, counts.values())], names=[*names, *COUNTS])

    kinds = {"doc_id": "long", "lang": "string", "source": "string", "text": "string"}
    keys = [k.alias(f"key_{i}") for i, k in enumerate(_verdict_key(), 1)]
    rows = docs.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()], *keys)
    names = [c for c in rows.columns if c != "text"]
    return rows.mapInArrow(measure, T.StructType([*[rows.schema[c] for c in names], *[T.StructField(c, T.LongType()) for c in COUNTS]]))


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < 50) | (100 * F.col(n_repeat_words) > 50 * F.col(n_words))


def width(value: Column) -> Column:
    """How wide a value's bucket is: what its bits after the first five can tell apart."""
    return F.pow(F.lit(2), F.greatest(F.lit(0), F.length(F.bin(value)) - 5)).cast("long")


def bucket(value: Column) -> Column:
    """The lower end of a value's bucket: its five leading bits."""
    return value - value % width(value)


def sketches(counts: DataFrame) -> DataFrame:
    """One sketch for every language, source and metric: ``lang, source, metric, value, n``."""
    good = counts.where(~base_failed())
    entries = [F.struct(F.lit(m).alias("metric"), bucket(F.expr(rule)).alias("value")) for m, (rule, *_) in METRICS.items()]
    rows = good.select("lang", "source", F.explode(F.array(*entries)).alias("e"))
    return rows.groupBy("lang", "source", F.col("e.metric").alias("metric"), F.col("e.value").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches added up over everything but ``keys``."""
    return sketch.groupBy(*keys, "metric", "value").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """``total, q50`` of every sketch, and the upper quantile ``tail`` that its metric's spread is taken from."""
    order = Window.partitionBy(*keys, "metric").orderBy("value")
    ranked = sketch.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys, "metric")))
    percent = F.element_at(F.create_map(*[F.lit(x) for m, (_, p, *_) in METRICS.items() for x in (m, p)]), F.col("metric"))
    at = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("total"), F.col("value")))
    return ranked.groupBy(*keys, "metric").agg(F.max("total").alias("total"), at(F.lit(50)).alias("q50"), at(percent).alias("tail"))


def thresholds(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, source`` and ``<metric>_low``, ``<metric>_high`` for every pair of the two that occurs."""
    own = stored(sketches(counts))
    by_lang, by_all = merged(own, "lang"), merged(own)
    # Stored: a few rows for each group, whose size lets Spark choose how to join them.
    levels = [
        stored(quantiles(s, *k)).select(*[F.col(c).alias(f"{c}_{i}") for c in (*k, "metric", "total", "q50", "tail")])
        for i, (s, k) in enumerate([(own, ("lang", "source")), (by_lang, ("lang",)), (by_all, ())])
    ]
    pairs = counts.select("lang", "source").distinct()
    named = pairs.withColumn("metric", F.explode(F.array(*map(F.lit, METRICS))))
    for i, keys in enumerate((("lang", "source"), ("lang",), ())):
        on = F.col("metric") == F.col(f"metric_{i}")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}_{i}"))
        named = named.join(levels[i], on, "left")
    pick = lambda q: F.when(F.col("total_0") >= least, F.col(f"{q}_0")).when(F.col("total_1") >= least, F.col(f"{q}_1")).otherwise(F.col(f"{q}_2"))
    chosen = named.select("lang", "source", "metric", *[pick(q).alias(q) for q in ("q50", "tail")])
    columns = []
    for m, (_, _, times, below) in METRICS.items():
        reach = times * (F.col("tail") + width(F.col("tail")) - F.col("q50"))
        only = F.col("metric") == m
        columns.append(F.max(F.when(only, F.col("q50") + reach)).alias(f"{m}_high"))
        columns.append(F.max(F.when(only, F.col("q50") - reach if below else F.lit(0))).alias(f"{m}_low"))
    return stored(chosen.groupBy("lang", "source").agg(*columns))


def _with_verdicts(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """``counts`` with ``base_failed`` and ``kept``."""
    limits = limits.withColumnsRenamed({"lang": "limit_lang", "source": "limit_source"})
    same = F.col("lang").eqNullSafe(F.col("limit_lang")) & F.col("source").eqNullSafe(F.col("limit_source"))
    inside = F.lit(True)
    for m, (rule, *_) in METRICS.items():
        inside = inside & F.expr(rule).between(F.col(f"{m}_low"), F.col(f"{m}_high"))
    kept = ~base_failed() & F.coalesce(inside, F.lit(False))
    return counts.join(limits, same, "left").select(*counts.columns, base_failed().alias("base_failed"), kept.alias("kept"))


def judged(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` for every row of ``docs``."""
    counts = stored(measured(docs))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return _with_verdicts(counts, thresholds(counts, least)).select("doc_id", *names, "base_failed", "kept")


def keep_good(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` without the rows that the rules reject; every row is judged by itself, whatever its id.

    Texts are measured once. The rows themselves stay on the JVM's side: those whose text, language
    and source were rejected go by an anti join on hashes of the three.
    """
    counts = stored(measured(docs))
    judged_rows = _with_verdicts(counts, thresholds(counts, least))
    rejected = stored(judged_rows.where(~F.col("kept")).select("key_1", "key_2").distinct())
    one, two = _verdict_key()
    return docs.join(rejected, (one == rejected["key_1"]) & (two == rejected["key_2"]), "left_anti")
