"""Line de-duplication with DataFrame functions only.

Lines are exploded, normalised and hashed; documents are counted per hash; a line whose key is
held by enough documents stays in the first of them alone; texts are reassembled by position.

Defined cases: a null or empty text is one empty line; keys shorter than ``min_chars`` never
count; copies of a row (same id, same text) count as one document and lose the same lines; rows
without an id are neither counted nor changed; an empty table gives an empty table; other
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import BLANKS, ascii_lower, stored


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hashed_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """id, version (hash of the text), pos, and 128 bits of hash of every key that counts."""
    lines = rows.where("id is not null").select("id", "version", F.posexplode("lines").alias("pos", "line"))
    keyed = lines.select("id", "version", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select(
        "id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2")
    )


def repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``id``, ``version``, ``dropped`` (ascending positions of the lines to drop) of documents that lose lines."""
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.xxhash64("text").alias("version"),
        F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"),
    )
    hashed = _hashed_lines(rows, min_chars)
    # Counted per document before per hash: a line that a third of all documents hold is spread over their ids.
    once = hashed.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    common = once.groupBy("h1", "h2").agg(F.count("one").alias("n"), F.min("id").alias("keeper"))
    # Stored, so that both sides of the join are shuffled for it and a frequent line's rows can be split.
    common = stored(common.where(F.col("n") >= min_docs).drop("n"))
    lost = hashed.join(common, ["h1", "h2"]).where("id <> keeper")
    return lost.groupBy("id", "version").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def _without(lines: Column, dropped: Column) -> Column:
    """The lines between dropped positions, as slices: linear in lines and positions together."""
    ends = F.concat(dropped, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
    gaps = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda g: g["b"] > g["a"])
    return F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"])))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` in a struct ``row``, with ``kept_text``, ``n_lines``, ``n_dropped``."""
    lost = repeated_lines(docs, min_chars, min_docs)
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("row"),
        docs["doc_id"].alias("row_id"),
        F.xxhash64(docs["text"]).alias("row_version"),
        docs["text"].alias("old_text"),
    )
    joined = rows.join(lost, (F.col("row_id") == F.col("id")) & (F.col("row_version") == F.col("version")), "left")
    # The lines are a column of their own below the lambdas, so that a text is split once.
    lines = joined.withColumn("lines", F.split(F.coalesce("old_text", F.lit("")), "\n", -1))
    n_dropped = F.coalesce(F.size("dropped"), F.lit(0))
    n_dropped = F.when(F.col("dropped").isNull(), 0).otherwise(n_dropped)
    kept = F.when(F.col("dropped").isNull(), F.col("old_text")).otherwise(
        F.array_join(_without(F.col("lines"), F.col("dropped")), "\n")
    )
    return lines.select(
        "row",
        kept.alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        n_dropped.cast("long").alias("n_dropped"),
    )


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with the same columns, repeated lines taken out of ``text``."""
    done = dedup_lines(docs, min_chars, min_docs)
    return done.select(*[(F.col("kept_text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, kept_sha256``."""
    done = dedup_lines(docs.select("doc_id", "text"), min_chars, min_docs)
    digest = F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256)
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", digest.alias("kept_sha256"))
