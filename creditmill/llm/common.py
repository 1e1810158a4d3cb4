"""What the operators of this package share: scratch tables, word patterns, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII blanks, and the capitals that lower-casing touches.
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the session's JVM ends.

    Without that setting a temporary folder serves, in local mode only.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.gettempdir()
    path = f"{shared.rstrip('/')}/llm-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once as Parquet in the shared folder: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def publish(files: fs.FileSystem, draft: str, place: str) -> None:
    """Give a finished file its name; one that an earlier attempt of the task left goes."""
    if files.get_file_info(place).type != fs.FileType.NotFound:
        files.delete_file(place)
    files.move(draft, place)


def slices(spark: SparkSession) -> int:
    """How many parts block-wise operators deal their rows to: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def apart(listed: DataFrame, most: int = 10_000) -> DataFrame:
    """A short stored list, such as one of files, dealt to a task for each row (at most ``most`` tasks)."""
    return listed.repartition(max(1, min(most, listed.count())))  # a stated number, which adaptive execution keeps


def in_slices(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in slices of about ``most`` bytes, one row at least: the JVM reads a batch into one buffer."""
    step = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for first in range(0, batch.num_rows, step):
        yield batch.slice(first, step)


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id``, ``component`` (the smallest id reachable) for every id in ``edges``.

    Large-star and small-star rounds: every round hangs all neighbours of an id on the smallest
    of them, until the edges are stars already. Each round aggregates before it shuffles, joins
    on an id whose rows may be split, and is stored, so that lineage stays short.
    """
    pair = lambda u, v: [F.col(u).alias("u"), F.col(v).alias("v")]
    now = stored(edges.select(*pair(a, b)).where("u is not null and v is not null").distinct())

    def star(both: DataFrame) -> DataFrame:
        least = both.groupBy("u").agg(F.min("v").alias("least"))
        return both.join(least, "u").withColumn("least", F.least("least", "u"))

    while True:
        both = now.union(now.select(*pair("v", "u"))).where("u <> v")
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        hung = star(down)
        small = hung.select(F.col("v").alias("u"), F.col("least").alias("v")).union(
            hung.select("u", F.col("least").alias("v"))
        )
        new = stored(small.where("u <> v").distinct())
        if new.exceptAll(now).isEmpty() and now.where("u <> v").exceptAll(new).isEmpty():
            break
        now = new
    leaves = new.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = new.select(F.col("v").alias("id"), F.col("v").alias("component"))
    alone = edges.where(f"{a} = {b}").select(F.col(a).alias("id"), F.col(a).alias("component"))
    return leaves.union(roots).union(alone).groupBy("id").agg(F.min("component").alias("component"))
