"""Shared helpers: table loading, the cluster's shared folder, and ASCII text rules."""

from __future__ import annotations

import re
import string
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word and line rules: space, and tab to carriage return.
WHITE_SPACE = " \t\n\x0b\x0c\r"
NOT_WORD = r"[\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession, most_rows: int = 1000) -> None:
    """Texts may be long: an Arrow batch of Spark's default 10,000 rows of them can fill a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > most_rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(most_rows))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where no such folder is named, one is only made up for a local master, whose executors are
    the driver itself; on a cluster that is an error.
    """
    bounded_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quillmill-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/quillmill/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage durably."""
    spark = df.sparkSession
    path = path or shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def strip_ascii(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def word_list(c: Column) -> Column:
    """The words of a text: runs of anything but ASCII white space."""
    return F.filter(F.split(c, NOT_WORD, -1), lambda w: w != "")


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lowered, as UTF-8 bytes.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is exactly the rule.
    """
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of Arrow batches, a bounded slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


class Batcher:
    """Collects output rows and hands them over as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, most_rows: int = 4096, most_bytes: int = 8 << 20):
        self.schema, self.most_rows, self.most_bytes = schema, most_rows, most_bytes
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, row: tuple, size: int = 64) -> bool:
        """True if the batch is full."""
        self.rows.append(row)
        self.bytes += size
        return len(self.rows) >= self.most_rows or self.bytes >= self.most_bytes

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [()] * len(self.schema)
        out = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.bytes = [], 0
        return out
