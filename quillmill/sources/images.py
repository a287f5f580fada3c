"""Images as channel arrays, from Spark's image source or from vectors read as gray tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, width, height, n_channels, data); unreadable files are kept with width -1."""
    return spark.read.format("image").option("dropInvalid", False).load(path).select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("n_channels"), "image.data")


def stream_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, data) of files as they are dropped into a folder, their bytes still encoded."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select(F.col("path").alias("origin"), F.col("content").alias("data"))


def in_rgb(data: Column, channels: Column) -> Column:
    """Binary BGR or BGRA pixels, as the image source gives them, in RGB order; one channel as it is."""
    px = F.hex(data)
    turned = F.regexp_replace(px, "(..)(..)(..)", "$3$2$1")
    return F.when(channels == 1, data).when(channels == 3, F.unhex(turned)).when(channels == 4, F.unhex(F.regexp_replace(px, "(..)(..)(..)(..)", "$3$2$1$4")))


def bytes_of(data: Column) -> Column:
    """Binary as array<int>."""
    return F.when(F.length(data) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(F.decode(data, "ISO-8859-1"), "", -1), F.ascii))


def rgb(df: DataFrame) -> DataFrame:
    """Adds ``r``, ``g``, ``b``: one, three (BGR) or four (BGRA) channels; others get nulls and ``unsupported``."""
    px, n = F.col("_px"), F.col("n_channels")
    known = n.isin(1, 3, 4)
    pick = lambda k: F.when(n == 1, px).when(known, F.filter(px, lambda _, i: i % n == k))
    return df.withColumn("_px", bytes_of(F.col("data"))).withColumns({"r": pick(2), "g": pick(1), "b": pick(0), "unsupported": ~known}).drop("_px")


def tiles(embeddings: DataFrame) -> DataFrame:
    """(img_id, width, height, r, g, b): vectors of 64 numbers in (-1, 1) as 8x8 tiles (synthetic), gray, those of odd ids tinted."""
    px = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))
    return embeddings.select(F.col("vec_id").alias("img_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), px.alias("r"), px.alias("g"), F.when(F.col("vec_id") % 2 == 1, F.transform(px, lambda x: 255 - x)).otherwise(px).alias("b"))


def to_bytes(r: Column, g: Column, b: Column) -> Column:
    """Three channel arrays as binary RGB pixels."""
    two = lambda x: F.lpad(F.hex(x), 2, "0")
    return F.unhex(F.array_join(F.transform(F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b")), lambda p: F.concat(two(p["r"]), two(p["g"]), two(p["b"]))), ""))
