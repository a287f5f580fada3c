"""The whole dataflow as one lazy plan: variants, strategy, merge, correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.degrade import degrade, degrade_lines
from ..functions.text import correct
from ..operators.ensemble import merge_arrays
from ..operators.routing import strategy


def variants(docs: DataFrame) -> DataFrame:
    """(doc_id, variants): three synthetic engines' outputs of each document; the third is often blank."""
    blank = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit(" \n ")).otherwise(F.col("text"))
    return docs.select("doc_id", F.array(degrade(F.col("doc_id"), F.col("text")), degrade_lines(F.col("text")), blank).alias("variants"))


def features_of(doc_id: Column) -> tuple[Column, Column]:
    """Synthetic contrast and sharpness of a document's image."""
    return F.pmod(doc_id * 37, F.lit(100)) / 100.0, F.pmod(doc_id * 53, F.lit(100)) / 100.0


def recognised(docs: DataFrame, enable_correction: bool = True) -> DataFrame:
    """(doc_id, strategy, confidence, text): 'fast' takes the first engine's output, else all are merged."""
    contrast, sharpness = features_of(F.col("doc_id"))
    chosen = variants(docs).withColumn("s", strategy(contrast, sharpness))
    raw = F.when(F.col("s.strategy") == "fast", F.col("variants")[0]).otherwise(merge_arrays(F.col("variants")))
    out = chosen.select("doc_id", "s.strategy", "s.confidence", raw.alias("raw"))
    return out.select("doc_id", "strategy", "confidence", (correct(F.col("raw")) if enable_correction else F.col("raw")).alias("text"))
