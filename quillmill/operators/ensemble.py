"""Merging the outputs of several recognition engines line by line.

The array form needs no shuffle: variants of a document are one row. The long form is for
variants that arrive as rows and shuffles once on the document. Ties go to the lower engine
ordinal. Null variants count as blank; a document without a usable variant merges to ''.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.matching import ratio
from ..functions.text import bind, is_blank, strip


def line_score(v: Column) -> Column:
    """The additions keep this order, so that doubles agree wherever it is computed."""
    score = F.length(v) * 0.1
    score = score + F.when(v.rlike(r"[.!?:,]\z"), 10.0).otherwise(0.0)
    score = score + F.length(F.regexp_replace(v, "[^а-яА-Я]", "")) * 0.2
    score = score - F.when(v.rlike(r"^[\p{Nd}²³¹⁰-⁹₀-₉]"), 5.0).otherwise(0.0)
    return score - F.when(v.rlike(r"^\p{Lu} ."), 5.0).otherwise(0.0)


def pick_line(candidates: Column) -> Column:
    """One candidate is taken as it is; of several the stripped one with the best score."""
    usable = F.filter(F.transform(candidates, strip), lambda x: x != "")
    best = F.array_max(F.transform(usable, lambda v, k: F.struct(line_score(v).alias("score"), (-k).alias("first"), v.alias("line"))))
    return F.when(F.size(candidates) == 1, candidates[0]).otherwise(F.coalesce(best["line"], F.lit("")))


def merge_arrays(variants: Column) -> Column:
    """Merges array<string> variants; a single one is returned unchanged."""
    given = F.filter(variants, lambda x: x.isNotNull() & (x != ""))
    lines = F.transform(F.filter(given, lambda x: ~is_blank(x)), lambda x: F.split(x, "\n", -1))
    at = lambda ls, i: F.filter(F.transform(ls, lambda x: F.get(x, i)), lambda x: x.isNotNull())
    every = lambda ls: F.sequence(F.lit(0), F.array_max(F.transform(ls, F.size)) - 1)
    # The variants are split into lines once, not once for each line.
    merged = bind(lines, lambda ls: F.when(F.size(ls) == 0, "").otherwise(F.array_join(F.filter(F.transform(every(ls), lambda i: bind(at(ls, i), pick_line)), lambda x: ~is_blank(x)), "\n")))
    return F.when(F.size(given) == 0, "").when(F.size(given) == 1, given[0]).otherwise(merged)


def explode_lines(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    return df.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def merge_long(variants: DataFrame) -> DataFrame:
    """(doc_id, merged) of ``variants`` (doc_id, engine_ord, text): the long-form twin."""
    given = variants.where("text is not null and text <> ''")
    count = given.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("only"))
    lines = explode_lines(given.where(~is_blank(F.col("text"))), "doc_id", "engine_ord").withColumn("v", strip(F.col("line")))
    filled = F.col("v") != ""
    best = lines.groupBy("doc_id", "line_no").agg(
        F.count(F.lit(1)).alias("candidates"), F.min("line").alias("lone"),
        F.max_by("v", F.when(filled, F.struct(line_score(F.col("v")), -F.col("engine_ord")))).alias("best"),
    )
    winner = best.select("doc_id", "line_no", F.when(F.col("candidates") == 1, F.col("lone")).otherwise(F.coalesce("best", F.lit(""))).alias("line")).where(~is_blank(F.col("line")))
    merged = winner.groupBy("doc_id").agg(F.expr("listagg(line, '\n') within group (order by line_no)").alias("merged"))
    out = variants.select("doc_id").distinct().join(count, "doc_id", "left").join(merged, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("n") == 1, F.col("only")).otherwise(F.coalesce("merged", F.lit(""))).alias("merged"))


@F.pandas_udf(DoubleType())
def _agreement(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    from itertools import combinations

    def one(texts) -> float:
        ratios = [ratio(a, b) for a, b in combinations([t or "" for t in texts], 2)]
        return sum(ratios) / len(ratios) if ratios else 0.5

    for series in batches:
        yield series.map(one)


def agreement(variants: Column) -> Column:
    """Mean pairwise similarity ratio; 0.5 with fewer than two variants. Matching blocks need Python."""
    return _agreement(variants)


def keep_detections(detections: Column, threshold: float = 0.6) -> Column:
    """Joined text of array<struct<text, confidence>> detections that are confident enough."""
    return F.array_join(F.transform(F.filter(detections, lambda d: d["confidence"] >= max(0.3, threshold * 0.5)), lambda d: d["text"]), "\n")
