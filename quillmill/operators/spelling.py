"""Dictionary spelling as an equi-join on delete neighbourhoods.

Distinct word cores are looked up once and joined back; those in the dictionary need no more. A core and a term within one edit
(insertion, deletion, substitution, swap of neighbours) share a key among themselves and their
single-character deletions, within two edits among those with up to two deletions; candidates are
verified exactly. One edit needs built-in functions only; for two, the restricted edit distance
with swaps runs in an Arrow UDF on the candidates. Ties: smaller distance, higher
count, smaller term. Null texts stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.text import final_cleanup, fix_obvious

_SPLIT = r"(?U)[\s\x1c-\x1f]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, _SPLIT, -1), lambda x: x != "")


def affixes(word: Column) -> Column:
    """struct<prefix, core, suffix>: what isn't a letter or digit at the ends, and the rest."""
    pattern = r"(?s)^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$"
    return F.struct(*(F.regexp_extract(word, pattern, k).alias(n) for k, n in enumerate(("prefix", "core", "suffix"), 1)))


def eligible(word: Column) -> Column:
    """Words that may be corrected: three characters or more, a letter among them."""
    return (F.length(word) >= 3) & word.rlike(r"\p{L}")


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, count) of the lower-cased cores of ``docs``: a stand-in for a shipped word list."""
    words = docs.select(F.explode(tokens(F.col(text))).alias("w")).select(F.lower(affixes(F.col("w"))["core"]).alias("term"))
    return words.where(F.col("term").rlike(r"^\p{L}+$")).groupBy("term").agg(F.count(F.lit(1)).alias("count"))


def keys(term: Column) -> Column:
    """A term and its single-character deletions."""
    deleted = F.transform(F.sequence(F.lit(1), F.greatest(F.length(term), F.lit(1))), lambda i: F.concat(F.substr(term, F.lit(1), i - 1), F.substr(term, i + 1)))
    return F.array_distinct(F.concat(F.array(term), deleted))


def within_one(a: Column, b: Column) -> Column:
    """Distance 0 or 1 with swaps of neighbours as one edit; null beyond."""
    swap = lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2))
    swapped = F.when((F.length(a) == F.length(b)) & (F.length(a) > 1), F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: swap(i) == b)).otherwise(False)
    return F.when(a == b, 0).when((F.levenshtein(a, b) == 1) | swapped, 1)


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, none of them within another."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


@F.pandas_udf(IntegerType())
def _edits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([edits(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def suggest(cores: DataFrame, words: DataFrame, max_distance: int = 1) -> DataFrame:
    """(core, term, distance, count): the best term for each distinct lower-cased ``core`` that has one."""
    distinct = cores.select("core").distinct()
    # A term of the dictionary is its own best suggestion; only other cores look at their neighbours.
    exact = distinct.join(words, F.col("core") == F.col("term")).select("core", "term", F.lit(0).alias("distance"), "count")
    unknown = distinct.join(words.select("term"), F.col("core") == F.col("term"), "left_anti")
    spread = keys if max_distance == 1 else lambda c: F.array_distinct(F.flatten(F.transform(keys(c), keys)))
    left = unknown.select("core", F.explode(spread(F.col("core"))).alias("key"))
    right = words.select("term", "count", F.explode(spread(F.col("term"))).alias("key"))
    pairs = left.join(right, "key")
    if max_distance == 1:
        found = pairs.select("core", "term", "count", within_one(F.col("core"), F.col("term")).alias("distance")).where("distance is not null")
    else:
        found = pairs.select("core", "term", "count").distinct().withColumn("distance", _edits("core", "term")).where(F.col("distance") <= max_distance)
    best = found.groupBy("core").agg(F.min(F.struct("distance", (-F.col("count")).alias("less"), "term")).alias("b"))
    return exact.unionByName(best.select("core", F.col("b.term").alias("term"), F.col("b.distance").alias("distance"), (-F.col("b.less")).alias("count")))


def restore_case(original: Column, term: Column) -> Column:
    upper = (F.upper(original) == original) & (F.lower(original) != original)
    capital = original.rlike(r"^\p{Lu}")
    return F.when(upper, F.upper(term)).when(capital, F.concat(F.upper(F.substr(term, F.lit(1), F.lit(1))), F.lower(F.substr(term, F.lit(2))))).otherwise(term)


def correct_spelling(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text: str = "text", preserve_lines: bool = False, aggressive: bool = False) -> DataFrame:
    """(id, line_no, text): words replaced by accepted suggestions and joined by single spaces.

    As whole texts are one run of words, line breaks go; ``preserve_lines`` works line by line.
    """
    lines = docs.select(id_col, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")) if preserve_lines else docs.select(id_col, F.lit(0).alias("line_no"), F.col(text).alias("line"))
    placed = lines.select(id_col, "line_no", F.posexplode_outer(tokens(F.col("line"))).alias("at", "word"))
    parts = placed.withColumn("a", affixes(F.col("word"))).withColumn("core", F.when(eligible(F.col("word")) & (F.col("a.core") != ""), F.lower("a.core")))
    best = suggest(parts.where("core is not null"), words, 2 if aggressive else 1).where("distance > 0 and count > 10")
    fixed = F.when(F.col("term").isNull(), F.col("word")).otherwise(F.concat("a.prefix", restore_case(F.col("a.core"), F.col("term")), "a.suffix"))
    # Words without a core match nothing; a salt keeps them from meeting in one task.
    salt = F.when(F.col("core").isNull(), F.pmod(F.xxhash64(id_col, "line_no", "at"), F.lit(1 << 16))).otherwise(0)
    out = parts.withColumn("salt", salt).join(best.withColumn("salt", F.lit(0).cast("long")), ["core", "salt"], "left").select(id_col, "line_no", "at", fixed.alias("word"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    return out.groupBy(id_col, "line_no").agg(joined.alias(text))


def correct_with_dictionary(docs: DataFrame, words: DataFrame | None, language: str = "eng", aggressive: bool = False) -> DataFrame:
    """(doc_id, text) after the fixed rules, the dictionary (English only, if given), and the final clean-up."""
    ready = docs.select("doc_id", fix_obvious(F.col("text")).alias("text"))
    if words is None or language not in ("eng", "en"):
        return ready.select("doc_id", final_cleanup(F.col("text")).alias("text"))
    return correct_spelling(ready, words, aggressive=aggressive).select("doc_id", final_cleanup(F.col("text")).alias("text"))
