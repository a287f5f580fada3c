"""Line dedup: hash ranges, secondary sort, first occurrences, run-length keep bitmaps.

Native DataFrame code only. Each line of at least ``min_chars`` is reduced to a 128-bit hash of
its key; only (hash, document, position) travels, never text. The hash space is cut into equal
ranges (hashes are uniform, so no sampling pass is needed to find the bounds), each range is
sorted by hash, document and position, and one streaming pass marks all but the first document
of a hash. What comes back per document is a keep bitmap, run-length coded.

Hot lines: a line that a large share of documents repeats would fill one range. A sample of the
documents finds the lines that weigh more than a fraction of a range (at most ``8 * ranges`` of
them; this decides only where rows go). Their first document is then an ordinary map-side
combined ``max``, their rows get their verdict from it by a broadcast of that bounded table, and
they are dealt over all ranges by document.

Nulls and corner cases: a null or empty text is one empty line; a null id counts as one document
that sorts last; rows that repeat an id are one document when documents are counted, and each
row gets its own lines back; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load, lower_ascii, shuffle_partitions, stored, strip_ascii

#: One document of so many is looked at to find hot lines; a hot line is in so many sampled documents at least.
SAMPLE_OF, SAMPLED_AT_LEAST = 64, 32


def line_list(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    key = lower_ascii(strip_ascii(F.col("line")))
    return (
        docs.select("doc", "row", F.posexplode(line_list(F.col("text"))).alias("pos", "line"))
        .select("doc", "row", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def _hot(docs: DataFrame, min_chars: int, min_docs: int, ranges: int) -> DataFrame | None:
    """Hot lines (in ``min_docs`` documents at least) with their first (largest) document, or None if there are none."""
    spark = docs.sparkSession
    sample = _lines(docs.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE_OF)) == 0), min_chars).groupBy("h1", "h2").agg(F.countDistinct("doc").alias("n"), F.count(F.lit(1)).alias("rows"))
    heavy = sample.where(F.col("n") >= max(SAMPLED_AT_LEAST, min_docs)).orderBy(F.desc("rows")).limit(8 * ranges).select("h1", "h2").collect()
    if not heavy:
        return None
    keys = spark.createDataFrame([tuple(r) for r in heavy], "h1 long, h2 long")
    first = _lines(docs, min_chars).join(F.broadcast(keys), ["h1", "h2"]).groupBy("h1", "h2").agg(F.max("doc").alias("first_doc"))
    return stored(first, "hot-lines")


def dropped_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, ranges: int | None = None) -> DataFrame:
    """(doc, row, pos) of each line to drop; ``row`` is the hash that ties it to its text."""
    spark = docs.sparkSession
    ranges = ranges or shuffle_partitions(spark)
    docs = _identified(docs, id_col, text_col)
    lines = _lines(docs, min_chars)
    hot = _hot(docs, min_chars, int(min_docs), ranges)
    of_hash = F.shiftright(F.shiftrightunsigned("h1", 33) * ranges, 31).cast("int")
    if hot is None:
        lines = lines.withColumn("hot", F.lit(False)).withColumn("range", of_hash)
    else:
        lines = (
            lines.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["h1", "h2"], "left")
            .where("hot is null or doc is null or doc < first_doc")
            .withColumn("hot", F.coalesce("hot", F.lit(False)))
            .withColumn("range", F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(ranges)).cast("int")).otherwise(of_hash))
        )
    group = Window.partitionBy("range", "h1", "h2")
    # A range's rows stream by hash, then document, then position: the first row of a hash is its first occurrence.
    ordered = group.orderBy(F.desc_nulls_last("doc"), "pos")
    another = F.when(F.row_number().over(ordered) == 1, 0).when(F.lag("doc").over(ordered).eqNullSafe(F.col("doc")), 0).otherwise(1)
    return (
        lines.repartitionById(ranges, "range")
        .withColumn("another", another)
        .withColumn("before", F.sum("another").over(ordered))
        .withColumn("n_docs", F.sum("another").over(group) + 1)
        .where(f"hot or (before > 0 and n_docs >= {int(min_docs)})")
        .select("doc", "row", "pos")
    )


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("doc", "text"))


def keep_bitmaps(docs: DataFrame, **how) -> DataFrame:
    """(doc, row, keep, n_dropped) of each document that loses lines.

    ``keep`` is the keep bitmap's runs of ones, as (start, length) in ascending order; the last
    run is open (length null) since a document's end needs no storing. A bitmap is as long as the
    document has lines, so one document's positions are what a group gathers.
    """
    gathered = dropped_lines(docs, **how).groupBy("doc", "row").agg(F.sort_array(F.collect_set("pos")).alias("drops"))
    runs = F.transform(F.col("drops"), lambda x, i: F.struct(F.when(i == 0, 0).otherwise(F.get("drops", i - 1) + 1).alias("start"), (x - F.when(i == 0, 0).otherwise(F.get("drops", i - 1) + 1)).alias("length")))
    last = F.struct((F.element_at("drops", -1) + 1).alias("start"), F.lit(None).cast("int").alias("length"))
    return gathered.select("doc", "row", F.concat(F.filter(runs, lambda r: r["length"] > 0), F.array(last)).alias("keep"), F.size("drops").alias("n_dropped"))


def apply_keep(lines: Column, keep: Column) -> Column:
    """The lines under the runs of a keep bitmap; all of them where it is null."""
    cut = F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, F.greatest(F.lit(0), F.coalesce(r["length"], F.size(lines) - r["start"]))))
    return F.when(keep.isNull(), lines).otherwise(F.flatten(cut))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with its columns, the text without dropped lines, and ``_n_lines``, ``_n_dropped``."""
    packed = docs.select(F.struct("*").alias("_all"), F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).withColumn("_row", F.xxhash64("_doc", "_text"))
    maps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, **how)
    joined = packed.join(maps, (F.col("_row") == F.col("row")) & F.col("_doc").eqNullSafe(F.col("doc")), "left")
    lines = joined.withColumn("_lines", line_list(F.col("_text")))
    text = F.when(F.col("keep").isNull(), F.col("_text")).otherwise(F.array_join(apply_keep(F.col("_lines"), F.col("keep")), "\n"))
    columns = [text.alias(c) if c == text_col else F.col(f"_all.`{c}`").alias(c) for c in docs.columns]
    return lines.select(*columns, F.size("_lines").cast("long").alias("_n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("_n_dropped"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = r"""
with lines as (
  select doc_id, r, generate_subscripts(ls, 1) as pos, unnest(ls) as line
  from (select doc_id, row_number() over () as r, string_split(coalesce(text, ''), chr(10)) as ls from documents)
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
), repeated as (
  select k, max(doc_id) as first_doc from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3
), judged as (
  select keyed.*, coalesce(doc_id < first_doc, false) as dropped from keyed left join repeated using (k)
)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id, r
"""
