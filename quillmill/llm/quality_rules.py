"""Quality rules with risk-controlled thresholds.

Native DataFrame and SQL code only. Each document gets base counts from one pass over its text
and from them a few signals between 0 and 1, where high is bad. A cutoff on a signal may falsely
reject documents that holders of labels call good. For each stratum (``lang``), signal and cutoff
of a fixed grid, the labelled good documents that the cutoff would reject are counted, and the
exact binomial tail P(Bin(n, risk) <= k) tests the claim that the false rejection rate exceeds
``risk``. Signals aren't learned from labels, so all labelled documents serve as holdout.

Multiple testing: the level is split over all strata and signals (Bonferroni); along one signal
cutoffs are tested from the most lenient to the strictest and the first failure ends the sequence
(fixed-sequence testing), so the whole set of cutoffs holds with probability 1 - ``level``. A
stratum with too few labels proves nothing and gets no cutoff (with 4 strata and 5 signals, under
about 300 good labels at ``risk`` 0.02); ``uncertified`` names these strata and signals, and a
larger ``risk`` certifies smaller strata. A document is kept if it passes
the base rule and no certified cutoff of its stratum rejects it.

Nulls and corner cases: a null text has no words (and fails the base rule); a null lang
counts as the empty one; a document whose labels disagree is not good; repeated rows are documents of
their own, a label counts for each of them; without labels only the base rule decides; an empty
table gives no rows. Other columns are ignored. Windows are compared by 64-bit hashes within one
text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_WORD, WHITE_SPACE, load, stored, strip_ascii

RISK, LEVEL, GRID = 0.02, 0.05, 64
#: Each as (name, numerator, denominator) of base counts.
SIGNALS = (
    ("symbols", "n_symbols", "word_chars"),
    ("repeated", "n_repeat_words", "n_words"),
    ("dup_lines", "n_dup_lines", "n_lines"),
    ("upper", "n_upper", "word_chars"),
    ("long_words", "word_chars", "32 * n_words"),
)
MOST_BROADCAST_STRATA = 10_000
SYMBOLS, UPPER = "#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``stratum`` and the base counts of ``docs`` (doc_id, text, lang), all long."""
    without = lambda chars: F.length(F.translate("text", chars, ""))
    base = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: strip_ascii(x) != "")
    base = base.select(
        "doc_id", "stratum", F.filter(F.split("text", NOT_WORD, -1), lambda w: w != "").alias("words"), F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"),
        without(WHITE_SPACE).alias("word_chars"), (F.length("text") - without(SYMBOLS)).alias("n_symbols"), (F.length("text") - without(UPPER)).alias("n_upper"),
    )
    base = base.withColumn("n_words", F.size("words")).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    base = base.withColumn("grams", F.expr("transform(slice(h, 1, greatest(n_words - 4, 0)), (x, i) -> xxhash64(x, h[i + 1], h[i + 2], h[i + 3], h[i + 4]))"))
    base = base.withColumn("sorted", F.expr("case when size(array_distinct(grams)) < size(grams) then sort_array(transform(grams, (x, i) -> struct(x as g, i as i))) end"))
    # A window is repeated if a neighbour in sorted order has its hash; its place is kept.
    same = "filter(transform(sorted, (s, i) -> case when s.g = get(sorted, i - 1).g or s.g = get(sorted, i + 1).g then s.i end), x -> x is not null)"
    base = base.withColumn("at", F.expr(f"sort_array({same})"))
    # Each repeated window covers five words, less those that the next one covers as well.
    covered = "aggregate(transform(at, (x, i) -> least(5, coalesce(get(at, i + 1) - x, 5))), 0, (a, x) -> a + x)"
    return base.select(
        "doc_id", "stratum", F.col("n_words").cast("long"), F.col("word_chars").cast("long"), F.col("n_symbols").cast("long"), F.col("n_upper").cast("long"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _bin(top: str, bottom: str) -> str:
    """The number of grid cutoffs a signal exceeds: it is over cutoff j / GRID if this is over j."""
    return f"(case when {bottom} > 0 then cast(least({GRID}, ceil({GRID} * cast({top} as double) / ({bottom}))) as int) else 0 end)"


def log_gamma(x: str) -> str:
    """ln Gamma(x) for x >= 1 in SQL: Stirling's series at x + 10, taken back ten steps."""
    y = f"({x} + 10D)"
    back = " * ".join(f"({x} + {i}D)" for i in range(10))
    return f"(({y} - 0.5D) * ln({y}) - {y} + {0.5 * math.log(2 * math.pi)!r}D + 1D / (12D * {y}) - 1D / (360D * pow({y}, 3)) + 1D / (1260D * pow({y}, 5)) - ln({back}))"


def binomial_tail(k: str, n: str, p: float) -> str:
    """P(Bin(n, p) <= k) in SQL, where k <= n p; 1 above, as no test there can succeed."""
    term = f"exp({log_gamma('(n_ + 1D)')} - {log_gamma('(i + 1D)')} - {log_gamma('(n_ - i + 1D)')} + i * ln({p!r}D) + (n_ - i) * ln(1D - {p!r}D))".replace("n_", f"cast({n} as double)")
    return f"(case when {k} > {n} * {p!r}D then 1D else aggregate(sequence(0L, {k}), 0D, (a, i) -> a + {term}) end)"


def cutoffs(good: DataFrame, *, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, cutoffs map<signal, grid place>) certified by the counts of good documents."""
    bins = F.array(*(F.struct(F.lit(name).alias("signal"), F.expr(_bin(top, bottom)).alias("bin")) for name, top, bottom in SIGNALS))
    hist = good.select("stratum", F.explode(bins).alias("s")).groupBy("stratum", "s.signal", "s.bin").agg(F.count(F.lit(1)).alias("n"))
    hist = stored(hist, "rules-histogram")
    n_tests = hist.select("stratum", "signal").distinct().count()
    total = hist.groupBy("stratum", "signal").agg(F.sum("n").alias("n"))
    every = total.select("stratum", "signal", F.lit(GRID).alias("bin"), F.lit(0).cast("long").alias("n"))
    over = hist.where("bin > 0").unionByName(every).select("stratum", "signal", "n", F.explode(F.expr("sequence(0, bin - 1)")).alias("cutoff"))
    tested = over.groupBy("stratum", "signal", "cutoff").agg(F.sum("n").alias("k")).join(total, ["stratum", "signal"])
    passed = tested.where(F.expr(f"{binomial_tail('k', 'n', risk)} <= {level!r}D / {max(1, n_tests)}"))
    # The tail grows with k, and k with strictness: the passing cutoffs are all those down to one.
    chosen = passed.groupBy("stratum", "signal").agg(F.min("cutoff").alias("cutoff"))
    return chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("signal", "cutoff"))).alias("cutoffs"))


def good_only(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``counted`` that all their labels call good."""
    good_ids = labels.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = 1 and high = 1").select("doc_id")
    return counted.join(good_ids, "doc_id", "left_semi")


def uncertified(docs: DataFrame, labels: DataFrame, *, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, n_good, signals) of ``docs``: the signals that no cutoff is certified for."""
    seen = stored(counts(docs), "rules-counts")
    good = good_only(seen, labels)
    n_good = seen.select("stratum").distinct().join(good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good")), "stratum", "left")
    names = F.array(*(F.lit(name) for name, _, _ in SIGNALS))
    missing = F.array_except(names, F.coalesce(F.map_keys("cutoffs"), F.array().cast("array<string>")))
    return n_good.join(cutoffs(good, risk=risk, level=level), "stratum", "left").select("stratum", F.coalesce("n_good", F.lit(0)).alias("n_good"), missing.alias("signals")).where("size(signals) > 0")


def judge(docs: DataFrame, labels: DataFrame, *, risk: float = RISK) -> DataFrame:
    """The counts of ``docs`` with ``base_failed``, ``kept`` and ``rejected_by`` (names of signals)."""
    seen = stored(counts(docs), "rules-counts")
    certified = stored(cutoffs(good_only(seen, labels), risk=risk), "rules-cutoffs")
    # One row a stratum; sent to all executors only while there are few strata.
    if certified.count() <= MOST_BROADCAST_STRATA:
        certified = F.broadcast(certified)
    over = F.array(*(F.when(F.expr(f"{_bin(top, bottom)} > cutoffs['{name}']"), F.lit(name)) for name, top, bottom in SIGNALS))
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    return (
        seen.join(certified, "stratum", "left")
        .withColumn("rejected_by", F.filter(over, lambda x: x.isNotNull()))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.size("rejected_by") == 0))
        .drop("cutoffs")
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    strip = f"translate(text, {white}, '')"
    signals = " union all ".join(f"select r, stratum, '{name}' as signal, {_bin(top, bottom)} as bin from c" for name, top, bottom in SIGNALS)
    term = f"exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({RISK}::double) + (n - i) * ln(1 - {RISK}::double))"
    return rf"""
with t as (select row_number() over () as r, doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text from documents),
w as (select r, list_filter(string_split_regex(text, '{NOT_WORD}'), lambda x: x <> '') as ws from t),
g as (select r, i, array_to_string(ws[i:i + 4], ' ') as g from (select r, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
rep as (select r, i from g qualify count(*) over (partition by r, g) > 1),
cov as (select r, count(distinct i + o) as n from rep, range(0, 5) x(o) group by r),
ls as (select r, list_filter(string_split(text, chr(10)), lambda x: trim(x, {white}) <> '') as l from t),
c as (
  select t.r, doc_id, stratum, len(ws)::bigint as n_words, length({strip})::bigint as word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint as n_symbols, (length(text) - length(translate(text, '{UPPER}', '')))::bigint as n_upper,
    len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words
  from t join w using (r) join ls using (r) left join cov using (r)
), s as ({signals}),
good as (select doc_id from labels group by doc_id having min(quality) = 1 and max(quality) = 1),
h as (select s.stratum, signal, bin from s join c using (r) where doc_id in (select doc_id from good)),
k as (select stratum, signal, j, count(*) as n, count(*) filter (where bin > j) as k from h, range(0, {GRID}) x(j) group by all),
m as (select count(*) as tests from (select distinct stratum, signal from h)),
cut as (
  select stratum, signal, min(j) as cutoff from k, m
  where k <= n * {RISK} and list_sum(list_transform(range(0, k + 1), lambda i: {term})) <= {LEVEL} / tests group by all
), bad as (select distinct r from s join cut using (stratum, signal) where bin > cutoff),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and r not in (select r from bad) as kept from f
"""


OP5_SQL = _sql()
