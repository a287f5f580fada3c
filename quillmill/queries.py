"""One query for each operator of the inventory, with the SQL that DuckDB runs beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.degrade import PREFIXES, REPLACEMENTS, degrade
from .operators import chords, ensemble, imaging, routing, spelling
from .plans import recognise
from .sources import images

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Dealt anew, for work that is large for the bytes read: a split may hold most rows of a table."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- SQL fragments -------------------------------------------------------------------------

_Q = lambda s: "'" + s.replace("'", "''") + "'"


def _degraded(text: str = "text") -> str:
    for a, b in REPLACEMENTS:
        text = f"replace({text}, {_Q(a)}, {_Q(b)})"
    prefixes = "[" + ", ".join(map(_Q, PREFIXES)) + "]"
    return f"(case when doc_id % 7 = 0 then {prefixes}[(doc_id // 7) % 6 + 1] else '' end || {text})"


def _sub(text: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({text}, {_Q(pattern)}, {_Q(to)}, '{flags}')"


_LET = "a-zA-Zа-яА-ЯёЁ"
_strip = lambda x: _sub(x, r"^\s+|\s+$", "")
_clean = lambda x: f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: {_strip('l')}), lambda l: l <> ''), chr(10))"
_collapse = lambda x: _sub(x, " {2,}", " ")
_tighten = lambda x: _sub(x, r"\s+([.,!?;:)])", r"\1")
_space = lambda x: _sub(x, f"([.,!?;:])([{_LET}])", r"\1 \2")


def _phrases(x: str) -> str:
    for w in ("am", "have", "will"):
        x = _sub(x, rf"\b1\s+{w}\b", f"I {w}", "gi")
    return x


def _contractions(x: str) -> str:
    for w in ("'m", "'ve", "'ll"):
        x = _sub(x, rf"\b1{w}\b", f"I{w}")
    return x


def _digits(x: str) -> str:
    for a, b in (("0f", "of"), ("0r", "or"), ("1n", "in"), ("t0", "to")):
        x = _sub(x, rf"\b{a}\b", b)
    return x


_obvious = lambda x: _digits(_contractions(_phrases(_space(_tighten(_collapse(x))))))
_final = lambda x: _clean(_collapse(x))


def _rule(name: str, column: Callable[[Column], Column], sql: Callable[[str], str]) -> None:
    """A query that applies a text rule to every damaged document."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", degrade(F.col("doc_id"), F.col("text")).alias("text"))
        return docs.select("doc_id", (column(F.col("text")) != F.col("text")).alias("changed"), column(F.col("text")).alias("result"))

    run.__name__ = name
    query(f"with d as (select doc_id, {_degraded()} as text from documents), r as (select doc_id, text, {sql('text')} as result from d) select doc_id, result <> text as changed, result from r")(run)


_rule("collapse_spaces", lambda c: T.rewrite(c, T.COLLAPSE), _collapse)
_rule("tighten_punctuation", lambda c: T.rewrite(c, T.TIGHTEN), _tighten)
_rule("space_after_punctuation", lambda c: T.rewrite(c, T.SPACE_AFTER), _space)
for _k, _w in enumerate(("am", "have", "will")):
    _rule(f"pronoun_{_w}", lambda c, k=_k: T.rewrite(c, T.PHRASES[k]), lambda x, w=_w: _sub(x, rf"\b1\s+{w}\b", f"I {w}", "gi"))
for _k, _w in enumerate(("m", "ve", "ll")):
    _rule(f"pronoun_contraction_{_w}", lambda c, k=_k: T.rewrite(c, T.CONTRACTIONS[k]), lambda x, w=_w: _sub(x, rf"\b1'{w}\b", f"I'{w}"))
for _k, (_a, _b) in enumerate((("0f", "of"), ("0r", "or"), ("1n", "in"), ("t0", "to"))):
    _rule(f"digit_word_{_b}", lambda c, k=_k: T.rewrite(c, T.DIGIT_WORDS[k]), lambda x, a=_a, b=_b: _sub(x, rf"\b{a}\b", b))
_rule("pronoun_phrases", lambda c: T.rewrite(c, *T.PHRASES), _phrases)
_rule("pronoun_contractions", lambda c: T.rewrite(c, *T.CONTRACTIONS), _contractions)
_rule("digit_words", lambda c: T.rewrite(c, *T.DIGIT_WORDS), _digits)
_rule("fix_obvious", T.fix_obvious, _obvious)
_rule("final_cleanup", T.final_cleanup, _final)
_rule("correct_text", T.correct, lambda x: _final(_obvious(x)))
_rule("basic_post_process", T.basic_post_process, lambda x: _clean(_sub(_sub(_collapse(x), r"\s+([.,!?;:])", r"\1"), f"([.,!?:;])([{_LET}])", r"\1 \2")))
_rule("strip_result", lambda c: T.strip(F.concat(F.lit(" \n\t"), c, F.lit("\n \t"))), lambda x: _strip(f"' ' || chr(10) || chr(9) || {x} || chr(10) || ' ' || chr(9)"))


@query("select doc_id, length(text) as n_chars, left(text, 100) as preview, left(text, 50) as short_preview from documents")
def text_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"), F.substring("text", 1, 100).alias("preview"), F.substring("text", 1, 50).alias("short_preview"))


_LANG_SQL = "{" + ", ".join(f"'{k}': '{v}'" for k, v in T.LANGUAGES.items()) + "}"


@query(f"""
with d as (select doc_id, (case lang when 'en' then 'eng' when 'fr' then 'fra' when 'de' then 'deu' else 'spa' end) || '+ rus +' || source as codes from documents),
p as (select doc_id, generate_subscripts(l, 1) as i, trim(unnest(l)) as c from (select doc_id, string_split(codes, '+') as l from d)),
m as (select unnest(map_entries(map {_LANG_SQL}), recursive := true))
select doc_id, string_agg(coalesce(value, c), ',' order by i) as engine_codes from p left join m on key = c group by doc_id""")
def language_codes(spark, sf_dir):
    three = F.when(F.col("lang") == "en", "eng").when(F.col("lang") == "fr", "fra").when(F.col("lang") == "de", "deu").otherwise("spa")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(three, F.lit("+ rus +"), F.col("source")).alias("codes"))
    return docs.select("doc_id", F.array_join(T.language_codes(F.col("codes")), ",").alias("engine_codes"))


_HOTKEYS = {"click": "<ctrl>+<alt>+t", "view": "<super> + s", "purchase": "Ctrl+Shift+F12", "signup": "<shift>+<Meta>+a"}
_HOTKEY_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in _HOTKEYS.items()) + " else 'x' end"


@query(f"""
with e as (select event_id, list_transform(string_split(replace(lower({_HOTKEY_SQL}), ' ', ''), '+'), lambda p: trim(p, '<>')) as parts from events)
select event_id, list_has_any(parts, ['ctrl', 'control']) as need_ctrl, list_contains(parts, 'shift') as need_shift, list_contains(parts, 'alt') as need_alt,
  list_filter(parts, lambda p: p not in ('ctrl', 'control', 'shift', 'alt', 'super', 'win', 'meta'))[-1] as key from e""")
def hotkey_parse(spark, sf_dir):
    chord = F.lit(None)
    chord = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in _HOTKEYS.items()), F.lit("x"))
    return table(spark, sf_dir, "events").select("event_id", T.parse_hotkey(chord).alias("h")).select("event_id", "h.*")


_LINES = "select doc_id, generate_subscripts(l, 1) - 1 as line_no, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents)"


@query(f"select doc_id, line_no::int as line_no, line from ({_LINES})")
def explode_lines(spark, sf_dir):
    return ensemble.explode_lines(table(spark, sf_dir, "documents"), "doc_id")


def _score_sql(v: str) -> str:
    return (
        f"(((length({v}) * 0.1::double + case when regexp_matches({v}, '[.!?:,]$') then 10::double else 0::double end)"
        f" + length({_sub(v, '[^а-яА-Я]', '')}) * 0.2::double - case when regexp_matches({v}, '^[0-9]') then 5::double else 0::double end)"
        f" - case when regexp_matches({v}, '^\\p{{Lu}} .') then 5::double else 0::double end)"
    )


@query(f"with l as (select doc_id, line_no, {_strip('line')} as v from ({_LINES})) select doc_id, line_no::int as line_no, {_score_sql('v')} as score from l")
def line_scores(spark, sf_dir):
    lines = ensemble.explode_lines(table(spark, sf_dir, "documents"), "doc_id").withColumn("v", T.strip(F.col("line")))
    return lines.select("doc_id", "line_no", ensemble.line_score(F.col("v")).alias("score"))


_VARIANTS = f"""
d as (select doc_id, text, {_degraded()} as a,
  array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: case when (i - 1) % 5 = 0 then '1 ' || x when (i - 1) % 2 = 0 then left(x, greatest(length(x) - 1, 0)) else x end), chr(10)) as b,
  case when doc_id % 3 = 0 then ' ' || chr(10) || ' ' else text end as c from documents),
v as (select doc_id, 0 as e, a as t from d union all select doc_id, 1, b from d union all select doc_id, 2, c from d),
g as (select * from v where t is not null and t <> ''),
ln as (select doc_id, e, generate_subscripts(l, 1) - 1 as line_no, unnest(l) as line from (select doc_id, e, string_split(t, chr(10)) as l from g where {_strip('t')} <> '')),
sc as (select *, {_strip('line')} as s from ln),
rk as (select *, count(*) over (partition by doc_id, line_no) as n, row_number() over (partition by doc_id, line_no order by (s <> '') desc, {_score_sql('s')} desc, e) as r from sc),
wn as (select doc_id, line_no, case when n = 1 then line else s end as w from rk where r = 1),
mg as (select doc_id, string_agg(w, chr(10) order by line_no) filter (where {_strip('w')} <> '') as m from wn group by doc_id),
ct as (select doc_id, count(*) as n, min(t) as only_one from g group by doc_id),
merged as (select d.doc_id, case when ct.n is null then '' when ct.n = 1 then only_one else coalesce(m, '') end as merged from d left join ct using (doc_id) left join mg using (doc_id))
"""


@query(f"with {_VARIANTS} select doc_id, line_no::int as line_no, w as line from wn")
def best_line(spark, sf_dir):
    found = recognise.variants(table(spark, sf_dir, "documents")).select("doc_id", F.filter("variants", lambda v: ~T.is_blank(v)).alias("v"))
    lines = found.withColumn("l", F.transform("v", lambda v: F.split(v, "\n", -1))).where("size(l) > 0")
    at = F.expr("transform(sequence(0, array_max(transform(l, x -> size(x))) - 1), i -> filter(transform(l, x -> get(x, i)), y -> y is not null))")
    return lines.select("doc_id", F.posexplode(at).alias("line_no", "candidates")).select("doc_id", "line_no", ensemble.pick_line(F.col("candidates")).alias("line"))


@query(f"with {_VARIANTS} select doc_id, merged from merged")
def ensemble_merge(spark, sf_dir):
    return recognise.variants(table(spark, sf_dir, "documents")).select("doc_id", ensemble.merge_arrays(F.col("variants")).alias("merged"))


@query(f"with {_VARIANTS} select doc_id, merged from merged")
def ensemble_merge_long(spark, sf_dir):
    long = recognise.variants(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode("variants").alias("engine_ord", "text"))
    return ensemble.merge_long(long)


@query(f"with {_VARIANTS} select doc_id, (select count(*) from g where g.doc_id = d.doc_id) as n_usable from d")
def collect_variants(spark, sf_dir):
    return recognise.variants(table(spark, sf_dir, "documents")).select("doc_id", F.size(F.filter("variants", lambda v: v.isNotNull() & (v != ""))).cast("long").alias("n_usable"))


@query()
def variant_agreement(spark, sf_dir):
    return recognise.variants(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", ensemble.agreement(F.col("variants")).alias("agreement"))


@query(f"""
with c as (select doc_id, line_no, line, ((doc_id * 31 + line_no * 17) % 100) / 100.0::double as confidence from ({_LINES}))
select doc_id, coalesce(string_agg(line, chr(10) order by line_no) filter (where confidence >= 0.3::double), '') as text from c group by doc_id""")
def detection_filter(spark, sf_dir):
    confidence = lambda i: F.pmod(F.col("doc_id") * 31 + i * 17, F.lit(100)) / 100.0
    found = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("text"), confidence(i).alias("confidence")))
    return table(spark, sf_dir, "documents").select("doc_id", ensemble.keep_detections(found).alias("text"))


_TILES = """
px as (select vec_id as img_id, list_transform(embedding, lambda x: floor((x::double + 1) * 127.5)::int) as p, vec_id % 2 = 1 as tinted from embeddings),
gr as (select img_id, p, case when tinted then list_transform(p, lambda x: 255 - x) else p end as z,
  list_transform(p, lambda x: (x * 886 + (case when tinted then 255 - x else x end) * 114 + 500) // 1000) as g from px),
st as (select img_id, list_sum(p)::double as s, list_sum(list_transform(p, lambda x: x * x))::double as q, list_sum(z)::double as sz,
  list_sum(list_transform(range(1, 57), lambda i: ((g[i + 8] - g[i]) % 256 + 256) % 256))::double as down,
  list_sum(list_transform(list_filter(range(1, 64), lambda i: i % 8 <> 0), lambda i: ((g[i + 1] - g[i]) % 256 + 256) % 256))::double as across from gr),
ft as (select img_id, (2 * s + sz) / 3 / 64 / 255 as brightness, least(sqrt(greatest((q - s * s / 64) / 64, 0)) / 60, 1::double) as contrast,
  least((down / 56 + across / 56) / 30, 1::double) as sharpness, (case when abs(s - sz) / 64 * sqrt(2) / 3 > 10 then 1 else 0 end)::int as has_color, 0.2::double as size_ratio from st)
"""
_ROUND = "round({0}, 9) as {0}"


def _features(spark, sf_dir) -> DataFrame:
    tiles = images.tiles(table(spark, sf_dir, "embeddings"))
    return tiles.select("img_id", imaging.features(F.col("r"), F.col("g"), F.col("b"), F.col("width"), F.col("height")).alias("f")).select("img_id", "f.*")


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles that two engines sum in different orders agree to nine places."""
    return df.select(*(F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


@query(f"with {_TILES} select img_id, {_ROUND.format('brightness')}, {_ROUND.format('contrast')} from ft")
def image_brightness_contrast(spark, sf_dir):
    return _rounded(_features(spark, sf_dir).select("img_id", "brightness", "contrast"))


@query(f"with {_TILES} select img_id, {_ROUND.format('sharpness')} from ft")
def image_sharpness_wrapped(spark, sf_dir):
    return _rounded(_features(spark, sf_dir).select("img_id", "sharpness"))


@query(f"with {_TILES} select img_id, {', '.join(_ROUND.format(c) for c in ('brightness', 'contrast', 'sharpness', 'size_ratio'))}, has_color from ft")
def image_features(spark, sf_dir):
    return _rounded(_features(spark, sf_dir))


@query(f"with {_TILES} select img_id, list_sum(g)::bigint as gray_sum from gr")
def image_gray(spark, sf_dir):
    tiles = images.tiles(table(spark, sf_dir, "embeddings"))
    return tiles.select("img_id", imaging.total(imaging.gray(F.col("r"), F.col("g"), F.col("b"))).alias("gray_sum"))


_SIZES = "(select doc_id, (n_chars % 1500 + 1)::int as w, (n_chars % 400 + 1)::int as h from documents)"


def _sizes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 1500 + 1).cast("int").alias("w"), (F.col("n_chars") % 400 + 1).cast("int").alias("h"))


@query(f"select doc_id, (case when w::double / h > 4 and h < 100 then 7 when w < 300 or h < 100 then 11 else 6 end)::int as psm, round(least(w::double / h, 5) / 5, 9) as size_ratio from {_SIZES}")
def psm_mode(spark, sf_dir):
    return _rounded(_sizes(spark, sf_dir).select("doc_id", imaging.page_mode(F.col("w"), F.col("h")).alias("psm"), imaging.size_ratio(F.col("w"), F.col("h")).alias("size_ratio")))


@query(f"with {_TILES} select img_id, brightness * 255 < 100 as inverted from ft")
def invert_flag(spark, sf_dir):
    return _features(spark, sf_dir).select("img_id", imaging.inverted(F.col("brightness")).alias("inverted"))


_FACTOR = "case when h < 100 or w < 300 then greatest(2::double, 100::double / h, 300::double / w) else 1::double end"


@query(f"with f as (select doc_id, w, h, {_FACTOR} as factor from {_SIZES}) select doc_id, factor, trunc(w * factor)::int as width, trunc(h * factor)::int as height from f")
def upscale_plan(spark, sf_dir):
    return _sizes(spark, sf_dir).select("doc_id", imaging.upscale(F.col("w"), F.col("h")).alias("u")).select("doc_id", "u.*")


def _pixels(spark, sf_dir, dealt=lambda df: df) -> DataFrame:
    """(img_id, width, height, n_channels, data): the tiles as bytes."""
    tiles = images.tiles(dealt(table(spark, sf_dir, "embeddings")))
    return tiles.select("img_id", "width", "height", F.lit(3).alias("n_channels"), images.to_bytes(F.col("r"), F.col("g"), F.col("b")).alias("data"))


def _planned(spark, sf_dir) -> DataFrame:
    shown = _pixels(spark, sf_dir, spread).withColumn("f", imaging.profiled("data", "width", "height", "n_channels", F.lit(True)))
    return shown.withColumn("plan", imaging.enhance_plan(F.col("f.brightness"), F.col("f.contrast"), F.col("width"), F.col("height")))


@query()
def enhance_plan(spark, sf_dir):
    """By the features of the image once it is scaled up, which SQL can't do; tests compare with plain numpy."""
    return _planned(spark, sf_dir).select("img_id", F.array_join(F.transform("plan", lambda s: F.concat(s["op"], F.lit(":"), s["factor"].cast("string"))), ",").alias("plan"))


@query()
def enhanced_pixels(spark, sf_dir):
    """Pixel kernels need numpy; tests check them by hand-made images and compare all tiles."""
    out = _pixels(spark, sf_dir, spread).select("img_id", imaging.made_ready("data", "width", "height", "n_channels").alias("e"))
    return out.select("img_id", "e.width", "e.height", F.sha2("e.data", 256).alias("pixels_sha256"))


@query(f"with {_TILES} select img_id, {', '.join(_ROUND.format(c) for c in ('brightness', 'contrast', 'sharpness', 'size_ratio'))}, has_color from ft")
def image_profiles(spark, sf_dir):
    """The features from bytes in one Arrow pass, as for image files."""
    shown = _pixels(spark, sf_dir).select("img_id", imaging.profiled("data", "width", "height", "n_channels", F.lit(False)).alias("f"))
    return _rounded(shown.select("img_id", "f.*"))


@query(f"with {_TILES} select img_id, round(contrast * 0.6 + sharpness * 0.4, 9) as quality from ft")
def quality_score(spark, sf_dir):
    return _rounded(_features(spark, sf_dir).select("img_id", routing.quality(F.col("contrast"), F.col("sharpness")).alias("quality")))


_CS = "fs as (select doc_id, (doc_id * 37 % 100) / 100.0::double as c, (doc_id * 53 % 100) / 100.0::double as s from documents)"
_RULE_S = "case when c > 0.5 and s > 0.4 then 'fast' when c < 0.2 or s < 0.2 then 'ensemble' end"
_RULE_C = "case when c > 0.5 and s > 0.4 then least(c * 0.6 + s * 0.4, 0.95::double) when c < 0.2 or s < 0.2 then 0.9::double end"
_HEUR_S = "case when (c + s) / 2 > 0.5 then 'fast' else 'ensemble' end"
_HEUR_C = "case when (c + s) / 2 > 0.5 then (c + s) / 2 else 1 - (c + s) / 2 end"


def _cs(spark, sf_dir) -> DataFrame:
    c, s = recognise.features_of(F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("c"), s.alias("s"))


@query(f"with {_CS} select doc_id, {_RULE_S} as strategy, round({_RULE_C}, 9) as confidence from fs")
def strategy_rules(spark, sf_dir):
    return _rounded(_cs(spark, sf_dir).select("doc_id", routing.rules(F.col("c"), F.col("s")).alias("r")).select("doc_id", "r.strategy", "r.confidence"))


@query(f"with {_CS} select doc_id, {_HEUR_S} as strategy, round({_HEUR_C}, 9) as confidence from fs")
def strategy_heuristic(spark, sf_dir):
    return _rounded(_cs(spark, sf_dir).select("doc_id", routing.heuristic(F.col("c"), F.col("s")).alias("r")).select("doc_id", "r.strategy", "r.confidence"))


@query(f"with {_CS} select doc_id, case when doc_id % 3 <> 0 then 'fast' when doc_id % 2 = 0 then coalesce({_RULE_S}, {_HEUR_S}) else 'ensemble' end as runs from fs")
def engine_dispatch(spark, sf_dir):
    engine = F.when(F.col("doc_id") % 3 == 0, "ensemble").otherwise("tesseract")
    return _cs(spark, sf_dir).select("doc_id", routing.dispatch(engine, F.col("doc_id") % 2 == 0, routing.strategy(F.col("c"), F.col("s"))["strategy"]).alias("runs"))


_HAVE = "(select doc_id, doc_id % 2 = 0 as t, doc_id % 5 < 3 as e, ['easyocr', 'tesseract', 'ensemble'][doc_id % 3 + 1] as engine from documents)"


def _have(spark, sf_dir) -> DataFrame:
    engine = F.element_at(F.array(*map(F.lit, ("easyocr", "tesseract", "ensemble"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2 == 0).alias("t"), (F.col("doc_id") % 5 < 3).alias("e"), engine.alias("engine"))


@query(f"select doc_id, case when engine = 'easyocr' then coalesce(case when e then 'easyocr' end, case when t then 'tesseract' end) else coalesce(case when t then 'tesseract' end, case when e then 'easyocr' end) end as backend from {_HAVE}")
def backend_fallback(spark, sf_dir):
    return _have(spark, sf_dir).select("doc_id", routing.backend(F.col("engine"), F.col("t"), F.col("e")).alias("backend"))


@query(f"select doc_id, concat_ws(',', case when t then 'tesseract' end, case when e then 'easyocr' end) as backends from {_HAVE}")
def list_backends(spark, sf_dir):
    return _have(spark, sf_dir).select("doc_id", F.array_join(routing.available(F.col("t"), F.col("e")), ",").alias("backends"))


@query()
def training_rows(spark, sf_dir):
    return routing.training_rows(spark)


@query()
def model_strategy(spark, sf_dir):
    """A seeded tree ensemble fitted to synthetic rows; tests check clear-cut images."""
    return _rounded(routing.with_strategy(_features(spark, sf_dir), routing.train(spark)).select("img_id", "strategy", "confidence"))


_AFFIX = r"^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$"
_TOKENS = "tk as (select doc_id, generate_subscripts(l, 1) - 1 as place, unnest(l) as w from (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as l from src))"
_PART = lambda k: f"regexp_extract(w, '{_AFFIX}', {k}, 's')"
_DICT = f"di as (select term, count(*) as n from (select lower({_PART(2)}) as term from (select unnest(string_split_regex(text, '\\s+')) as w from documents where lang = 'en')) where regexp_full_match(term, '\\p{{L}}+') group by term)"


def _dictionary(spark, sf_dir) -> DataFrame:
    """All terms, rare ones too: whether a suggestion is frequent enough is asked only after the choice."""
    return spelling.dictionary(table(spark, sf_dir, "documents").where("lang = 'en'"))


@query(f"with {_DICT} select term, n as count from di")
def spell_dictionary(spark, sf_dir):
    return _dictionary(spark, sf_dir)


@query(f"with src as (select doc_id, text from documents), {_TOKENS} select distinct w as word, {_PART(1)} as prefix, {_PART(2)} as core, {_PART(3)} as suffix, length(w) >= 3 and regexp_matches(w, '\\p{{L}}') as eligible from tk")
def token_affixes(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(spelling.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", spelling.affixes(F.col("word")).alias("a"), spelling.eligible(F.col("word")).alias("eligible")).select("word", "a.prefix", "a.core", "a.suffix", "eligible")


_KEYS = lambda c: f"list_distinct(list_concat([{c}], list_transform(range(1, length({c}) + 1), lambda i: substr({c}, 1, i - 1) || substr({c}, i + 1))))"
#: The SQL function counts bytes, so accented letters are given one-byte names first (words hold letters only).
_EDITS = "damerau_levenshtein(translate(core, 'äöüßéèêçñíóúáàâîôûëï', '0123456789!#$%&()*+,'), translate(term, 'äöüßéèêçñíóúáàâîôûëï', '0123456789!#$%&()*+,'))"
_SUGGEST = f"""
ck as (select core, unnest({_KEYS('core')}) as k from co), dk as (select term, n, unnest({_KEYS('term')}) as k from di),
pr as (select distinct core, term, n from ck join dk using (k)),
vf as (select core, term, n, {_EDITS} as dist from pr where {_EDITS} <= 1),
sg as (select core, term, dist, n from vf qualify row_number() over (partition by core order by dist, n desc, term) = 1)
"""
_ENGLISH = f"(select doc_id, {_degraded()} as text from documents where lang = 'en')"
_CORES = f"src as {_ENGLISH}, {_TOKENS}, af as (select *, {_PART(1)} as p, {_PART(2)} as m, {_PART(3)} as x from tk), co as (select distinct lower(m) as core from af where length(w) >= 3 and regexp_matches(w, '\\p{{L}}') and m <> '')"


def _english(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    return docs.select("doc_id", degrade(F.col("doc_id"), F.col("text")).alias("text"))


@query(f"with {_DICT}, {_CORES}, {_SUGGEST} select core, term, dist::int as distance, n as count from sg")
def spell_suggest(spark, sf_dir):
    words = _english(spark, sf_dir).select(F.explode(spelling.tokens(F.col("text"))).alias("w")).where(spelling.eligible(F.col("w")))
    cores = words.select(F.lower(spelling.affixes(F.col("w"))["core"]).alias("core")).where("core <> ''")
    return spelling.suggest(cores, _dictionary(spark, sf_dir))


@query()
def spell_suggest_aggressive(spark, sf_dir):
    """Two edits with swaps: DuckDB's distance is the unrestricted one, so tests compare with plain Python."""
    words = _english(spark, sf_dir).select(F.explode(spelling.tokens(F.col("text"))).alias("w")).where(spelling.eligible(F.col("w")))
    cores = words.select(F.lower(spelling.affixes(F.col("w"))["core"]).alias("core")).where("core <> ''")
    return spelling.suggest(cores, _dictionary(spark, sf_dir), 2)


@query()
def correct_with_dictionary(spark, sf_dir):
    return spelling.correct_with_dictionary(_english(spark, sf_dir), _dictionary(spark, sf_dir))


_RESTORE = "case when upper(m) = m and lower(m) <> m then upper(term) when regexp_matches(m, '^\\p{Lu}') then upper(substr(term, 1, 1)) || lower(substr(term, 2)) else term end"


@query(f"""with {_DICT}, {_CORES}, {_SUGGEST}
select a.doc_id, string_agg(case when sg.term is null or dist = 0 or n <= 10 or not (length(w) >= 3 and regexp_matches(w, '\\p{{L}}')) then w else p || ({_RESTORE}) || x end, ' ' order by place) as text
from af a left join sg on sg.core = lower(a.m) group by a.doc_id""")
def spell_correct_text(spark, sf_dir):
    return spelling.correct_spelling(_english(spark, sf_dir), _dictionary(spark, sf_dir)).select("doc_id", "text")


@query(f"with src as (select doc_id, text from documents), {_TOKENS}, t as (select distinct {_PART(2)} as m, 'sample' as term from tk) select m as word, {_RESTORE} as restored from t where m <> ''")
def case_restore(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(spelling.tokens(F.col("text"))).alias("w"))
    cores = words.select(spelling.affixes(F.col("w"))["core"].alias("word")).where("word <> ''").distinct()
    return cores.select("word", spelling.restore_case(F.col("word"), F.lit("sample")).alias("restored"))


_EVENTS = """ev as (select event_id, user_id as session_id, ts, case event_type when 'click' then 'ctrl_l' when 'view' then 't' when 'purchase' then 'ctrl_l' when 'signup' then 'alt_r' else 't' end as key,
  case when event_type in ('purchase', 'error') then 'release' else 'press' end as action from events)"""


def key_events(events: DataFrame) -> DataFrame:
    """The events table read as key presses and releases of users (synthetic)."""
    kind = F.col("event_type")
    key = F.when(kind.isin("click", "purchase"), "ctrl_l").when(kind == "signup", "alt_r").otherwise("t")
    return events.select("event_id", F.col("user_id").alias("session_id"), "ts", key.alias("key"), F.when(kind.isin("purchase", "error"), "release").otherwise("press").alias("action"))


def _held_sql(key: str) -> str:
    return f"coalesce(last_value(case when key = '{key}' then action = 'press' end ignore nulls) over w, false)"


@query(f"""with {_EVENTS}, h as (select event_id, session_id, action, {_held_sql('ctrl_l')} as c, {_held_sql('t')} as t, {_held_sql('alt_r')} as a from ev
window w as (partition by session_id order by ts, key, action rows unbounded preceding)) select event_id, session_id from h where action = 'press' and c and t and a""")
def chord_triggers(spark, sf_dir):
    return chords.triggers(key_events(table(spark, sf_dir, "events")), ("ctrl", "alt"), "t").select("event_id", "session_id")


@query(f"""with {_VARIANTS}, {_CS}, raw as (select doc_id, coalesce({_RULE_S}, {_HEUR_S}) as strategy, coalesce({_RULE_C}, {_HEUR_C}) as confidence, a, merged from fs join (select doc_id, a from d) using (doc_id) join merged using (doc_id)),
x as (select doc_id, strategy, confidence, case when strategy = 'fast' then a else merged end as t from raw)
select doc_id, strategy, round(confidence, 9) as confidence, {_final(_obvious('t'))} as text from x""")
def recognise_pipeline(spark, sf_dir):
    return _rounded(recognise.recognised(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
