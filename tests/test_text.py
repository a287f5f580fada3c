import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import text as T

GOLDENS = [
    ("1 am happy", "I am happy"), ("1'm happy", "I'm happy"), ("going t0 school", "going to school"), ("0f course", "of course"), ("1n time", "in time"),
    ("hello  world", "hello world"), ("hello , world", "hello, world"), ("hello,world", "hello, world"), ("", ""), ("   ", ""),
    ("1 am going t0 school", "I am going to school"), ("at 1 AM", "at I am"), ("end\n. next", "end. next"), ("see example.com", "see example. com"),
    ("a , b", "a, b"), ("x\n\n  y ", "x\ny"), ("да,нет", "да, нет"), (None, None),
]


def apply(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", column(F.col("t")).alias("o")).orderBy("i").collect()]


def test_goldens(spark):
    assert apply(spark, [a for a, _ in GOLDENS], T.correct) == [b for _, b in GOLDENS]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a1 0ftnI'\n\t.,!)Яé", max_size=30), min_size=20, max_size=40))
def test_against_python(spark, texts):
    import re

    def expected(t):
        for pattern, to, flags in [
            (r" {2,}", " ", 0), (r"\s+([.,!?;:)])", r"\1", 0), (r"([.,!?;:])(?=[a-zA-Zа-яА-ЯёЁ])", r"\1 ", 0), (r"\b1\s+am\b", "I am", re.I), (r"\b1\s+have\b", "I have", re.I),
            (r"\b1\s+will\b", "I will", re.I), (r"\b1'm\b", "I'm", 0), (r"\b1've\b", "I've", 0), (r"\b1'll\b", "I'll", 0), (r"\b0f\b", "of", 0), (r"\b0r\b", "or", 0), (r"\b1n\b", "in", 0), (r"\bt0\b", "to", 0), (r" {2,}", " ", 0),
        ]:
            t = re.sub(pattern, to, t, flags=flags)
        return "\n".join(x for line in t.split("\n") if (x := line.strip()))

    assert apply(spark, texts, T.correct) == [expected(t) for t in texts]


def test_cleanup_is_idempotent(spark):
    once = apply(spark, [a for a, _ in GOLDENS], T.final_cleanup)
    assert apply(spark, once, T.final_cleanup) == once


def test_codes_and_hotkeys(spark):
    assert apply(spark, ["eng+rus+equ", " fra "], T.language_codes) == [["en", "ru", "equ"], ["fr"]]
    rows = apply(spark, ["<ctrl>+<alt>+t", "<super>+s", "Ctrl + Shift"], T.parse_hotkey)
    assert [tuple(r) for r in rows] == [(True, False, True, "t"), (False, False, False, "s"), (True, True, False, None)]


@pytest.mark.parametrize("name", ["fix_obvious", "spell_correct_text", "recognise_pipeline", "hotkey_parse", "image_features", "ensemble_merge_long", "chord_triggers", "token_affixes"])
def test_queries_match_their_sql(spark, compare, name):
    from quillmill.queries import oracle_sql, queries

    got, expected = compare(spark, queries()[name], oracle_sql()[name], "/root/testdata/sf0.001")
    assert got and got == expected


def test_every_damage_rule_has_work(spark):
    from quillmill.queries import queries

    for name in ("collapse_spaces", "tighten_punctuation", "space_after_punctuation", "pronoun_am", "pronoun_have", "pronoun_will", "digit_word_of", "digit_word_or", "digit_word_in", "digit_word_to"):
        assert queries()[name](spark, "/root/testdata/sf0.001").where("changed").count(), name
