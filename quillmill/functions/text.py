"""Correction of recognised text as Column expressions: narrow, JVM-only, in a fixed order.

Patterns follow Python's Unicode rules: ``(?U)`` makes ``\\s``, ``\\b`` and case Unicode-aware.
Known quirks are kept on purpose: "1 AM" becomes "I am", "example.com" becomes "example. com",
and a line that begins with punctuation is pulled up to the line before it. Nulls stay null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTERS = "a-zA-Zа-яА-ЯёЁ"
#: Python strips and splits on these control characters as well.
_SPACE = r"[\s\x1c-\x1f]"

# Fixed rewrites, in order: (name, pattern, replacement).
COLLAPSE = ("collapse_spaces", " {2,}", " ")
TIGHTEN = ("tighten_punctuation", r"(?U)\s+([.,!?;:)])", "$1")
SPACE_AFTER = ("space_after_punctuation", rf"([.,!?;:])(?=[{_LETTERS}])", "$1 ")
PHRASES = (("i_am", r"(?Ui)\b1\s+am\b", "I am"), ("i_have", r"(?Ui)\b1\s+have\b", "I have"), ("i_will", r"(?Ui)\b1\s+will\b", "I will"))
CONTRACTIONS = (("i'm", r"(?U)\b1'm\b", "I'm"), ("i've", r"(?U)\b1've\b", "I've"), ("i'll", r"(?U)\b1'll\b", "I'll"))
DIGIT_WORDS = (("of", r"(?U)\b0f\b", "of"), ("or", r"(?U)\b0r\b", "or"), ("in", r"(?U)\b1n\b", "in"), ("to", r"(?U)\bt0\b", "to"))
OBVIOUS = (COLLAPSE, TIGHTEN, SPACE_AFTER, *PHRASES, *CONTRACTIONS, *DIGIT_WORDS)
LANGUAGES = {"eng": "en", "rus": "ru", "jpn": "ja", "kor": "ko", "chi_sim": "ch_sim", "chi_tra": "ch_tra", "fra": "fr", "deu": "de", "spa": "es"}


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` names it within a lambda over other values."""
    return F.transform(F.array(value), use)[0]


def rewrite(c: Column, *rules: tuple[str, str, str]) -> Column:
    for _, pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def clean_lines(c: Column) -> Column:
    """Each line stripped, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(c, "\n", -1), strip), lambda x: x != ""), "\n")


def fix_obvious(c: Column) -> Column:
    return rewrite(c, *OBVIOUS)


def final_cleanup(c: Column) -> Column:
    return clean_lines(rewrite(c, COLLAPSE))


def basic_post_process(c: Column) -> Column:
    """What is done when correction is off but clean-up is asked for."""
    return clean_lines(rewrite(c, COLLAPSE, ("", r"(?U)\s+([.,!?;:])", "$1"), ("", rf"([.,!?:;])(?=[{_LETTERS}])", "$1 ")))


def correct(c: Column) -> Column:
    """All rules without the dictionary; empty text stays empty."""
    return final_cleanup(fix_obvious(c))


def language_codes(c: Column) -> Column:
    """``eng+rus`` to the other engine's codes; unknown codes pass through."""
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.transform(F.split(c, r"\+", -1), lambda x: F.coalesce(F.try_element_at(known, strip(x)), strip(x)))


def parse_hotkey(c: Column) -> Column:
    """struct<need_ctrl, need_shift, need_alt, key>; a super key is read but never required."""
    parts = F.transform(F.split(F.replace(F.lower(c), F.lit(" "), F.lit("")), r"\+", -1), lambda x: F.btrim(x, F.lit("<>")))
    keys = F.filter(parts, lambda x: ~x.isin("ctrl", "control", "shift", "alt", "super", "win", "meta"))
    has = lambda *names: F.exists(parts, lambda x: x.isin(*names))
    return F.struct(has("ctrl", "control").alias("need_ctrl"), has("shift").alias("need_shift"), has("alt").alias("need_alt"), F.try_element_at(keys, F.lit(-1)).alias("key"))
