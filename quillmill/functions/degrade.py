"""Deterministic damage to clean text, so that correction rules have something to do (synthetic)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REPLACEMENTS = ((" of ", " 0f "), (" to ", " t0 "), (" in ", " 1n "), (" or ", " 0r "), (", ", " ,"), (" the ", "  the "))
PREFIXES = ("1 am ", "1 have ", "1 will ", "1'm ", "1've ", "1'll ")


def degrade(doc_id: Column, text: Column) -> Column:
    for a, b in REPLACEMENTS:
        text = F.replace(text, F.lit(a), F.lit(b))
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), (F.pmod(F.floor(doc_id / 7), F.lit(6)) + 1).cast("int"))
    return F.concat(F.when(F.pmod(doc_id, F.lit(7)) == 0, prefix).otherwise(""), text)


def degrade_lines(text: Column) -> Column:
    """A second engine's damage: every fifth line gets a digit, every other even line loses its last character."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("1 "), x)).when(i % 2 == 0, F.substr(x, F.lit(1), F.greatest(F.length(x) - 1, F.lit(0)))).otherwise(x)), "\n")
