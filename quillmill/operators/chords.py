"""Key chords in event tables: who holds which key, and when a press completes a chord.

Held keys are the last action of each watched key in the session, a running window. The chord is
tested at every press while it is held, repeats included; a super key is never required; without
a main key nothing fires. Events need distinct times in a session; equal ones go by key, action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GROUPS = {"ctrl": ("ctrl_l", "ctrl_r"), "shift": ("shift_l", "shift_r"), "alt": ("alt_l", "alt_r")}


def triggers(events: DataFrame, groups: tuple[str, ...], key: str | None) -> DataFrame:
    """The presses of ``events`` (session_id, ts, key, action) at which the chord is held."""
    if key is None:
        return events.where("false")
    so_far = Window.partitionBy("session_id").orderBy("ts", "key", "action").rowsBetween(Window.unboundedPreceding, 0)
    held = lambda k: F.coalesce(F.last(F.when(F.lower("key") == k, F.col("action") == "press"), True).over(so_far), F.lit(False))
    chord = held(key)
    for g in groups:
        left, right = GROUPS[g]
        chord = chord & (held(left) | held(right))
    return events.withColumn("_chord", chord).where("_chord and action = 'press'").select(*events.columns)
