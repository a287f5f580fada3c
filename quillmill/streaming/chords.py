"""The chord detector on a stream of key events: keyed state, no window, no debounce.

Each session's state is its held keys. Within a micro-batch events go by time, then key, action,
as in the batch form; across batches they are taken as they arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.chords import GROUPS

EVENT_SQL = "session_id long, ts timestamp, key string, action string"


def stream_triggers(events: DataFrame, groups: tuple[str, ...], key: str | None) -> DataFrame:
    """The presses of a streaming ``events`` at which the chord is held."""

    def step(session: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = set(state.get[0]) if state.exists else set()
        rows = pd.concat(list(batches)).sort_values(["ts", "key", "action"])
        fired = []
        for e in rows.itertuples(index=False):
            name = e.key.lower()
            held.add(name) if e.action == "press" else held.discard(name)
            if e.action == "press" and key in held and all(held & set(GROUPS[g]) for g in groups):
                fired.append(e)
        state.update((sorted(held),))
        yield pd.DataFrame(fired, columns=["session_id", "ts", "key", "action"])

    return events.select("session_id", "ts", "key", "action").groupBy("session_id").applyInPandasWithState(step, EVENT_SQL, "held array<string>", "append", GroupStateTimeout.NoTimeout)


def act_on(triggers: DataFrame, action, checkpoint: str):
    """Starts a query that calls ``action(batch, batch_id)`` for each batch of triggers."""
    return triggers.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
