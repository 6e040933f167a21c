"""Keys that expire when nobody touches them, on streams, in logical ticks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, tick bigint, event string"
STATE = "last_touch bigint, expires_at bigint, tti_ticks bigint"


def expiries(touches: DataFrame) -> DataFrame:
    """Expiry events of a stream of touches (key, tick, ttl_ticks, tti_ticks, write).

    A write sets both times anew, 0 for none; a read only refreshes the idle
    time.  A touch that finds its key expired emits "expired" at the tick at
    which it was, and a read then finds nothing.  Ticks of a key are taken in
    order within a batch.

    A tick is taken for a second of event time.  Once the highest tick of all
    keys (the watermark, without delay) has passed the end of a key, a timer
    emits its expiry and drops its state, so keys that nobody touches again
    expire too.  A touch behind the clock that an earlier batch had reached is
    late and may be dropped, as with any watermark.  The state is three numbers
    per live key.
    """

    def ends(held: tuple) -> list[int]:
        last, at, idle = held
        return [x for x in (at, last + idle if idle else 0) if x]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        events = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], min(ends(held)), "expired")], columns=["key", "tick", "event"])
            return
        rows = pd.concat(list(frames)).sort_values("tick", kind="stable")
        for tick, ttl, tti, write in zip(rows["tick"], rows["ttl_ticks"], rows["tti_ticks"], rows["write"]):
            if held is not None:
                over = ends(held)
                if over and tick >= min(over):
                    events.append((key[0], min(over), "expired"))
                    held = None
            if write:
                held = (int(tick), int(tick + ttl) if ttl else 0, int(tti))
            elif held is not None:
                held = (int(tick), held[1], held[2])
        if held is None:
            if state.exists:
                state.remove()
        else:
            over = ends(held)
            if over and min(over) * 1000 <= state.getCurrentWatermarkMs():  # the clock has passed it already
                events.append((key[0], min(over), "expired"))
                if state.exists:
                    state.remove()
            else:
                state.update(held)
                if over:
                    state.setTimeoutTimestamp(min(over) * 1000)
        yield pd.DataFrame(events, columns=["key", "tick", "event"])

    timed = touches.withColumn("kl_at", F.timestamp_seconds("tick")).withWatermark("kl_at", "0 seconds")
    return timed.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
