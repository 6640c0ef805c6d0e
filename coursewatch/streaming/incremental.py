"""Streaming forms: readings as they arrive, removal counters as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.diff import CONFIRMATIONS

COUNTER = "key string, first_missing date, confirmed_on date"


def removal_counter(reads: DataFrame) -> DataFrame:
    """reads: a stream of (key, day, present), one row for each successful read of a believed key, to confirmed removals.

    State can't see silence, so absences come as rows. A key that is seen
    starts anew and its state goes, a second row of a day doesn't count, and a
    confirmed key isn't confirmed again before it is seen.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = sorted((pd.Timestamp(d).date(), bool(p)) for b in batches for d, p in zip(b["day"], b["present"], strict=True))
        count, first, last = state.get if state.exists else (0, None, None)
        done = []
        for day, present in rows:
            if present:
                count, first, last = 0, None, None
            elif count < CONFIRMATIONS and (last is None or date.fromisoformat(last) < day):
                count, first, last = count + 1, first or day.isoformat(), day.isoformat()
                if count == CONFIRMATIONS:
                    done.append((key[0], date.fromisoformat(first), day))
        if count:
            state.update((count, first, last))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(done, columns=["key", "first_missing", "confirmed_on"])

    return reads.groupBy("key").applyInPandasWithState(step, COUNTER, "count int, first string, last string", "append", GroupStateTimeout.NoTimeout)


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, str], None], checkpoint: str):
    """Run ``apply(readings, run_id)`` over what has arrived, once for each batch.

    The run id follows from the batch, so that a batch that is run again after
    a failure commits nothing twice.
    """
    return stream.writeStream.foreachBatch(lambda df, n: apply(df, f"batch-{n:012d}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(messages: DataFrame, at: str = "at", delay: str = "1 day") -> DataFrame:
    """Messages by key, each once within the watermark."""
    return messages.withWatermark(at, delay).dropDuplicatesWithinWatermark(["key"])
