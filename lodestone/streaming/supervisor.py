"""The job supervisor on a stream: a state machine for each job with event-time limits.

States go PREPARED, RUNNING, then COMPLETE or FAILED, or NO_PROGRESS when the watermark
passes the last event by more than the limit. What follows a terminal state has no effect.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("COMPLETE", "FAILED", "NO_PROGRESS")
OUTPUT = "job long, ts timestamp, state string, detail string"
STATE = "state string, outputs long, last long"


def supervise(events: DataFrame, *, late: str = "1 hour", silence_ms: int = 12 * 3_600_000, outputs: int = 3) -> DataFrame:
    """One row for each change of state.

    ``events``: ``job, ts, kind, fatal`` with a zoned ``ts``. ``signup`` starts a job, a
    fatal event fails it, ``outputs`` purchases complete it. Rows of one batch are taken in
    the order of time; null kinds count as signs of life only.
    """

    def step(key, frames: Iterator[pd.DataFrame], memory: GroupState) -> Iterator[pd.DataFrame]:
        state, done, last = memory.get if memory.exists else ("PREPARED", 0, 0)
        changes: list[tuple] = []

        def move(to: str, ts, detail: str) -> None:
            nonlocal state
            state = to
            changes.append((key[0], ts, to, detail))

        if memory.hasTimedOut:
            if state not in TERMINAL:
                move("NO_PROGRESS", pd.Timestamp(last + silence_ms, unit="ms"), "silent")
            memory.update((state, done, last))
        else:
            for row in pd.concat(list(frames)).sort_values("ts").itertuples():
                if state in TERMINAL:
                    break
                now = row.ts.value // 1_000_000
                if last and now - last > silence_ms and state == "RUNNING":
                    move("NO_PROGRESS", pd.Timestamp(last + silence_ms, unit="ms"), "silent")
                    break
                last = max(last, now)
                if row.fatal:
                    move("FAILED", row.ts, "fatal")
                elif row.kind == "signup" and state == "PREPARED":
                    move("RUNNING", row.ts, "start")
                elif row.kind == "purchase" and state == "RUNNING":
                    done += 1
                    if done >= outputs:
                        move("COMPLETE", row.ts, f"{done} outputs")
            memory.update((state, done, last))
            if state == "RUNNING" and last + silence_ms > memory.getCurrentWatermarkMs():
                memory.setTimeoutTimestamp(last + silence_ms)
        yield pd.DataFrame(changes, columns=["job", "ts", "state", "detail"])

    watched = events.withWatermark("ts", late)
    return watched.groupBy("job").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
