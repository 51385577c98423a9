"""Limits of running jobs on a stream: reminders, start, wait and deadline, each with a timer of its own.

Rows may come in any order within the watermark's delay. A job keeps those that the
watermark has not passed in a list and takes them in the order of time, so that what is
said of a job doesn't depend on how its rows were cut into batches. A timer fires
when the watermark passes its limit, whether or not a row comes. When a job has been silent for
long enough, its verdict is given and its state is deleted.

State lives in RocksDB (:func:`use_rocksdb`), with a checkpoint from which a query starts again. Each word with it is a round trip
out of Python: what rows mean is told before as flags, they lie in it by the thousand, and a job that is over as soon as its rows
are taken has no timers of limits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = (
    "job long, event string, threshold double, due_us long, at_us long, code int, state string, wait string, late_start boolean, over_deadline boolean, gate_message string"
)
_COLUMNS = [part.split()[0] for part in OUTPUT.split(", ")]
_FACTS = "began long, ended long, started long, failed long, outputs long, sent long"
#: Pairs of times and flags as long integers, at most so many pairs in a piece.
_ROWS, PIECE = "rows binary", 1000
START, FATAL, OUT = 1, 2, 4


@dataclass(frozen=True)
class Rules:
    """What rows mean, and the limits in seconds.

    ``start``, ``output`` and ``fatal`` are a kind and the value that it must reach, the last one exceed (None: any). A wait is over
    when it reaches ``wait``; a start is late and a job too long only beyond theirs. A job that is silent for ``closed`` is over.
    """

    start: tuple[str, float | None] = ("signup", None)
    fatal: tuple[str, float | None] = ("error", 90.0)
    output: tuple[str, float | None] = ("purchase", 20.0)
    least_outputs: int = 3
    reminders: Sequence[float] = (86400.0, 259200.0, 604800.0)
    startup: float = 172800.0
    marker: float = 86400.0
    wait: float = 172800.0
    deadline: float = 2505600.0
    closed: float = 3456000.0


def use_rocksdb(session: SparkSession) -> None:
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _us(seconds: float) -> int:
    return round(seconds * 1_000_000)


def _ms(us: int) -> int:
    """The first millisecond that isn't before."""
    return -(-us // 1000)


def _pieces(rows: np.ndarray) -> list[tuple[bytes]]:
    return [(rows[k : k + PIECE].tobytes(),) for k in range(0, len(rows), PIECE)]


def _flags(rules: Rules) -> Column:
    def meets(rule: tuple[str, float | None], flag: int, beyond: bool = False) -> Column:
        name, least = rule
        value = F.lit(True) if least is None else F.col("value") > least if beyond else F.col("value") >= least
        return F.when((F.col("kind") == name) & value, F.lit(flag)).otherwise(F.lit(0))

    return (meets(rules.start, START) + meets(rules.fatal, FATAL, beyond=True) + meets(rules.output, OUT)).cast("long")


class Watch(StatefulProcessor):
    def __init__(self, rules: Rules):
        self.rules = rules
        #: Limits that a timer tells of: name, threshold, whether it is over only beyond it.
        self.limits = [("REMINDER", float(t), False) for t in sorted(rules.reminders)]
        self.limits += [("NO_PROGRESS: start marker", rules.marker, True), ("RESOURCE_WAIT_TIMEOUT", rules.wait, False), ("NO_PROGRESS: task deadline exceeded", rules.deadline, True)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", _FACTS)
        self.pending = handle.getListState("pending", _ROWS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = np.array([(r["us"], r["flags"]) for r in rows], np.int64)
        self.pending.appendList(_pieces(new))
        # The earliest of them is due when the watermark passes it.
        self.handle.registerTimer(max(_ms(int(new[:, 0].min())), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = np.frombuffer(b"".join(piece[0] for piece in self.pending.get()), np.int64).reshape(-1, 2)
        held = held[np.argsort(held[:, 0], kind="stable")]
        due = held[: np.searchsorted(held[:, 0], now * 1000, "right")].tolist()
        said: list[dict] = []
        known = self.facts.get()
        facts = list(known) if known is not None else None
        for ts, flags in due:
            if facts is None:
                facts = [ts, ts, None, None, 0, 0]
            self._count(facts, ts, flags, said, key)
        if len(due) < len(held):
            self.pending.put(_pieces(held[len(due) :]))
            self.handle.registerTimer(max(_ms(int(held[len(due), 0])), now + 1))
        elif len(held):
            self.pending.clear()
        if facts is not None:
            self._pass(facts, now * 1000, said, key)
            over = _ms(facts[1] + _us(self.rules.closed)) + 1
            if over <= now and len(due) == len(held):
                said.append(self._verdict(facts, key))
                if known is not None:
                    self.facts.clear()
                    for timer in list(self.handle.listTimers()):
                        self.handle.deleteTimer(timer)
            else:
                if known is None:
                    for _, limit, _ in self.limits:
                        self.handle.registerTimer(max(_ms(facts[0] + _us(limit)) + 1, now + 1))
                if due or over > now:
                    self.handle.registerTimer(max(over, now + 1))
                self.facts.update(tuple(facts))
        return iter([Row(**{c: r.get(c) for c in _COLUMNS}) for r in said])

    def close(self) -> None:
        pass

    def _count(self, facts: list, ts: int, flags: int, said: list[dict], key) -> None:
        """One row in the order of time; a reminder that it is the first to reach is seen."""
        before = facts[1]
        facts[1] = max(facts[1], ts)
        if facts[2] is None and flags & START:
            facts[2] = ts
        if facts[3] is None and flags & FATAL:
            facts[3] = ts
        if flags & OUT:
            facts[4] += 1
        for t in self.rules.reminders:
            due = facts[0] + _us(t)
            if ts >= due and (before < due or before == facts[0] == ts):
                said.append({"job": key[0], "event": "REMINDER_SEEN", "threshold": float(t), "due_us": due, "at_us": ts})

    def _pass(self, facts: list, now: int, said: list[dict], key) -> None:
        """Limits that the watermark has passed are told of once."""
        for bit, (name, limit, beyond) in enumerate(self.limits):
            due = facts[0] + _us(limit)
            if facts[5] >> bit & 1 or now < due + beyond:
                continue
            facts[5] |= 1 << bit
            started = facts[2] is not None and (facts[2] <= due if beyond else facts[2] < due)
            if name == "REMINDER" or "deadline" in name or not started:
                said.append({"job": key[0], "event": name, "threshold": limit, "due_us": due})

    def _verdict(self, facts: list, key) -> dict:
        began, ended, started, failed, outputs, _ = facts
        rules = self.rules
        code = 3 if failed is not None else 5 if started is None else 4 if outputs < rules.least_outputs else 0
        waited = (ended if started is None else started) - began
        wait = (
            "RESOURCE_WAIT_TIMEOUT" if waited >= _us(rules.wait)
            else "NO_PROGRESS: start marker" if waited > _us(rules.marker)
            else "NO_PROGRESS: task deadline exceeded" if ended - began > _us(rules.deadline)
            else "ok"
        )
        return {
            "job": key[0],
            "event": "VERDICT",
            "at_us": ended,
            "code": code,
            "state": "FAILED" if code else "COMPLETE",
            "wait": wait,
            "late_start": started is None or started - began > _us(rules.startup),
            "over_deadline": ended - began > _us(rules.deadline),
            "gate_message": None if outputs >= rules.least_outputs else f"{rules.output[0]}: {outputs}/{rules.least_outputs} valid files",
        }


def watch(events: DataFrame, rules: Rules = Rules(), *, late: str = "7 days") -> DataFrame:
    """What happens to each job, as soon as the watermark knows it.

    ``events``: ``job, ts, event_id, kind, value`` with a zoned ``ts``. Rows of :data:`OUTPUT`: ``REMINDER`` and the names
    of the other limits when they are passed; ``REMINDER_SEEN`` with the first row at or after a reminder;
    ``VERDICT`` when the job is over. Rows that the watermark has passed are dropped, those without a job or a time left out. A job that goes on after its verdict is a new one.
    """
    # A null key would be taken for the one beside it.
    watched = events.select("job", "ts", F.unix_micros("ts").alias("us"), _flags(rules).alias("flags")).where("job IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return watched.groupBy("job").transformWithState(Watch(rules), OUTPUT, "append", "eventTime")


def replay(events: DataFrame, folder: str, rules: Rules = Rules(), *, late: str = "7 days") -> DataFrame:
    """What a stream over all of a table says, written to ``folder``; ``events`` is a stream of the table's files.

    A row long after the last one, of a job of its own, ends all jobs.
    """
    session = events.sparkSession
    use_rocksdb(session)
    query = watch(events, rules, late=late).writeStream.format("parquet").option("path", f"{folder}/said").option("checkpointLocation", f"{folder}/state")
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return session.read.schema(OUTPUT).parquet(f"{folder}/said")
