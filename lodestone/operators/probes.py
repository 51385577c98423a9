"""Named probes over batches of readings, in place of programs that are started to ask a resource.

A probe is a function from a frame of readings to one of ``available`` and ``reason`` of the same
length. What it says is kept as rows; a probe that fails is a row too, with what went wrong as its reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

Probe = Callable[[pd.DataFrame], pd.DataFrame]
#: Characters of a reason that are kept, from its end.
REASON = 1000


class Registry:
    """Probes by name; a name that is taken, or a probe that isn't callable, is an error."""

    def __init__(self) -> None:
        self._probes: dict[str, Probe] = {}

    def add(self, name: str) -> Callable[[Probe], Probe]:
        def put(probe: Probe) -> Probe:
            if name in self._probes:
                raise ValueError(f"there is a probe {name}")
            if not callable(probe):
                raise TypeError(f"{name} can't be called")
            self._probes[name] = probe
            return probe

        return put

    def names(self) -> list[str]:
        return sorted(self._probes)

    def ask(self, readings: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
        """``keep, probe, available, failed, reason``: what each of the probes says of every reading.

        ``available`` is null where a probe fails or says nothing. Readings are taken as they are batched, nothing is shuffled; a probe
        that fails on a batch is asked for each of its readings by itself, so that only those that it fails on are lost.
        """
        chosen = {n: self._probes[n] for n in names}
        kinds = ", ".join(f"{c} {readings.schema[c].dataType.simpleString()}" for c in keep)
        columns = [*keep, "probe", "available", "failed", "reason"]

        def said(probe: Probe, frame: pd.DataFrame) -> pd.DataFrame:
            out = probe(frame.copy())
            if len(out) != len(frame):
                raise ValueError(f"{len(out)} answers to {len(frame)} readings")
            answer = pd.DataFrame({"available": [None if pd.isna(x) else bool(x) for x in out["available"]], "failed": False}, dtype=object)
            answer["reason"] = [None if pd.isna(x) else str(x)[-REASON:] for x in out["reason"]]
            return answer

        def one_by_one(probe: Probe, frame: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for k in range(len(frame)):
                try:
                    rows.append(said(probe, frame.iloc[[k]].reset_index(drop=True)))
                except Exception as problem:  # noqa: BLE001 - whatever a probe raises is its answer
                    rows.append(pd.DataFrame([[None, True, repr(problem)[-REASON:]]], columns=["available", "failed", "reason"], dtype=object))
            return pd.concat(rows, ignore_index=True)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for name, probe in chosen.items():
                    try:
                        answer = said(probe, frame)
                    except Exception:  # noqa: BLE001
                        answer = one_by_one(probe, frame) if len(frame) else pd.DataFrame(columns=["available", "failed", "reason"])
                    kept = frame[list(keep)].reset_index(drop=True)
                    yield pd.concat([kept, pd.Series([name] * len(frame), name="probe", dtype=object), answer], axis=1)[columns]

        return readings.mapInPandas(run, f"{kinds}, probe string, available boolean, failed boolean, reason string")


PROBES = Registry()


@PROBES.add("no_process")
def no_process(readings: pd.DataFrame) -> pd.DataFrame:
    """A device is free when no process runs on it; ``processes`` lists their names."""
    busy = readings["processes"].map(lambda p: [] if p is None else list(p))
    return pd.DataFrame({"available": busy.map(len) == 0, "reason": busy.map(lambda p: "; ".join(map(str, p)) or "free")})


@PROBES.add("memory_left")
def memory_left(readings: pd.DataFrame) -> pd.DataFrame:
    """A device is free when half of its memory is; a reading without figures is a failure."""
    if readings[["used", "total"]].isna().any(axis=None):
        raise ValueError("a reading has no figures")
    share = readings["used"] / readings["total"]
    return pd.DataFrame({"available": share <= 0.5, "reason": share.map("{:.0%} used".format)})
