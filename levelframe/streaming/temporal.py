"""The carried line as a stream: scenes and the line before as state of each clip.

The choice is operators.temporal.choice, as in the batch fold. carried() takes the frames of each micro-batch in order;
carried_in_time() waits until the watermark has passed a frame, so that frames may come in any order up to the delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from levelframe.operators.temporal import SCENE_DIFFERENCE, choice

RESULT = "clip string, seq long, continuous boolean, scene int, vx double, vy double, x0 double, y0 double, score double, late boolean"
STATE = "thumb array<double>, scene int, line array<double>, seq long"
LINE = ("vx", "vy", "x0", "y0")


class Carried:
    """The state of a clip: last thumbnail, scene, line before (None after a frame that abstains), last frame."""

    def __init__(self, thumb=None, scene: int = -1, line=None, seq: int | None = None):
        self.thumb, self.scene, self.line, self.seq = thumb, scene, line, seq

    def next(self, seq: int, thumb, candidates, height: float, width: float, floor: float) -> tuple:
        """The result of one frame, without the clip. A frame that does not follow the last one is late: it gets no
        line and changes nothing."""
        if self.seq is not None and seq <= self.seq:
            return (seq, False, self.scene, None, None, None, None, None, True)
        near = self.thumb is not None and float(np.abs(np.asarray(self.thumb) - np.asarray(thumb)).mean()) <= SCENE_DIFFERENCE
        if not near:
            self.scene, self.line = self.scene + 1, None
        self.seq, self.thumb = seq, [float(v) for v in thumb]
        found = [{"source": c["source"], "raw": c["raw"], "count": c["count"], "place": k, "line": {f: c[f] for f in LINE}} for k, c in enumerate(candidates if candidates is not None else [])]
        best = choice(found, self.line and dict(zip(LINE, self.line, strict=True)), height, width, floor)
        self.line = best and [float(best["line"][f]) for f in LINE]
        return (seq, near, self.scene, *(self.line or [None] * 4), best and float(best["raw"]), False)


def carried(frames: DataFrame, height: float, width: float, floor: float) -> DataFrame:
    """frames (clip, seq, thumb array<double>, candidates array<struct<source, raw, vx, vy, x0, y0, count>> in the
    order in which equals win) as a stream of results: the winner of each frame, null where it abstains, and its scene.

    Rows of a micro-batch are put in order; a frame that comes after a later one of an earlier micro-batch is late.
    """

    def step(key, batches, state: GroupState):
        at = Carried(*state.get) if state.exists else Carried()
        rows = pd.concat(list(batches)).sort_values("seq")
        out = [(key[0], *at.next(int(seq), thumb, found, height, width, floor)) for seq, thumb, found in zip(rows["seq"], rows["thumb"], rows["candidates"], strict=True)]
        state.update((at.thumb, at.scene, at.line, at.seq))
        yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in RESULT.split(", ")])

    return frames.groupBy("clip").applyInPandasWithState(step, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)


WAITING = "seq long, thumb array<double>, candidates array<struct<source:string,raw:double,vx:double,vy:double,x0:double,y0:double,count:int>>"


class _InTime(StatefulProcessor):
    """Holds a clip's frames by event time until their timer, which the watermark sets off, and takes them in order."""

    def __init__(self, height: float, width: float, floor: float):
        self.size = height, width, floor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)
        self.waiting = handle.getMapState("waiting", "at long, seq long", WAITING)

    def _results(self, key, due: list) -> Iterator[pd.DataFrame]:
        at = Carried(*self.last.get()) if self.last.exists() else Carried()
        out = [(key[0], *at.next(seq, thumb, [c.asDict() if hasattr(c, "asDict") else dict(c) for c in found or []], *self.size)) for seq, thumb, found in sorted(due, key=lambda r: r[0])]
        self.last.update((at.thumb, at.scene, at.line, at.seq))
        yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in RESULT.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = set(self.handle.listTimers())
        for batch in rows:
            for at, seq, thumb, found in zip(batch["at"], batch["seq"], batch["thumb"], batch["candidates"], strict=True):
                ms = int(at) + 1
                self.waiting.updateValue((ms, int(seq)), (int(seq), [float(v) for v in thumb], [tuple(c[f] for f in ("source", "raw", *LINE, "count")) for c in (found if found is not None else [])]))
                if ms not in known:
                    self.handle.registerTimer(ms)
                    known.add(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = expiredTimerInfo.getExpiryTimeInMs()
        due = [(k, v) for k, v in self.waiting.iterator() if k[0] <= limit]
        for k, _ in due:
            self.waiting.removeKey(tuple(k))
        if not due:
            return iter(())
        return self._results(key, [tuple(v) for _, v in due])

    def close(self) -> None:
        pass


def carried_in_time(frames: DataFrame, time: str, delay: str, height: float, width: float, floor: float) -> DataFrame:
    """carried() by event time: frames may come in any order within the delay of the watermark; what comes later is
    dropped by the watermark. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).

    A frame's result comes when the watermark has passed its time; a clip's frames that wait are all that is held.
    """
    at = F.unix_millis(F.col(time).cast("timestamp"))
    rows = frames.withWatermark(time, delay).select("clip", time, at.alias("at"), "seq", "thumb", "candidates")
    return rows.groupBy("clip").transformWithStateInPandas(_InTime(height, width, floor), RESULT, "Append", "EventTime")
