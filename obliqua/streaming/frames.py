"""Frames of a growing acquisition: each is told once, when its last plane has come.

The state of an image is small: for each of its frames the planes that have come, a bit each, and the last time seen.  A
frame with all its planes is told at once.  One that lacks planes is told as incomplete when a later time has
come and nothing more of the image has for ``patience_ms``; the last time of an image is dropped then, as a microscope that is
stopped leaves it half written.  So after a timeout the frames told are those that the batch rule
(``volume.complete_frames``) keeps, whatever the order in which planes came.

Defined cases: planes that come twice count once; planes of a frame that has been told are passed over; rows with a null key are left
out; channels and planes outside the sizes given raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FRAMES = "image_id int, t int, n_planes int, complete boolean"
#: Planes of a frame are kept as bits; a told frame keeps none, but this mark.
TOLD = b""


class FrameProcessor(StatefulProcessor):
    def __init__(self, channels: int, depth: int, patience_ms: int):
        self.channels, self.depth, self.patience_ms = channels, depth, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "t int", "planes binary")
        self.timer = handle.getValueState("timer", "at long")

    def _frame(self, image: int, t: int, held: int) -> tuple[int, int, int, bool]:
        count = held.bit_count()
        return (image, t, count, count == self.channels * self.depth)

    def _told(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["image_id", "t", "n_planes", "complete"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh: dict[int, int] = {}
        for part in rows:
            for t, c, z in zip(part["t"].tolist(), part["c"].tolist(), part["z"].tolist(), strict=True):
                if not (0 <= c < self.channels and 0 <= z < self.depth):
                    raise ValueError(f"plane c={c}, z={z} of image {key[0]} is outside {self.channels} channels of {self.depth} planes")
                fresh[t] = fresh.get(t, 0) | 1 << c * self.depth + z
        out = []
        for t, bits in sorted(fresh.items()):
            before = self.frames.getValue((t,))
            if before is not None and bytes(before[0]) == TOLD:
                continue
            bits |= int.from_bytes(before[0], "big") if before is not None else 0
            frame = self._frame(key[0], t, bits)
            if frame[3]:
                out.append(frame)
            self.frames.updateValue((t,), (TOLD if frame[3] else bits.to_bytes(-(-self.channels * self.depth // 8), "big"),))
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = timerValues.getCurrentProcessingTimeInMs() + self.patience_ms
        self.handle.registerTimer(at)
        self.timer.update((at,))
        yield from self._told(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = {int(k[0]): bytes(v[0]) for k, v in self.frames.iterator()}
        last = max(held, default=None)
        out = []
        for t, planes in sorted(held.items()):
            if planes != TOLD and t != last:
                out.append(self._frame(key[0], t, int.from_bytes(planes, "big")))
                self.frames.updateValue((t,), (TOLD,))
        self.timer.clear()
        yield from self._told(out)

    def close(self) -> None:
        pass


def frames_as_they_come(planes: DataFrame, channels: int, depth: int, patience_ms: int = 600_000) -> DataFrame:
    """(image_id, t, n_planes, complete) of a stream of planes (image_id, t, c, z), one row a plane or more.

    The session needs the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass``.
    """
    keys = planes.select(*[F.col(k).cast("int").alias(k) for k in ("image_id", "t", "c", "z")]).dropna()
    return keys.groupBy("image_id").transformWithStateInPandas(FrameProcessor(channels, depth, patience_ms), FRAMES, "Append", "ProcessingTime")
