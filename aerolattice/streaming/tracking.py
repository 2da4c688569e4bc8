"""The keyframe decision as ordered state of each sequence, in batch and with Structured Streaming.

The step is one function of the state and a frame: the first frame must localise and becomes a keyframe; a later
frame becomes one by the rule of points, errors and intervals; a tracked frame whose jump is out of
proportion to the last steps fails; five failures in a row relocalise. Batch and stream share it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IN = ("seq", "ord", "x", "y", "tracked", "err", "failed")
OUT = "seq long, ord long, method string, reason string, keyframe long, since long, success boolean"
STATE = "keyframe long, since long, x double, y double, failures long, relocalised long, initial long, baseline double, last long, steps array<double>"
MIN_POINTS, MIN_INTERVAL, HISTORY, MAX_FAILURES, MAX_RELOCALISED = 100, 5, 15, 5, 3


@dataclass
class Track:
    """What one sequence carries from frame to frame; keyframe is -1 before the first."""

    keyframe: int = -1
    since: int = 0
    x: float = 0.0
    y: float = 0.0
    failures: int = 0
    relocalised: int = 0
    initial: int = 0
    baseline: float = 0.0
    last: int = -(1 << 62)  # the order of the last frame that was looked at
    steps: list[float] = field(default_factory=list)

    def start(self, order: int, x: float, y: float, tracked: int, err: float) -> None:
        self.keyframe, self.since, self.x, self.y, self.initial, self.baseline, self.failures, self.steps = order, 0, x, y, tracked, err, 0, []

    def reason(self, tracked: int, err: float) -> str:
        """functions.geometry.keyframe_reason() with its defaults, of a state instead of columns."""
        if self.since < MIN_INTERVAL:
            return ""
        if tracked < MIN_POINTS:
            return "low_points"
        if self.initial > 0 and tracked < 0.4 * self.initial and tracked < 3 * MIN_POINTS:
            return "point_drop"
        slack = 2 * max(0.0, 1 - self.since / 15)
        if err > (self.baseline if self.baseline > 2 + slack else 2) + slack:
            return "reproj_abs"
        gone = min(1.0, (self.since - 15) / 100)
        grown = self.baseline > 0 and self.since >= 15 and err > self.baseline * (1 + (1 - gone) + 0.35 * gone)
        return "reproj_growth" if grown else ""

    def step(self, order: int, x: float, y: float, tracked: int, err: float, failed: bool) -> tuple[str, str, bool]:
        """Method, reason and success of the next frame."""
        self.last = order
        if self.keyframe < 0:
            if failed:
                return "failed", "first_frame", False
            self.start(order, x, y, tracked, err)
            return "keyframe", "first_frame", True
        self.since += 1
        jump = ((x - self.x) ** 2 + (y - self.y) ** 2) ** 0.5
        usual = median(self.steps) if len(self.steps) >= 3 else 0.0
        if failed or (len(self.steps) >= 3 and jump > max(20.0, 10 * (usual if usual > 0 else 2.0))):
            self.failures += 1
            if self.failures >= MAX_FAILURES and self.relocalised < MAX_RELOCALISED:
                self.relocalised += 1
                self.start(order, x, y, tracked, err)
                return "re-localized", "failures", True
            return "failed", "lost" if failed else "jump", False
        reason = self.reason(tracked, err)
        if reason:
            self.start(order, x, y, tracked, err)
            return "keyframe", reason, True
        self.failures, self.x, self.y = 0, x, y
        self.steps = [*self.steps, jump][-HISTORY:]
        return "tracked", "", True


def _run(track: Track, seq: int, frames: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for f in frames.sort_values("ord").itertuples(index=False):
        method, reason, success = track.step(int(f.ord), f.x, f.y, int(f.tracked), f.err, bool(f.failed))
        rows.append((seq, int(f.ord), method, reason, track.keyframe, track.since, success))
    return pd.DataFrame(rows, columns=["seq", "ord", "method", "reason", "keyframe", "since", "success"])


def track_batch(frames: DataFrame) -> DataFrame:
    """A row for each of ``frames`` (IN): one task holds one sequence, which is as long as its flight."""

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _run(Track(), int(key[0]), pdf)

    return frames.select(*IN).where("seq is not null").groupBy("seq").applyInPandas(whole, OUT)


def track_stream(frames: DataFrame) -> DataFrame:
    """As track_batch() over a stream whose frames arrive in order; the state of a sequence outlives batches.

    Frames that arrive behind the last one of their sequence are dropped, as a tracker can't go back.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values = state.get if state.exists else None
        track = Track() if values is None else Track(*values[:9], list(values[9]))
        frames = pd.concat(list(batches))
        yield _run(track, int(key[0]), frames[frames["ord"] > track.last])
        state.update(tuple(asdict(track).values()))

    return frames.select(*IN).where("seq is not null").groupBy("seq").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
