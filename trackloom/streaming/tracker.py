"""The tracker on a stream of detections: the same tracks as ``operators.tracks.track_clips`` makes of a table.

State per clip: the detections of frames that may still get more, one entry for
a stretch of frames, and the active tracks, one entry a track. A frame is taken
when the watermark has passed it, so its detections may come in several
micro-batches and in any order. A clip's first timer of a micro-batch takes all
frames that are due, with the tracks read and written once and one stretch of
detections held at a time. Another timer clears a clip that has had no frame
for longer than a track lives.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import boxes as bx
from ..operators.tracks import COLUMNS, _Seen, _Track, _Trail, greedy_frame

EVENTS = "clip_id long, frame long, detection long, track long, cost double, gap long, event string"
#: Frames to a stretch.
STRETCH = 64
_ROW = "frame long, detection long, x double, y double, foot_x double, foot_y double, x0 double, y0 double, x1 double, y1 double, hist array<double>"
_TRAIL = "prior array<double>, prior_at long, last array<double>, last_at long"
_STATE = f"frame long, box array<double>, hists array<double>, n long, mean array<double>, centres struct<{_TRAIL.replace(' ', ': ').replace(',: ', ', ')}>, feet struct<{_TRAIL.replace(' ', ': ').replace(',: ', ', ')}>"


def _floats(v) -> list[float] | None:
    return None if v is None else [float(x) for x in v]


def _packed(t: _Track) -> tuple:
    """A track as a row of state."""
    trail = lambda s: (_floats(s.prior), int(s.prior_at), _floats(s.last), int(s.last_at))
    return int(t.frame), _floats(t.last.box), _floats(t.hists), int(t.n), _floats(t.mean), trail(t.centres), trail(t.feet)


def _unpacked(track: int, row) -> _Track:
    frame, box, hists, n, mean, centres, feet = row
    t, some = _Track.__new__(_Track), lambda v: None if v is None else np.asarray(v, float)
    t.id, t.frame, t.hists, t.n, t.mean = track, int(frame), some(hists), int(n), some(mean)
    t.last = _Seen((None, frame, 0, *(None,) * 4, *(box if box is not None else (None,) * 4), None))
    for name, (prior, prior_at, last, last_at) in (("centres", centres), ("feet", feet)):
        trail = _Trail()
        trail.prior, trail.last = (None if p is None else tuple(map(float, p)) for p in (prior, last))
        trail.prior_at, trail.last_at = int(prior_at), int(last_at)
        setattr(t, name, trail)
    return t


def _events(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in EVENTS.split(", ")]).astype({"detection": "Int64", "cost": float, "gap": "Int64"})


class TrackClips(StatefulProcessor):
    """Greedy tracking of one clip; see ``track_stream``."""

    def __init__(self, max_age: int, frame_ms: int):
        self.max_age, self.frame_ms = max_age, frame_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "stretch long", f"rows array<struct<{', '.join(c.replace(' ', ': ', 1) for c in _ROW.split(', '))}>>")
        self.tracks = handle.getMapState("tracks", "track long", _STATE)
        #: Tracks whose state a timer has cleared; their end is told at the clip's next frame.
        self.ended = handle.getMapState("ended", "track long", "frame long")
        self.following = handle.getValueState("following", "track long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            part = part.astype(object).where(part.notna(), None)
            for stretch, own in part.groupby(part["frame"].astype("int64") // STRETCH, sort=True):
                at = (int(stretch),)
                held = [tuple(r) for r in self.waiting.getValue(at)[0]] if self.waiting.containsKey(at) else []
                held += [(int(r[1]), int(r[2]), *(None if v is None else float(v) for v in r[3:11]), _floats(r[11])) for r in own[list(COLUMNS)].itertuples(index=False, name=None)]
                self.waiting.updateValue(at, (held,))
                least = min(r[0] for r in held)
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer((first + 1) * self.frame_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Spark fires the timers that the watermark has passed or reached, so all frames up to here are complete.
        reached = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) // self.frame_ms - 1
        stretches = sorted(s for (s,) in self.waiting.keys())
        due = [s for s in stretches if s * STRETCH <= reached]
        active = {int(t): _unpacked(int(t), row) for (t,), row in sorted(self.tracks.iterator(), key=lambda e: e[0][0])}
        before, taken, rest = set(active), None, [s * STRETCH for s in stretches[len(due) : len(due) + 1]]
        following = self.following.get()[0] if due and self.following.exists() else 1
        for stretch in due:
            rows = sorted(map(tuple, self.waiting.getValue((stretch,))[0]), key=lambda r: r[:2])
            later = [r for r in rows if r[0] > reached]
            if later:
                rest.append(later[0][0])
            if len(later) == len(rows):
                continue
            if later:
                self.waiting.updateValue((stretch,), (later,))
            else:
                self.waiting.removeKey((stretch,))
            out = []
            for frame, own in groupby(rows[: len(rows) - len(later)], key=lambda r: r[0]):
                ended = [int(t) for (t,) in self.ended.keys()] if taken is None else []
                for t in ended:
                    self.ended.removeKey((t,))
                taken = frame
                following = self.take(key[0], frame, list(own), active, ended, following, out)
            yield _events(out)
        if taken is not None:
            for t in before - set(active):
                self.tracks.removeKey((t,))
            for t, held in active.items():
                self.tracks.updateValue((t,), _packed(held))
            self.following.update((int(following),))
            # One frame further than any of the tracks may live.
            self.handle.registerTimer((taken + self.max_age + 2) * self.frame_ms)
        else:
            for t, held in active.items():
                if reached - held.frame > self.max_age:
                    self.ended.updateValue((t,), (held.frame,))
                    self.tracks.removeKey((t,))
        if rest:
            self.handle.registerTimer((min(rest) + 1) * self.frame_ms)
        yield _events([])

    def take(self, clip: int, frame: int, rows: list[tuple], active: dict[int, _Track], ended: list[int], following: int, out: list[tuple]) -> int:
        """One frame into the active tracks; adds its rows to ``out`` and gives the next free id."""
        gone = [t for t, track in active.items() if frame - track.frame > self.max_age]
        for t in gone:
            active.pop(t)
        took, following = greedy_frame(active, following, frame, [_Seen((clip, *r)) for r in rows])
        out += [(clip, frame, None, t, None, None, "track_killed") for t in sorted(gone + ended)]
        out += [(clip, frame, detection, track, cost, gap, "track_started" if cost is None else "matched") for detection, track, cost, gap in took]
        return following

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, max_age: int = 5, frame_ms: int = 1000, late: str = "0 seconds") -> DataFrame:
    """Tracks of a stream of detections: clip_id, frame, detection, track, cost, gap, event.

    ``detections`` has the columns of a detection, frames not negative; its
    event time is frame + 1 times ``frame_ms``, as a watermark starts at zero. A frame is taken once the stream's
    newest frame, of any clip, is ``late`` or more beyond it, and detections that come later than that are dropped, as Spark does with late
    rows. So the last frames wait until newer ones come. Rows with the event
    ``track_killed`` have no detection: they stand at the clip's first frame
    that is more than ``max_age`` after the track's last. All other rows are
    those of ``track_clips``. Null clips or frames take no part. The session
    must keep state in RocksDB.
    """
    b = F.col("box")
    flat = detections.where("clip_id is not null and frame is not null").select(
        F.col("clip_id").cast("long"), F.col("frame").cast("long"), F.col("detection").cast("long"), "x", "y", "foot_x", "foot_y", *[b[s].cast("double").alias(s) for s in bx.SIDES], "hist",
        F.timestamp_millis((F.col("frame") + 1) * frame_ms).alias("at"))
    held = flat.withWatermark("at", late)
    return held.groupBy("clip_id").transformWithStateInPandas(TrackClips(max_age, frame_ms), EVENTS, "Append", "EventTime")
