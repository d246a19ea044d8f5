"""The tracker on a stream against the tracker on a table."""

import pytest
from pyspark.sql import functions as F
from test_tracks import SCHEMA, _rows

from trackloom.operators import tracks
from trackloom.streaming.tracker import track_stream

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], STORE)
    spark.conf.set(names[1], "2")
    yield spark
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def _run(spark, folder, out, state, **more):
    stream = track_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder)), **more)
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


def _write(spark, rows, folder, mode="append"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode(mode).parquet(str(folder))


def test_stream_gives_the_tables_tracks(rocks, tmp_path):
    """Frames are cut across micro-batches, rows shuffled within them, and the query is stopped and started again from its checkpoint."""
    import random

    rows = _rows(5, clips=3, frames=24)
    rows = [r for r in rows if not (r[1] == 1 and 6 <= r[2] <= 14)]  # a clip that pauses for longer than a track lives
    end = [(10_000 + k, 99, 60 + k, 0, 1.0, 1.0, 1.0, 1.0, None, None, None, None) for k in range(2)]
    r = random.Random(1)
    parts = [[x for x in rows if x[2] // 5 == k] for k in range(5)]
    # A third of each part's newest frames come with the next part.
    for k in range(4):
        moved = [x for x in parts[k] if x[2] == 5 * k + 4 and r.random() < 0.4]
        parts[k] = [x for x in parts[k] if x not in moved]
        parts[k + 1] += moved
    for part in parts:
        r.shuffle(part)
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    for part in parts[:3]:
        _write(rocks, part, source)
    _run(rocks, source, out, state, late="3 seconds")
    early = rocks.read.parquet(str(out)).count()
    for part in (parts[3], parts[4], end[:1], end[1:]):
        _write(rocks, part, source)
    _run(rocks, source, out, state, late="3 seconds")
    got = rocks.read.parquet(str(out)).where("clip_id <> 99")
    assert 0 < early < got.count()
    table = rocks.createDataFrame(rows, SCHEMA)
    want = tracks.track_clips(table)
    flat = lambda d: sorted((x.clip_id, x.frame, x.detection, x.track, None if x.cost is None or x.cost != x.cost else round(x.cost, 9), x.gap) for x in d.collect())
    assert flat(got.where("event <> 'track_killed'")) == flat(want)
    events = sorted(map(tuple, got.where("event <> 'matched'").select("clip_id", "frame", "track", "event").collect()))
    assert events == sorted(map(tuple, tracks.track_events(want, table.select("clip_id", "frame")).collect()))
    assert any(e[3] == "track_killed" and e[0] == 1 for e in events)


def test_stream_of_nothing(rocks, tmp_path):
    _write(rocks, [], tmp_path / "in", "overwrite")
    _run(rocks, tmp_path / "in", tmp_path / "out", tmp_path / "state")
    assert rocks.read.schema("clip_id long").parquet(str(tmp_path / "out")).where(F.col("clip_id").isNotNull()).isEmpty()


class _Held(dict):
    """A state in memory that counts what is read and written."""

    def __init__(self, counts):
        super().__init__()
        self.counts, self.exists = counts, lambda: None in self

    def count(self, n=1):
        self.counts.append(n)

    def containsKey(self, k):
        self.count()
        return k in self

    def getValue(self, k):
        self.count()
        return (self[k][0],)

    def updateValue(self, k, v):
        self.count()
        self[k] = v

    def removeKey(self, k):
        self.count()
        self.pop(k, None)

    def keys(self):
        self.count(len(self) + 1)
        return iter(list(super().keys()))

    def iterator(self):
        self.count(len(self) + 1)
        return iter(list(self.items()))

    def get(self):
        return self[None]

    def update(self, v):
        self.count()
        self[None] = v


def test_state_is_read_in_proportion_to_the_frames():
    """All frames of a micro-batch wait at once; taking them must not look through them once a frame."""
    from types import SimpleNamespace

    import pandas as pd

    from trackloom.streaming.tracker import TrackClips

    def run(frames):
        counts, timers = [], set()
        held = lambda *_: _Held(counts)
        clips = TrackClips(5, 1000)
        clips.init(SimpleNamespace(getMapState=held, getValueState=held, registerTimer=timers.add))
        rows = pd.DataFrame([(1, f, f, 10.0, 10.0 + f % 3, *[None] * 6, None) for f in range(frames)], columns=list(tracks.COLUMNS))
        list(clips.handleInputRows((1,), iter([rows]), None))
        end, out = (frames + 100) * 1000, []
        while due := sorted(t for t in timers if t <= end):
            out += clips.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: end), SimpleNamespace(getExpiryTimeInMs=lambda: due[0]))
            timers.remove(due[0])
        out = pd.concat([o for o in out if len(o)])
        assert out.frame.tolist() == list(range(frames)) and set(out.track) == {1}
        return sum(counts)

    few, many = run(640), run(2560)
    assert many < 2560 and many < 5 * few
