"""Trackers and merges against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import tracks

SCHEMA = "id long, clip_id long, frame long, detection long, x double, y double, foot_x double, foot_y double, box struct<x0: double, y0: double, x1: double, y1: double>, p3 array<double>, hist array<double>, extra int"


def _rows(seed: int, clips: int = 4, frames: int = 30):
    r, out = random.Random(seed), []
    for clip in range(clips):
        things = [(r.uniform(0, 900), r.uniform(0, 500), r.uniform(-30, 30), r.uniform(-20, 20), [r.random() for _ in range(4)]) for _ in range(6)]
        for frame in range(frames):
            if r.random() < 0.1:
                continue
            k = 0
            for x, y, vx, vy, hue in things:
                if r.random() < 0.3:
                    continue
                px, py = x + vx * frame + r.gauss(0, 6), y + vy * frame + r.gauss(0, 6)
                some = lambda v, p=0.12: None if r.random() < p else v
                foot = some((px, py + 20))
                out.append((len(out), clip, frame, k, *(some((px, py)) or (None, None)), *(foot or (None, None)), some((px - 8, py - 20, px + 8, py + 20)), some([px / 100, py / 100, 1.0]), some([h + r.random() / 5 for h in hue]), 7))
                k += 1
    return out


def _apart(a, b):
    return None if None in (*a, *b) else math.dist(a, b)


def _area(b):
    return (b[2] - b[0] + 1) * (b[3] - b[1] + 1)


def _iou(a, b):
    if a is None or b is None:
        return 0.0
    w, h = min(a[2], b[2]) - max(a[0], b[0]) + 1, min(a[3], b[3]) - max(a[1], b[1]) + 1
    both = max(0, w) * max(0, h)
    return both / (_area(a) + _area(b) - both)


def _cos(a, b):
    if a is None or b is None:
        return None
    n = math.hypot(*a) * math.hypot(*b)
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n > 1e-9 else None


def _point(d, foot):
    return (d[6], d[7]) if foot else (d[4], d[5])


def _ahead(members, frame, foot):
    seen = [(m[2], _point(m, foot)) for m in members if None not in _point(m, foot)]
    if not seen:
        return (None, None)
    f1, p1 = seen[-1]
    if len(seen) < 2:
        return p1
    f0, p0 = seen[-2]
    return tuple(b + (b - a) / max(1, f1 - f0) * max(1, frame - f1) for a, b in zip(p0, p1, strict=True))


def _mean(members):
    hists = [m[10] for m in members if m[10] is not None]
    if not hists:
        return None
    mean = [sum(c) / len(hists) for c in zip(*hists, strict=True)]
    n = math.hypot(*mean)
    return [v / n for v in mean] if n > 1e-9 else None


def _ttl_cost(members, colour, d):
    last = members[-1]
    scale = 1 + 0.2 * max(0, max(1, d[2] - last[2]) - 1)
    c, f = (_apart(_ahead(members, d[2], foot), _point(d, foot)) for foot in (False, True))
    iou, alike = _iou(last[8], d[8]), _cos(colour, d[10])
    gate = c is not None and c <= 150 * scale or f is not None and f <= 175 * scale or iou >= 0.005 or alike is not None and alike >= 0.82 and (c is None or c <= 150 * scale * 1.35)
    if not gate:
        return None
    terms = [(0.8, 1 - iou)]
    terms += [] if c is None else [(1.2, min(c / (150 * scale), 3))]
    terms += [] if f is None else [(1.2, min(f / (175 * scale), 3))]
    if last[8] and d[8]:
        a, b = _area(last[8]), _area(d[8])
        terms.append((0.45, 1 - min(a, b) / max(a, b)))
    terms += [] if alike is None else [(0.55, 1 - max(0, min(1, alike)))]
    cost = sum(w * v for w, v in terms) / sum(w for w, _ in terms)
    return cost if cost <= 1.45 else None


def _plain_tracks(rows, age=5):
    out = {}
    for clip in sorted({r[1] for r in rows}):
        known, following = {}, 1
        for frame in sorted({r[2] for r in rows if r[1] == clip}):
            found = sorted((r for r in rows if r[1:3] == (clip, frame)), key=lambda r: r[3])
            pairs = []
            for i, (members, colour) in sorted(known.items()):
                if frame - members[-1][2] <= age:
                    pairs += [(c, i, k) for k, d in enumerate(found) if (c := _ttl_cost(members, colour, d)) is not None]
            used, owner = set(), {}
            for c, i, k in sorted(pairs):
                if i not in used and k not in owner:
                    owner[k] = i
                    used.add(i)
            for k, d in enumerate(found):
                if k in owner:
                    members = known[owner[k]][0] + [d]
                    known[owner[k]] = (members, _mean(members))
                else:
                    owner[k], following = following, following + 1
                    known[owner[k]] = ([d], d[10])
                out[d[1:4]] = owner[k]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_tracker_and_merges(spark, seed):
    rows = _rows(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assigned = tracks.track_clips(docs)
    got = {(r.clip_id, r.frame, r.detection): r.track for r in assigned.collect()}
    want = _plain_tracks(rows)
    assert got == want and len({(k[0], v) for k, v in want.items()}) > 20

    groups = {}
    for r in sorted(rows, key=lambda r: r[:4]):
        groups.setdefault((r[1], want[r[1:4]]), []).append(r)
    merges = []
    for clip in sorted({c for c, _ in groups}):
        pool = {t: m for (c, t), m in groups.items() if c == clip}
        while True:
            best = None
            for a in sorted(pool):
                for b in sorted(pool):
                    gap = pool[b][0][2] - pool[a][-1][2]
                    if a == b or not 1 <= gap <= 8:
                        continue
                    ways = [_apart(_point(pool[a][-1], f), _point(pool[b][0], f)) for f in (False, True)] + [_apart(_ahead(pool[a], pool[b][0][2], f), _point(pool[b][0], f)) for f in (False, True)]
                    ways, alike = [w for w in ways if w is not None], _cos(_mean(pool[a]), _mean(pool[b]))
                    if not ways or min(ways) > 170 or alike is not None and alike < 0.58:
                        continue
                    cost = min(ways) / 170 + 0.08 * gap + (0 if alike is None else 0.35 * (1 - alike))
                    if best is None or cost < best[0] - 1e-12:
                        best = (cost, a, b)
            if best is None:
                break
            merges.append((clip, best[1], best[2], round(best[0], 6)))
            pool[best[1]] = sorted(pool[best[1]] + pool.pop(best[2]), key=lambda r: r[2])
    members = docs.join(assigned.select("clip_id", "frame", "detection", "track"), ["clip_id", "frame", "detection"])
    found = tracks.merge_fragments(tracks.track_ends(members))
    assert [(r.clip_id, r.target, r.track, round(r.cost, 6)) for r in found.orderBy("clip_id", "step").collect()] == merges
    assert merges or seed == 2
    final = {(r.clip_id, r.track): r.final_track for r in tracks.merged_tracks(assigned, found).collect()}
    into = {(c, b): a for c, a, b, _ in merges}
    for (clip, track), end in final.items():
        while (clip, track) in into:
            track = into[clip, track]
        assert track == end


def _one_frame_cost(a, b):
    c, f, iou = _apart((a[4], a[5]), (b[4], b[5])), _apart((a[6], a[7]), (b[6], b[7])), _iou(a[8], b[8])
    deep = None if a[9] is None or b[9] is None else math.dist(a[9], b[9])
    if not (c is not None and c <= 130 or f is not None and f <= 150 or iou >= 0.01 or deep is not None and deep <= 0.45):
        return None
    part = lambda v, most: 0 if v is None else min(v / most, 3)
    cost = (part(c, 130) + part(f, 150) + 0.7 * (1 - iou) + 1.2 * (0.85 if deep is None else min(deep / 0.45, 3))) / 3.9
    return cost if cost <= 2.85 else None


def test_memory_of_one_frame(spark):
    rows = _rows(3)
    want = {}
    for clip in range(4):
        before, last, following = {}, None, 1
        for frame in sorted({r[2] for r in rows if r[1] == clip}):
            found = [r for r in rows if r[1:3] == (clip, frame)]
            old = [r for r in rows if r[1:3] == (clip, frame - 1)] if last == frame - 1 else []
            pairs = sorted((c, a[3], b[3]) for a in old for b in found if (c := _one_frame_cost(a, b)) is not None)
            used, now = set(), {}
            for _, a, b in pairs:
                if a not in used and b not in now:
                    now[b] = before[a]
                    used.add(a)
            for b in found:
                if b[3] not in now:
                    now[b[3]], following = following, following + 1
                want[b[1:4]] = now[b[3]]
            before, last = now, frame
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.clip_id, r.frame, r.detection): r.track for r in tracks.previous_frame_tracks(docs).collect()}
    assert got == want


def test_trackers_on_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assigned = tracks.track_clips(none)
    assert assigned.count() == 0 and tracks.previous_frame_tracks(none).count() == 0
    members = none.join(assigned.select("clip_id", "frame", "detection", "track"), ["clip_id", "frame", "detection"])
    assert tracks.merge_fragments(tracks.track_ends(members)).count() == 0


def test_events_of_tracks(spark):
    seen = spark.createDataFrame([(0, 1, 5), (0, 3, 5), (0, 12, 6), (1, 1, 9)], "clip_id long, frame long, track long")
    frames = spark.createDataFrame([(0, f) for f in (1, 3, 8, 9, 12, 14)] + [(1, f) for f in (1, 5)], "clip_id long, frame long")
    got = sorted(map(tuple, tracks.track_events(seen, frames).collect()))
    assert got == [(0, 1, 5, "track_started"), (0, 9, 5, "track_killed"), (0, 12, 6, "track_started"), (1, 1, 9, "track_started")]


def test_motion_counts_a_frame_at_least(spark):
    rows = spark.createDataFrame([(1, 4, 1, 0.0, 0.0), (1, 4, 2, 3.0, 4.0), (2, 1, 3, None, 1.0)], "track_id long, frame long, event_id long, x double, y double")
    got = {r.event_id: (r.step, r.vx) for r in tracks.motion(rows).collect()}
    assert got == {1: (None, None), 2: (5.0, 3.0), 3: (None, None)}
    assert tracks.predicted(rows, F.lit(6)).where("event_id = 2").first().at_x == 9.0


def test_crowds_give_the_same_costs(spark, monkeypatch):
    """By cells, as in crowded frames, or all at once, as in others."""
    rows = _rows(9, clips=2, frames=12)
    df = spark.createDataFrame(rows, SCHEMA)
    at = ["clip_id", "_f"]
    sides = df.withColumn("_f", F.col("frame") + 1), df.withColumn("_f", F.col("frame"))
    few = sorted(map(tuple, tracks.associations(*sides, at).collect()))
    monkeypatch.setattr(tracks, "FEW_SEEN", 0)
    assert sorted(map(tuple, tracks.associations(*sides, at).collect())) == few
    assert len(few) > 50 and len({r[:2] for r in few}) == len(few)


def test_ends_of_many_tracks_need_one_pass(spark, monkeypatch):
    """Ends are found block by block, and no window looks ahead row by row over a clip's tracks."""
    rng = random.Random(5)
    seen = [(c, f, t) for c in (0, 1) for t in range(60) for f in (rng.randrange(-40, 90),)]
    held = sorted({(c, rng.randrange(-60, 100)) for c in (0, 1) for _ in range(50)})
    want = sorted((c, min(g), t, "track_killed") for c, f, t in seen if (g := [at for k, at in held if k == c and at > f + 5]))
    for block in (4, 1024):
        monkeypatch.setattr(tracks.joins, "BLOCK", block)
        e = tracks.track_events(spark.createDataFrame(seen, "clip_id long, frame long, track long"), spark.createDataFrame(held, "clip_id long, frame long"))
        assert sorted(map(tuple, e.where("event = 'track_killed'").collect())) == want
        assert "unboundedfollowing" not in e._jdf.queryExecution().toString().lower()


def test_crowds_in_few_cells_are_not_repeated_per_cell(spark, monkeypatch):
    """A frame whose pairs are mostly within a gate meets as a whole, in pieces, and each side's cheapest are found without keeping the pairs."""
    rows = _rows(9, clips=2, frames=12)
    df = spark.createDataFrame(rows, SCHEMA)
    sides = df.withColumn("_f", F.col("frame") + 1), df.withColumn("_f", F.col("frame")), ["clip_id", "_f"]
    plain = sorted(map(tuple, tracks.associations(*sides).collect()))
    rounded = [(a, b, round(c, 9)) for a, b, c in plain]
    first = lambda k: {min((r for r in rounded if r[k] == i), key=lambda r: (r[2], r[1 - k])) for i in {r[k] for r in rounded}}
    monkeypatch.setattr(tracks, "FEW_SEEN", 0)
    monkeypatch.setattr(tracks, "PIECE", 3)
    for cells in (0, 10**9):
        monkeypatch.setattr(tracks, "FEW_CELLS", cells)
        assert sorted(map(tuple, tracks.associations(*sides).collect())) == plain
        best = tracks.mutual_associations(*sides)
        assert sorted((a, b, round(c, 9)) for a, b, c in best.collect()) == sorted(first(0) & first(1))


def test_merge_query_runs_the_tracker_once(spark, monkeypatch):
    from trackloom.plans import tracking

    seen, plain = spark.sparkContext.accumulator(0), tracks.track_clips

    def counted(detections):
        def count(parts):
            for part in parts:
                seen.add(len(part))
                yield part

        return plain(detections).mapInPandas(count, tracks.ASSIGNED)

    monkeypatch.setattr(tracks, "track_clips", counted)
    assert tracking.track_merges(spark, "/root/testdata/sf0.001").count() > 0
    assert seen.value == 1000


def test_few_pairs_cost_what_many_do(monkeypatch):
    import random

    r = random.Random(3)

    def seen(frame, k):
        some = lambda share, *v: v if r.random() < share else (None,) * len(v)
        x, y = r.choice([r.uniform(0, 400), float(r.randrange(0, 300, 10))]), r.uniform(0, 100)
        return tracks._Seen((1, frame, k, *some(0.9, x, y), *some(0.8, x, y + 4), *some(0.9, x - 4 - r.choice([0, 3, -9]), y - 9, x + 4, y + 9), *some(0.8, [r.random() for _ in range(3)])))

    for _ in range(200):
        active = [tracks._Track(k + 1, seen(r.randrange(3), k)) for k in range(r.randrange(1, 12))]
        for t in active:
            if r.random() < 0.6:
                t.add(seen(r.randrange(3, 6), 9))
        found = [seen(6, k) for k in range(r.randrange(1, 8))]
        few = tracks._costs(active, found, 6)
        with monkeypatch.context() as m:
            m.setattr(tracks, "FEW", 0)
            assert few == tracks._costs(active, found, 6)


def test_cheapest_of_pieces(monkeypatch):
    """Two pieces held against each other leave few pairs, with each detection's cheapest among them, ties to the smaller ids."""
    import numpy as np

    r = np.random.default_rng(5)
    monkeypatch.setattr(tracks, "_ROWS", 7)

    def side(n):
        x, y = r.integers(0, 40, n) * 20.0, r.integers(0, 4, n) * 20.0
        v = np.stack([x, y, x, y + 4, x - 4, y - 9, x + 4, y + 9, x / 100, y / 100, np.ones(n), np.full(n, np.nan)], axis=1)
        for columns in ((0, 1), (2, 3), (4, 5, 6, 7), (8, 9, 10)):
            for k in columns:
                v[r.random(n) < 0.1, k] = np.nan
        return np.concatenate([v, np.isnan(v)], axis=1)

    a, b = side(90), side(80)
    ids = r.permutation(500)[:90], r.permutation(500)[:80]
    with np.errstate(all="ignore"):
        cost, gates = tracks._pair_costs(a[:, :12], b[:, :12], a[:, 12:] > 0, b[:, 12:] > 0)
        near = np.logical_or.reduce([np.broadcast_to(d <= most, cost.shape) for d, most in gates]) & (cost <= 2.85)
    order = sorted((round(float(cost[i, j]), 9), int(ids[0][i]), int(ids[1][j])) for i, j in zip(*np.nonzero(near), strict=True))
    want = {min((x for x in order if x[k] == i), key=lambda x: (x[0], x[3 - k]))[1:] for k in (1, 2) for i in {x[k] for x in order}}
    got = list(zip(*(v.tolist() for v in tracks._cheapest([a, b], list(ids), 2.85, 2e-9)), strict=True))
    sorted_got = set(got)
    assert len(got) == len(sorted_got) and sorted_got <= {x[1:] for x in order}
    assert want <= sorted_got and len(got) < 0.2 * len(order)
