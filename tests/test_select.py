from trackloom.operators import select


def test_best_paths(spark):
    rows = [(1, 0, "a", 0.5), (1, 1, "b", 0.9), (1, 2, "a", 0.95), (1, 3, "", 1.0), (1, 4, None, 1.0), (1, 5, "c", 0.9), (1, 6, "d", None), (2, 0, "e", None), (2, 1, "f", 0.0), (3, 0, None, 1.0)]
    got = select.best_paths(spark.createDataFrame(rows, "track_id long, at long, path string, score double"), ["track_id"], "path", "score", "at", 3)
    assert {r.track_id: r.paths for r in got.collect()} == {1: ["a", "b", "c"], 2: ["e", "f"], 3: []}


def test_numbers_and_even_picks_over_all_rows(spark):
    import numpy as np

    from trackloom.operators.components import Scratch

    rows = [(k * 7919 % 1009, k % 3) for k in range(1009)] + [(5, 9), (None, 1)]
    df = spark.createDataFrame(rows, "v int, w int").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    with Scratch(spark) as scratch:
        assert [(r.v, r.w) for r in sorted(select.numbered(scratch, df, ["v", "w"]).collect(), key=lambda r: r["at"])] == order
        for most in (1, 2, 3, 10, 77, 1010, 1011, 5000):
            want = order if len(order) <= most else [order[k] for k in np.linspace(0, len(order) - 1, most).round().astype(int)]
            got = [(r.v, r.w) for r in select.evenly_picked(scratch, df, ["v", "w"], most).collect()]
            assert sorted(got, key=str) == sorted(want, key=str)
        assert select.numbered(scratch, df.limit(0), ["v"]).isEmpty()


def test_all_names_of_a_number(spark):
    from trackloom.operators import votes

    roster = spark.createDataFrame([(1, 7, f"name {k:03}", k) for k in range(101)] + [(1, 8, "one", 1)], "team int, number int, name string, player_id int")
    got = votes.duplicates(roster).orderBy("place").collect()
    assert [(r.players, r.place, r.name) for r in got] == [(101, k + 1, f"name {k:03}") for k in range(101)]
