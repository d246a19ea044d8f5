from trackloom.operators import joins


def test_nearest_of_more_than_ten_thousand_keyframes(spark):
    points = spark.range(0, 25_000, 1_000).selectExpr("id as frame")
    frames = spark.range(0, 25_000, 1, 1).selectExpr("id as key")
    got = joins.nearest_join(points, frames, "frame", "key", 5).collect()
    assert len(got) == 25 and all(r.keyframe == r.frame and r.frame_distance == 0 for r in got)
