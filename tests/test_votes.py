from trackloom.operators import votes

SCHEMA = "track_id long, frame long, number string, confidence double, readiness double"


def test_frame_and_track_votes(spark):
    rows = [(1, 1, "7", 0.9, 1.0)] * 5 + [(1, 1, "27", 0.5, 1.0)] * 2  # two-digit pool
    rows += [(2, 1, "31", 0.9, 1.0), (2, 1, "42", 0.5, 1.0), (2, 1, "42", 0.5, 1.0), (2, 1, "31", 0.01, 1.0)]  # summed confidence
    rows += [(3, f, "8", 0.9, 1.0) for f in (1, 2)] + [(4, f, "8", 0.9, 1.0) for f in (1, 2, 3)]  # three votes for one digit
    rows += [(5, f, "12", 0.9, 1.0) for f in (1, 2)] + [(5, f, "34", 0.9, 0.0) for f in (3, 4, 5)]  # readiness
    rows += [(6, 1, None, None, None)]
    attempts = spark.createDataFrame(rows, SCHEMA)
    first = {r.track_id: r.number for r in votes.supported_vote(attempts, ["track_id", "frame"]).where("frame = 1").collect()}
    assert first[1] == "27" and first[2] == "42"
    says = {v: k for k, v in votes.REASONS.items()}
    got = {r.track_id: (r.number, says[r.reason], r.accepted_number) for r in votes.aggregate_tracks(attempts).collect()}
    assert got == {1: ("27", "few", None), 2: ("42", "few", None), 3: ("8", "few", None), 4: ("8", "accepted", "8"), 5: ("12", "accepted", "12"), 6: (None, "none", None)}


def test_simple_votes_and_best_attempt(spark):
    rows = [(1, 1, "1", 1.2, None), (1, 1, "12", 1.0, None), (2, 1, "5", None, None), (3, 1, None, 0.9, None)]
    got = {r.track_id: (r.leading, r.consensus, r.status) for r in votes.simple_votes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ("12", 0.769231, "accepted"), 2: ("5", 1.0, "uncertain"), 3: (None, 0.0, "uncertain")}
    rows = [(1, 1, "99", 0.99, None)] + [(1, 1, "23", 0.0, None)] * 3
    best = votes.supported_vote(spark.createDataFrame(rows, SCHEMA), ["track_id", "frame"], zero_is_null=True).first()
    assert (best.number, best.n, best.consensus, best.confidence_sum) == ("23", 3, 0.75, 0.75)
