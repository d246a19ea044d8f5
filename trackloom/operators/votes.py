"""Number evidence: best attempts, frame collapse and conservative votes; roster lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def roster_index(roster: DataFrame) -> DataFrame:
    """Per number: players, teams, and whether it is ambiguous."""
    return roster.groupBy("number").agg(F.count(F.lit(1)).alias("players"), F.countDistinct("team").alias("teams")).withColumn("ambiguous", F.col("players") > 1)


def duplicates(roster: DataFrame) -> DataFrame:
    """Numbers that a team has given twice or more, a row for each player: team, number, players, place (from 1, by name) and name."""
    counts = roster.groupBy("team", "number").agg(F.count(F.lit(1)).alias("players")).where("players > 1")
    met = roster.join(counts, ["team", "number"])
    return met.select("team", "number", "players", F.row_number().over(Window.partitionBy("team", "number").orderBy("name", "player_id")).alias("place"), "name")


def shared_numbers(roster: DataFrame) -> DataFrame:
    """Numbers of more than one team: number, teams, players."""
    return roster.groupBy("number").agg(F.countDistinct("team").alias("teams"), F.count(F.lit(1)).alias("players")).where("teams > 1")


def resolve(lookups: DataFrame, roster: DataFrame) -> DataFrame:
    """Status of (lookup_id, team, number): invalid_number, team_not_found, number_not_found, ambiguous or resolved, and how sure that is; candidate_count is null for the first two."""
    counts = roster.groupBy("team", "number").agg(F.count(F.lit(1)).alias("_n"), F.min("player_id").alias("_one"))
    teams = roster.select(F.col("team").alias("_team")).distinct()
    met = lookups.join(counts, ["team", "number"], "left").join(teams, F.col("team") == F.col("_team"), "left")
    status = F.when(F.col("number").isNull() | ~F.col("number").between(0, 99), "invalid_number").when(F.col("_team").isNull(), "team_not_found").when(F.col("_n").isNull(), "number_not_found").when(F.col("_n") > 1, "ambiguous").otherwise("resolved")
    sure = F.when(F.col("status") == "resolved", "exact_roster_lookup").when(F.col("status") == "ambiguous", "ambiguous").otherwise("none")
    return met.withColumn("status", status).select("lookup_id", "team", "number", "status", sure.alias("confidence"), F.when(~F.col("status").isin("invalid_number", "team_not_found"), F.coalesce("_n", F.lit(0))).alias("candidate_count"), F.when(F.col("status") == "resolved", F.col("_one")).alias("player_id"))


def supported_vote(attempts: DataFrame, keys: list[str], zero_is_null: bool = False, ordinal: str | None = None) -> DataFrame:
    """One representative attempt per group: per track and frame, or (``zero_is_null``) per crop.

    Two-digit numbers with two attempts go before all others; then attempts,
    summed confidence (null: 0.25) and the smaller text decide. ``consensus`` is
    the winner's share of attempts. Of the winner's rows the one of highest
    confidence, then readiness, then smallest ``ordinal`` stands. Groups
    without a number have no row.
    """
    confidence = F.when(F.col("confidence") != 0, F.col("confidence")) if zero_is_null else F.col("confidence")
    each, all_ = Window.partitionBy(*keys, "number"), Window.partitionBy(*keys)
    own = attempts.where(F.length("number") > 0).withColumns({"n": F.count(F.lit(1)).over(each), "_sum": F.round(F.sum(F.coalesce(confidence, F.lit(0.25))).over(each), 9), "_all": F.count(F.lit(1)).over(all_)})
    supported = (F.length("number") == 2) & (F.col("n") >= 2)
    order = [F.desc(supported), F.desc("n"), F.desc("_sum"), F.col("number"), F.desc(F.coalesce("confidence", F.lit(0.0)))]
    order += [] if zero_is_null else [F.desc(F.coalesce("readiness", F.lit(0.0)))]
    order += [F.col(ordinal)] if ordinal else []
    best = own.withColumn("_at", F.row_number().over(all_.orderBy(*order))).where("_at = 1")
    return best.withColumn("consensus", F.col("n") / F.col("_all")).withColumnRenamed("_sum", "confidence_sum").drop("_at", "_all")


def collapsed_frames(attempts: DataFrame, ordinal: str) -> DataFrame:
    """One row per track and frame: the supported vote, or where no attempt has a number the one of best readiness, with n 0 and consensus 0."""
    keys = ["track_id", "frame"]
    voted = supported_vote(attempts, keys, ordinal=ordinal)
    w = Window.partitionBy(*keys)
    rest = attempts.withColumns({"_known": F.max((F.coalesce(F.length("number"), F.lit(0)) > 0).cast("int")).over(w), "_at": F.row_number().over(w.orderBy(F.desc(F.coalesce("readiness", F.lit(0.0))), ordinal))}).where("_known = 0 and _at = 1").drop("_known", "_at")
    return voted.unionByName(rest.withColumns({"n": F.lit(0).cast("long"), "confidence_sum": F.lit(0.0), "consensus": F.lit(0.0)}))


def best_attempts(attempts: DataFrame, keys: list[str], ordinal: str, least: float = 0.45) -> DataFrame:
    """One row per crop: its representative attempt, n, consensus, status and reason.

    Without any one- or two-digit number the attempt of highest confidence that
    has digits stands (``digits`` of the attempt, else its number); a crop
    without digits is unreadable.
    """
    voted = supported_vote(attempts, keys, zero_is_null=True, ordinal=ordinal).withColumn("_rank", F.lit(1))
    digits = F.col("digits") if "digits" in attempts.columns else F.col("number")
    w = Window.partitionBy(*keys)
    known = F.max((F.coalesce(F.length("number"), F.lit(0)) > 0).cast("int")).over(w)
    some = F.coalesce(F.length(digits), F.lit(0)) > 0
    rest = attempts.withColumns({"_known": known, "_rank": F.when(some, 2).otherwise(3)}).withColumn("_at", F.row_number().over(w.orderBy("_rank", F.desc(F.coalesce("confidence", F.lit(0.0))), ordinal))).where("_known = 0 and _at = 1").drop("_known", "_at")
    both = voted.unionByName(rest.withColumns({"n": F.lit(0).cast("long"), "confidence_sum": F.lit(0.0), "consensus": F.lit(0.0)}))
    sure = F.coalesce(F.col("confidence") >= least, F.lit(False))
    c = F.col("_rank")
    status = F.when(c == 3, "unreadable").when((c == 1) & (F.length("number") == 2) & sure, "readable").otherwise("uncertain")
    reason = (
        F.when(c == 3, "No preprocessing variant returned digits.").when(c == 2, "OCR digits did not form a one- or two-digit number.")
        .when(F.length("number") == 1, "One digit detected; repeated track evidence is required because it may be partial.").when(~sure, "Two digits detected below the OCR confidence threshold.")
        .otherwise("Two-digit crop evidence; track consensus is still required."))
    return both.withColumns({"status": status, "reason": reason}).drop("_rank")


def _ranked(rows: DataFrame, weight: Column, ties: list[Column]) -> DataFrame:
    """Leading number per track; a one-digit number contained in a two-digit candidate weighs a quarter."""
    track = Window.partitionBy("track_id")
    named = rows.where(F.length("number") > 0).groupBy("track_id", "number").agg(F.count(F.lit(1)).alias("votes"), F.sum(weight).alias("weight"))
    longer = F.collect_set(F.when(F.length("number") == 2, F.col("number"))).over(track)
    partial = (F.length("number") == 1) & F.exists(longer, lambda c: c.contains(F.col("number")))
    weighed = named.withColumn("partial", partial).withColumn("weight", F.col("weight") * F.when(F.col("partial"), 0.25).otherwise(1.0))
    ranked = weighed.withColumns({"total": F.sum("weight").over(track), "usable": F.sum("votes").over(track), "_at": F.row_number().over(track.orderBy(F.desc("weight"), *ties, F.col("number")))})
    return ranked.where("_at = 1").withColumn("consensus", F.when(F.col("total") != 0, F.col("weight") / F.col("total")).otherwise(0.0))


#: What is said of a track's number.
REASONS = {
    "no_engine": "OCR engine unavailable; number regions were generated for later processing.",
    "none": "No crop produced a valid one- or two-digit candidate.",
    "partial": "Leading one-digit evidence may be a partial reading of a two-digit candidate.",
    "few": "Insufficient repeated observations for the leading candidate.",
    "split": "Candidate predictions are inconsistent across selected frames.",
    "accepted": "Repeated, consistent track-level number evidence.",
}


def aggregate_tracks(attempts: DataFrame, two_digits: int = 2, one_digit: int = 3, least: float = 0.67, engine: bool = True, ordinal: str | None = None) -> DataFrame:
    """Per track of attempts (track_id, frame, number, confidence, readiness): leading number, votes, weight, consensus, accepted_number and reason.

    Frames count once. A null confidence weighs 0.3, readiness a tenth at
    least. Tracks without a number have a null one.
    """
    rows = supported_vote(attempts, ["track_id", "frame"], ordinal=ordinal)
    weight = F.coalesce("confidence", F.lit(0.3)) * F.greatest(F.lit(0.1), F.coalesce("readiness", F.lit(0.0)))
    best = _ranked(rows, weight, [F.desc("votes")])
    known = attempts.select("track_id").distinct().join(best, "track_id", "left")
    needed = F.when(F.length("number") == 1, one_digit).otherwise(two_digits)
    reason = F.when(F.lit(not engine), REASONS["no_engine"]).when(F.col("number").isNull(), REASONS["none"]).when(F.col("partial"), REASONS["partial"]).when(F.col("votes") < needed, REASONS["few"]).when(F.col("consensus") < least, REASONS["split"]).otherwise(REASONS["accepted"])
    taken = F.coalesce(~F.col("partial") & (F.col("votes") >= needed) & (F.col("consensus") >= least), F.lit(False))
    return known.select("track_id", "number", F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("consensus", F.lit(0.0)).alias("consensus"), F.when(taken, F.col("number")).alias("accepted_number"), reason.alias("reason"))


def simple_votes(attempts: DataFrame, minimum: int = 2, least: float = 0.67) -> DataFrame:
    """Per track of attempts (track_id, number, confidence): leading number, consensus, usable attempts, status and, where accepted, the number. A null confidence weighs 1; all usable attempts count towards ``minimum``."""
    best = _ranked(attempts, F.coalesce("confidence", F.lit(1.0)), [])
    known = attempts.groupBy("track_id").agg(F.count(F.lit(1)).alias("crops")).join(best, "track_id", "left")
    taken = F.coalesce((F.col("usable") >= minimum) & (F.col("consensus") >= least), F.lit(False))
    return known.select("track_id", F.col("number").alias("leading"), F.round(F.coalesce("consensus", F.lit(0.0)), 6).alias("consensus"), "crops", F.coalesce("usable", F.lit(0)).alias("usable"), F.when(taken, "accepted").otherwise("uncertain").alias("status"), F.when(taken, F.col("number")).alias("number"))


def ranked_evidence(attempts: DataFrame, n: int, ordinal: str) -> DataFrame:
    """The n attempts per track with most to say: those with a number first, then confidence, then readiness."""
    order = [F.coalesce(F.length("number"), F.lit(0)) == 0, F.desc(F.coalesce("confidence", F.lit(0.0))), F.desc("readiness"), F.col(ordinal)]
    return attempts.withColumn("rank", F.row_number().over(Window.partitionBy("track_id").orderBy(*order))).where(F.col("rank") <= n)


def number_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and number the highest confidence; the consensus stands in where there is none, and zero for both."""
    return rows.where(F.col("number").isNotNull()).groupBy(*keys, "number").agg(F.max(F.coalesce("confidence", "consensus", F.lit(0.0))).alias("score"))


def number_status(number: Column, leading: Column, evaluated: Column) -> Column:
    """accepted, candidate_low_confidence, no_candidate, or not_evaluated where there is no prediction."""
    return F.when(~evaluated, "not_evaluated").when(number.isNotNull(), "accepted").when(leading.isNotNull(), "candidate_low_confidence").otherwise("no_candidate")
