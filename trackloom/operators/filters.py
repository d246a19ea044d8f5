"""Rule filters and classifiers. Reasons are arrays in a fixed order; kept means that there is none. Names and bounds are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import distance, reasons

LABELS = ("likely_player", "likely_referee", "likely_non_player", "low_quality", "uncertain")


def mask_reasons(mode: Column, area: Column, centroid_y: Column, foot_y: Column, in_polygon: Column, has_polygon: Column, green: Column, bench: float, low: float, high: float, least: int = 35) -> Column:
    """Why a mask is dropped. Modes: y_threshold, field_polygon, combined, green_foot_point; bounds in pixels. A mask without pixels has null points."""
    line, surface = mode.isin("y_threshold", "combined"), mode.isin("field_polygon", "combined")
    in_band = F.coalesce(foot_y.between(low, high), F.lit(False))
    return reasons(
        (centroid_y.isNull() | foot_y.isNull(), "empty_mask"),
        (area < least, "too_small"),
        (centroid_y < bench, "centroid_in_bench_strip"),
        (line & (foot_y < low), "bottom_point_above_field_cutoff"),
        (surface & has_polygon & ~F.coalesce(in_polygon, F.lit(False)), "bottom_point_outside_field_polygon"),
        (surface & ~has_polygon & ~in_band, "bottom_point_outside_field_y_band"),
        ((mode == "green_foot_point") & ~F.coalesce(green, F.lit(False)), "foot_point_not_on_green_surface"),
    )


def enough_points(points: DataFrame, least: int) -> DataFrame:
    """Points of tracks that have ``least`` of them, by an aggregate and a semi join, so that a long track isn't gathered in one task."""
    tracks = points.groupBy("track_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("track_id")
    return points.join(tracks, "track_id", "left_semi")


def near_edge(x: Column, y: Column, width: float, height: float, margin: float = 0.08) -> Column:
    """Whether a point lies within a margin of an edge; null without a point."""
    mx, my = width * margin, height * margin
    return (x <= mx) | (x >= width - mx) | (y <= my) | (y >= height - my)


def track_evidence(detections: DataFrame, projected: DataFrame, width: float, height: float, margin: float = 0.08) -> DataFrame:
    """Per track what its quality is judged by.

    ``detections``: track_id, frame, at (order within a frame), area, foot_x,
    foot_y, centroid_x, centroid_y. ``projected``: track_id, frame, at, x, y,
    inside. Speeds are distances between rows that follow each other whatever
    frames lie between; those of foot points, or of centroids where a track
    has none.
    """
    w = Window.partitionBy("track_id").orderBy("frame", "at")
    gone = lambda x, y: distance(F.col(x), F.col(y), F.lag(x).over(w), F.lag(y).over(w))
    steps = detections.withColumns({"foot_step": gone("foot_x", "foot_y"), "centre_step": gone("centroid_x", "centroid_y")})
    own = steps.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("frame_count"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.avg("area").alias("average_bbox_area"), F.var_pop("area").alias("bbox_area_variance"),
        F.count("foot_step").alias("_feet"), F.avg("foot_step").alias("_foot_mean"), F.max("foot_step").alias("_foot_max"), F.avg("centre_step").alias("_centre_mean"), F.max("centre_step").alias("_centre_max"))
    own = own.withColumns({
        "missing_frames": F.greatest(F.lit(0), F.col("last_frame") - F.col("first_frame") + 1 - F.col("frame_count")),
        "average_image_speed": F.when(F.col("_feet") > 0, F.col("_foot_mean")).otherwise(F.col("_centre_mean")),
        "maximum_image_jump": F.coalesce(F.when(F.col("_feet") > 0, F.col("_foot_max")).otherwise(F.col("_centre_max")), F.lit(0.0))}).drop("_feet", "_foot_mean", "_foot_max", "_centre_mean", "_centre_max")
    within = projected.where("inside").withColumns({"step": gone("x", "y"), "edge": near_edge(F.col("x"), F.col("y"), width, height, margin).cast("double")})
    field = within.groupBy("track_id").agg(F.count(F.lit(1)).alias("projected_inside"), F.avg("step").alias("average_field_speed"), F.max("step").alias("_field_max"), F.avg("edge").alias("near_edge_share"))
    seen = projected.groupBy("track_id").agg(F.count(F.lit(1)).alias("projected_points"))
    met = own.join(seen, "track_id", "left").join(field, "track_id", "left").na.fill(0, ["projected_points", "projected_inside"])
    least = F.greatest(F.lit(1), F.col("projected_points"))
    return met.withColumns({
        "maximum_field_jump": F.coalesce("_field_max", F.lit(0.0)), "inside_share": F.col("projected_inside") / least,
        "outside_share": (F.col("projected_points") - F.col("projected_inside")) / least}).drop("_field_max")


def judged_tracks(evidence: DataFrame, baseline: Column, least_frames: int = 3, player_frames: int = 4, image_jump: float = 260.0, field_jump: float = 190.0, edge_share: float = 0.70) -> DataFrame:
    """``evidence`` (of ``track_evidence``, with sharpness, stripe_score, mean_saturation, high_saturation, gray_share, dark_share; all null without a crop) and flags, label, confidence and reasons.

    ``baseline``: the median of mean saturations.
    """
    c = F.col
    speed = F.coalesce("average_image_speed", F.lit(-1.0))
    quality = reasons(
        (c("frame_count") < least_frames, "too_few_frames"), (c("outside_share") > 0.50, "mostly_outside_field_bounds"), (c("maximum_image_jump") > image_jump, "unrealistic_image_jump"),
        (c("maximum_field_jump") > field_jump, "unrealistic_field_jump"), (c("missing_frames") >= F.greatest(F.lit(3), F.floor(c("frame_count") / 2)), "many_missing_frames"), (c("sharpness") < 18.0, "poor_crop_quality"))
    referee = reasons(
        (c("stripe_score") >= 0.62, "striped_low_saturation_crop"), (c("mean_saturation") < F.least(F.lit(55.0), baseline * 0.65), "low_team_color_saturation"),
        ((c("gray_share") > 0.62) & (c("dark_share") > 0.12), "black_white_gray_appearance"))
    other = reasons((c("near_edge_share") >= edge_share, "frequent_boards_sideline_region"), ((speed >= 0) & (speed < 3.0) & (c("frame_count") >= player_frames), "very_low_motion"))
    t = evidence.withColumns({"quality_flags": quality, "referee_flags": referee, "non_player_flags": other})
    q, r, k = (F.size(f) for f in ("quality_flags", "referee_flags", "non_player_flags"))
    low = (q >= 2) | (F.array_contains("quality_flags", "too_few_frames") & ((c("outside_share") > 0.25) | (c("maximum_image_jump") > image_jump)))
    player = (c("frame_count") >= player_frames) & (c("inside_share") >= 0.80) & (c("maximum_image_jump") <= image_jump) & (c("maximum_field_jump") <= field_jump) & (r < 2)
    colour, moves = F.coalesce(c("high_saturation") > 0.12, F.lit(False)), speed >= 5.0
    rest = F.when(q > 0, c("quality_flags")).when(r > 0, c("referee_flags")).when(k > 0, c("non_player_flags")).otherwise(F.array(F.lit("insufficient_strong_evidence")))
    cases = [
        (low, "low_quality", F.least(F.lit(0.92), q * 0.12 + 0.58), c("quality_flags")),
        ((r >= 2) & (q == 0), "likely_referee", F.least(F.lit(0.88), r * 0.10 + 0.56), F.concat("referee_flags", reasons((c("near_edge_share") > 0.45, "some_boards_sideline_presence")))),
        (k >= 2, "likely_non_player", F.least(F.lit(0.82), k * 0.10 + 0.55), c("non_player_flags")),
        (player, "likely_player", F.least(F.lit(0.88), F.lit(0.68) + F.when(colour, 0.07).otherwise(0.0) + F.when(moves, 0.05).otherwise(0.0)),
         F.concat(F.array(F.lit("persistent_in_bounds_track")), reasons((colour, "visible_team_color_saturation"), (moves, "plausible_player_motion")))),
    ]
    label, confidence, why = F, F, F
    for holds, name, sure, says in cases:
        label, confidence, why = label.when(holds, name), confidence.when(holds, sure), why.when(holds, says)
    return t.withColumns({"label": label.otherwise("uncertain"), "confidence": confidence.otherwise(F.least(F.lit(0.15), c("frame_count") * 0.03) + 0.45), "reasons": why.otherwise(rest)})


def estimated_view(frontal: Column, profile: Column, signal: Column, components: Column, contrast: Column, aspect: Column) -> tuple[Column, Column, Column]:
    """View, number region and how sure: faces first, then a narrow box, then a number-like signal."""
    narrow = (aspect < 0.27) & (signal < 0.62)
    back = (signal >= 0.90) & components.between(2, 4) & (contrast >= 0.60) & (aspect >= 0.33)
    front, side = frontal > 0, profile > 0
    view = F.when(front, "front").when(side | narrow, "side").when(back, "back").otherwise("unknown")
    region = F.when(front, "chest").when(side | narrow, "unknown").when(back, "back").otherwise("unknown")
    return view, region, F.when(front | side, "medium").when(narrow | back, "weak").otherwise("none")


def audited(crops: DataFrame, candidate: float = 0.78, borderline: float = 0.68, sharpness: float = 0.24, contrast: float = 0.12, overlap: float = 0.65) -> DataFrame:
    """``crops`` and audit_score, audit_status, ocr_candidate, rejection_reasons.

    Needs torso, width, height, source_quality, laplacian_variance, gray_std,
    signal (of the number region), overlap, border_clipped, view; readable
    false (no image) is rejected outright with score zero.
    """
    c = F.col
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    sharp, plain = unit(c("laplacian_variance") / (c("laplacian_variance") + 140.0)), unit(c("gray_std") / 64.0)
    room = unit(F.when(c("torso"), F.least(c("width") / 120.0, c("height") / 100.0)).otherwise(F.least(c("width") / 120.0, c("height") / 160.0)))
    hidden = unit(F.coalesce(c("overlap"), F.lit(0.0)))
    side = c("view") == "side"
    score = unit(unit(F.coalesce(c("source_quality"), F.lit(0.0))) * 0.22 + sharp * 0.20 + plain * 0.15 + room * 0.14 + c("signal") * 0.21 + (1.0 - hidden) * 0.08 - F.when(side, 0.07).otherwise(0.0))
    small = F.when(c("torso"), (c("width") < 36) | (c("height") < 32)).otherwise((c("width") < 45) | (c("height") < 70))
    t = crops.withColumns({
        "audit_score": F.when(c("readable"), score).otherwise(0.0),
        "_hard": reasons((small, "low_resolution"), (sharp < sharpness, "blurry"), (plain < contrast, "low_contrast"), (hidden > overlap, "high_bbox_overlap_occlusion_proxy")),
        "_soft": reasons((c("border_clipped"), "border_clipped"), (c("signal") < 0.38, "weak_number_region_signal"), (side, "side_view_lower_priority"))})
    fine = F.size("_hard") == 0
    ready, near = fine & (c("audit_score") >= candidate) & c("readable"), fine & (c("audit_score") >= borderline) & c("readable")
    or_ = lambda why, name: F.when(F.size(why) > 0, why).otherwise(F.array(F.lit(name)))
    why = F.when(~c("readable"), F.array(F.lit("crop_file_unreadable"))).when(ready, F.array().cast("array<string>")).when(near, or_(c("_soft"), "below_candidate_threshold")).otherwise(or_(F.concat("_hard", "_soft"), "below_borderline_threshold"))
    return t.withColumns({"audit_status": F.when(ready, "ocr_ready").when(near, "borderline").otherwise("rejected"), "ocr_candidate": ready, "rejection_reasons": why}).drop("_hard", "_soft")


def audited_tracks(audits: DataFrame, top: int = 3) -> DataFrame:
    """Per track: counts of crops, candidates (all, front, back) and borderline crops, readiness, and the paths of the best candidates of these three kinds.

    ``audits``: track_id, frame, torso, crop_path, audit_status, likely_view,
    score. Best is by falling score (null: 0), torso crops first, then frame.
    Only ``top`` paths of each kind are ever gathered.
    """
    c = F.col
    ready = c("audit_status") == "ocr_ready"
    of = lambda view: ready & (c("likely_view") == view)
    kinds = F.array_compact(F.array(F.lit("overall"), F.when(c("likely_view").isin("front", "back"), c("likely_view"))))
    order = Window.partitionBy("track_id", "kind").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), F.desc("torso"), "frame", "crop_path")
    best = audits.where(ready).withColumn("kind", F.explode(kinds)).withColumn("_at", F.row_number().over(order)).where(c("_at") <= top)
    listed = lambda k: F.transform(F.sort_array(F.collect_list(F.when(c("kind") == k, F.struct("_at", "crop_path")))), lambda s: s["crop_path"]).alias(f"best_{k}_paths")
    paths = best.groupBy("track_id").agg(*[listed(k) for k in ("front", "back", "overall")])
    counts = audits.groupBy("track_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(ready).alias("candidates"), F.count_if(of("front")).alias("front"), F.count_if(of("back")).alias("back"), F.count_if(c("audit_status") == "borderline").alias("borderline"))
    readiness = F.when(c("candidates") >= 3, "ready").when((c("candidates") >= 1) | (c("borderline") >= 2), "borderline").otherwise("not_ready")
    none = F.array().cast("array<string>")
    met = counts.withColumn("readiness", readiness).join(paths, "track_id", "left")
    return met.withColumns({f"best_{k}_paths": F.coalesce(f"best_{k}_paths", none) for k in ("front", "back", "overall")})
