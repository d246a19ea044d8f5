"""Small record shapes: frames, seed keyframes, points as arrays, typed values, manifests of regions, audits beside their crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A frame's record: what every stage hands to the next.
FRAME = ("frame_index", "timestamp_sec", "source_frame_index", "path", "width", "height")


def frame_records(rows: DataFrame) -> DataFrame:
    """``rows`` as frame records, whole numbers as longs, seconds as a double."""
    kinds = {"timestamp_sec": "double", "path": "string"}
    return rows.select(*[F.col(c).cast(kinds.get(c, "long")).alias(c) for c in FRAME])


def point_array(point: Column) -> Column:
    """A point as an array of two floats; null where it or a coordinate is missing."""
    return F.when(point["x"].isNotNull() & point["y"].isNotNull(), F.array(point["x"].cast("float"), point["y"].cast("float")))


def array_point(values: Column) -> Column:
    """An array of two numbers as a point of doubles; null for null."""
    return F.when(values.isNotNull(), F.struct(F.get(values, 0).cast("double").alias("x"), F.get(values, 1).cast("double").alias("y")))


def inside_points(points: DataFrame, flag: str = "inside_field_template_bounds") -> DataFrame:
    """The points whose flag is true; a missing flag is not."""
    return points.where(F.coalesce(F.col(flag), F.lit(False)))


def number_values(text: Column) -> Column:
    """The numbers among the values of a JSON array, as doubles; true and false count as one and zero, texts and nulls don't count. What isn't an array has none."""
    values = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    kind = F.schema_of_variant
    number = lambda v: kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    kept = F.filter(values, lambda v: number(v) | (kind(v) == "BOOLEAN"))
    return F.coalesce(F.transform(kept, lambda v: F.when(number(v), F.try_variant_get(v, "$", "double")).otherwise(F.try_variant_get(v, "$", "boolean").cast("double"))), F.array().cast("array<double>"))


def seed_keyframes(points: DataFrame, frames: DataFrame, first: int, middle: int, fallback: str) -> DataFrame:
    """The keyframes a new configuration starts with: name, frame_index, frame_path, points.

    The first has all ``points`` (name, video_xy, field_xy), in the order of
    names, and ``fallback`` as its path where ``frames`` (frame_index, path)
    hasn't got it; the middle one is there only if its frame is, and has none.
    """
    path = lambda k: frames.where(F.col("frame_index") == k).agg(F.min("path").alias("frame_path"))
    own = points.agg(F.sort_array(F.collect_list(F.struct("name", "video_xy", "field_xy"))).alias("points"))  # a keyframe's points
    name = lambda k: F.format_string("frame_%03d", F.lit(k)).alias("name")
    head = path(first).crossJoin(own).select(name(first), F.lit(first).cast("long").alias("frame_index"), F.coalesce("frame_path", F.lit(fallback)).alias("frame_path"), "points")
    tail = path(middle).where("frame_path is not null").crossJoin(own).select(name(middle), F.lit(middle).cast("long").alias("frame_index"), "frame_path", F.slice("points", 1, 0).alias("points"))
    return head.unionAll(tail)


def keyframe_rows(keyframes: DataFrame) -> DataFrame:
    """Keyframes as they are written: without what only a run holds; interpolate is false where it isn't said."""
    kept = ("name", "frame_index", "frame_path", "points", "homography_matrix", "homography_matrix_path", "homography_inliers", "video_diagnostic", "template_diagnostic", "view_segment")
    told = F.coalesce("interpolate", F.lit(False)) if "interpolate" in keyframes.columns else F.lit(False)
    return keyframes.select(*[F.col(c) if c in keyframes.columns else F.lit(None).cast("string").alias(c) for c in kept], told.alias("interpolate"))


def totals(rows: DataFrame, *keys: str) -> DataFrame:
    """(key, value, n): how many rows each value of each of the keys has, in one pass. Null values count as one value."""
    held = rows.groupingSets([[k] for k in keys], *keys).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"))
    bit = {k: 1 << (len(keys) - 1 - i) for i, k in enumerate(keys)}
    every = sum(bit.values())
    key = value = F.lit(None).cast("string")
    for k in keys:
        own = F.col("_g") == every - bit[k]
        key, value = F.when(own, F.lit(k)).otherwise(key), F.when(own, F.col(k).cast("string")).otherwise(value)
    return held.select(key.alias("key"), value.alias("value"), "n")


def manifest_regions(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """``manifest`` (region_path, source_region_box, variant_name, manifest_preprocessed_region) with the image each row names: width, height, channels, pixels, source. ``images``: path and those.

    A row whose image isn't there raises, with its path. A missing flag of
    being preprocessed is true.
    """
    met = manifest.join(images.select(F.col("path").alias("region_path"), "width", "height", "channels", "pixels"), "region_path", "left")
    lost = F.raise_error(F.concat(F.lit("could not read the number region "), F.coalesce("region_path", F.lit("(no path)"))))
    return met.withColumns({
        "width": F.when(F.col("pixels").isNull(), lost.cast("int")).otherwise(F.col("width")), "source": F.lit("enhanced_number_region_manifest"),
        "manifest_preprocessed_region": F.coalesce("manifest_preprocessed_region", F.lit(True))})


def plain_path(path: Column, root: str = "/") -> Column:
    """A path without empty, ``.`` and ``..`` parts, from ``root`` where it doesn't begin at the top; null counts as empty."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), F.coalesce(path, F.lit(""))))
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda held, p: F.when(p == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def last_crops(clean: DataFrame, root: str = "/") -> DataFrame:
    """``clean`` (crop_path, ordinal) with plain paths, one row a path, the last."""
    from .joins import last_by

    return last_by(clean.withColumn("crop_path", plain_path(F.col("crop_path"), root)), ["crop_path"], "ordinal").drop("ordinal")


def audited_crops(clean: DataFrame, audits: DataFrame, root: str = "/", there: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(crops with their audits, audits without a crop).

    Both sides name a crop by ``crop_path``, compared as plain paths; of
    several crops with one path the last (``ordinal``) counts. An audit's
    readiness is its ocr_readiness_score, else its auto_quality_score, else
    its quality_score, else the crop's crop_quality_score, else zero; its view
    is heuristic_likely_view, else likely_view, else unknown. ``there``
    (path): files that exist; with it, only crops whose file does.
    """
    own = last_crops(clean, root)
    said = audits.withColumn("crop_path", plain_path(F.col("crop_path"), root))
    said = said.select("crop_path", *[F.col(c).alias(f"_{c}") for c in said.columns if c != "crop_path"])
    met = said.join(own, "crop_path")
    if there is not None:
        met = met.join(there.select(plain_path(F.col("path"), root).alias("crop_path")).distinct(), "crop_path", "left_semi")
    ready = F.coalesce(*[F.col(c).cast("double") for c in ("_ocr_readiness_score", "_auto_quality_score", "_quality_score", "crop_quality_score")], F.lit(0.0))
    view = F.coalesce("_heuristic_likely_view", "_likely_view", F.lit("unknown"))
    held = met.select(*own.columns, ready.alias("ocr_readiness_score"), F.when(view == "", "unknown").otherwise(view).alias("heuristic_likely_view"), F.coalesce("_ocr_candidate", F.lit(False)).alias("audit_ocr_candidate"),
                      F.col("_audit_status").alias("audit_status"), F.col("_rejection_reason").alias("audit_rejection_reason"), F.col("_number_region_box").alias("number_region_box"), F.coalesce("_number_region_guess", F.lit("unknown")).alias("number_region_guess"))
    return held, said.join(own.select("crop_path"), "crop_path", "left_anti").select("crop_path")


def shared_frames(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b: tracks) with shared, how many frames both have; ``members``: track, frame. Zero where they have none in common."""
    own = members.select("track", "frame").distinct()
    both = pairs.select("a", "b").distinct().join(own.withColumnRenamed("track", "a"), "a").join(own.select(F.col("track").alias("b"), "frame"), ["b", "frame"])
    return pairs.join(both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")), ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
