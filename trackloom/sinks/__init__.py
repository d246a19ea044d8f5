"""Writers: rows as JSON, CSV, point clouds and arrays. All but ``write_document`` go through Spark's own writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import Scratch
from ..operators.select import evenly_picked

#: The columns of the two tables for reviewers.
QUALITY_COLUMNS = ("track_id", "final_label", "confidence_score", "frame_count", "first_frame", "last_frame", "average_bbox_area", "bbox_area_variance", "average_image_speed", "average_field_speed", "maximum_image_jump_distance", "maximum_field_jump_distance", "missing_frames", "projected_point_count", "percent_projected_inside_bounds", "percent_projected_outside_bounds", "near_boards_sideline_fraction", "best_crop_path", "human_readable_reasons")
REVIEW_COLUMNS = ("track_id", "frame_index", "crop_path", "crop_type", "likely_view", "auto_quality_score", "ocr_candidate", "manual_number_visible", "manual_number_text", "manual_view", "notes")
#: What the columns of judged tracks are called in the table.
SHOWN_AS = {"label": "final_label", "confidence": "confidence_score", "maximum_image_jump": "maximum_image_jump_distance", "maximum_field_jump": "maximum_field_jump_distance", "projected_points": "projected_point_count", "inside_share": "percent_projected_inside_bounds", "outside_share": "percent_projected_outside_bounds", "near_edge_share": "near_boards_sideline_fraction", "reasons": "human_readable_reasons"}


def write_rows(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, in place of what was there."""
    rows.write.mode("overwrite").json(path)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """One document as indented JSON with sorted keys and a final line feed, through Hadoop's file systems, in place of what was there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray((json.dumps(document, indent=2, sort_keys=True) + "\n").encode()))
    finally:
        out.close()


def quality_table(tracks: DataFrame) -> DataFrame:
    """Judged tracks (and best_crop_path) as the table for reviewers: fixed columns, reasons as one text."""
    return tracks.withColumn("reasons", F.array_join("reasons", "; ")).withColumnsRenamed(SHOWN_AS).select(*QUALITY_COLUMNS)


def review_table(audits: DataFrame) -> DataFrame:
    """Audited crops as a form: sorted, scores with six digits, truth values in small letters, blank columns to fill in."""
    blank = {c: F.lit("") for c in REVIEW_COLUMNS[-4:]}
    shown = audits.withColumns({"auto_quality_score": F.format_string("%.6f", "auto_quality_score"), "ocr_candidate": F.lower(F.coalesce("ocr_candidate", F.lit(False)).cast("string")), **blank})
    return shown.orderBy("track_id", "frame_index", "crop_type").select(*REVIEW_COLUMNS)


def write_csv(rows: DataFrame, path: str) -> None:
    """A table with a header, in place of what was there."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def ply_lines(points: DataFrame, order: list[str]) -> DataFrame:
    """(at, value): the vertex lines of a point cloud in order; points: x, y, z, red, green, blue."""
    line = F.format_string("%.6f %.6f %.6f %d %d %d", *[F.col(c).cast("double") for c in "xyz"], *[F.col(c).cast("int") for c in ("red", "green", "blue")])
    return points.select(*order, line.alias("value"))


def write_ply(points: DataFrame, path: str, order: list[str], most: int | None = None) -> int:
    """A point cloud as ASCII PLY in part files that follow each other: header first, then vertices in order; returns how many.

    ``most``: evenly spaced points at most. A reader joins the parts by name.
    """
    with Scratch(points.sparkSession) as scratch:
        return _write_ply(points if most is None else evenly_picked(scratch, points, order, most), path, order)


def _write_ply(points: DataFrame, path: str, order: list[str]) -> int:
    n = points.count()
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *[f"property float {c}" for c in "xyz"], *[f"property uchar {c}" for c in ("red", "green", "blue")], "end_header"]
    spark = points.sparkSession
    body = ply_lines(points, order).withColumn("_part", F.lit(1))
    top = spark.createDataFrame([(0, k, h) for k, h in enumerate(head)], "_part int, _at long, value string")
    both = top.unionByName(body, allowMissingColumns=True)
    both.orderBy("_part", "_at", *order).select("value").write.mode("overwrite").text(path)
    return n


def write_arrays(rows: DataFrame, path: str) -> None:
    """Arrays as Parquet, in place of what was there."""
    rows.write.mode("overwrite").parquet(path)


def package_inventory(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected files (path, required) held against those found (path, bytes): path, required, bytes, state (present, oversize, missing, absent)."""
    met = expected.join(found.select("path", "bytes"), "path", "left")
    state = F.when(F.col("bytes").isNull(), F.when(F.col("required"), "missing").otherwise("absent")).when(F.col("bytes") > 90 * 1024 * 1024, "oversize").otherwise("present")
    return met.withColumn("state", state)


def checked_package(inventory: DataFrame) -> DataFrame:
    """One row on an inventory: files, bytes, oversize; a missing required file raises."""
    held = inventory.agg(F.count_if(F.col("bytes").isNotNull()).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(F.col("state") == "oversize").alias("oversize"), F.count_if(F.col("state") == "missing").alias("_missing"))
    return held.where(F.assert_true(F.col("_missing") == 0, F.lit("required files are missing")).isNull()).drop("_missing")


def replaced_section(text: str, header: str, following: str, replacement: str) -> str:
    """``text`` with what lies from the first ``header`` up to the first ``following`` replaced, or appended where the two aren't there in that order."""
    start, end = text.find(header), text.find(following)
    if 0 <= start < end:
        return f"{text[:start]}{replacement.rstrip()}\n\n{text[end:]}"
    return f"{text.rstrip()}\n\n{replacement.rstrip()}\n"
