"""Crops of frames, colours of points, and where files lie."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import portable_path


def player_crops(observations: DataFrame, frames: DataFrame) -> DataFrame:
    """``observations`` (track_id, frame, bbox array of x1, y1, x2, y2 with exclusive ends) of frames that are there (frame, width, height), with corners and path.

    Corners round half to even and are cut to the frame; boxes of which
    nothing is left, and rows without a box, drop out.
    """
    met = observations.where(F.size("bbox") == 4).join(frames, "frame")
    at = [F.rint(F.col("bbox")[k]).cast("long") for k in range(4)]
    x1, y1, x2, y2 = F.greatest(F.lit(0), at[0]), F.greatest(F.lit(0), at[1]), F.least(F.col("width"), at[2]), F.least(F.col("height"), at[3])
    path = F.concat("track_id", F.format_string("/frame_%06d.jpg", "frame"))
    return met.withColumns({"corners": F.array(x1, y1, x2, y2), "path": path}).where((x2 > x1) & (y2 > y1)).drop("width", "height")


def coloured(points: DataFrame, frame: str, confidence: str) -> DataFrame:
    """``points`` and red, green, blue (0 to 255): a ramp over frames, brighter with confidence. The ramp."""
    reach = points.agg(F.greatest(F.max(frame), F.lit(1)).alias("_last"), F.min(confidence).alias("_low"), F.max(confidence).alias("_high"))  # one row
    hue = F.col(frame) / F.col("_last").cast("double")
    norm = F.when(F.col("_high") > F.col("_low"), (F.col(confidence) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(1.0)

    def channel(at: float) -> Column:
        ramp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.5) - F.abs(hue * 3.0 - at)))
        return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), ramp * (norm * 95 + 120) + 40))).cast("long")

    return points.crossJoin(F.broadcast(reach)).withColumns({"red": channel(0.0), "green": channel(1.5), "blue": channel(3.0)}).drop("_last", "_low", "_high")


def frame_paths(rows: DataFrame, long_names: DataFrame, short_names: DataFrame, listed: DataFrame) -> DataFrame:
    """``rows`` (frame) and path: the file under the long name, else under the short one, else the one at that place of the listing, else null. The three have (frame, path), one row a frame."""
    for k, side in enumerate((long_names, short_names, listed)):
        rows = rows.join(side.select("frame", F.col("path").alias(f"_p{k}")), "frame", "left")
    return rows.withColumn("path", F.coalesce("_p0", "_p1", "_p2")).drop("_p0", "_p1", "_p2")


def artifact_path(artifacts: Column, key: str, root: str) -> Column:
    """A named entry of a map of artifacts as a path under ``root``; null where it isn't there."""
    return portable_path(F.try_element_at(artifacts, F.lit(key)), root)


def parse_bounds(value: str | None, width: float, height: float) -> tuple[float, float, float, float]:
    """Bounds ``x0,y0,x1,y1`` in pixels, the whole template without any; what isn't a box raises."""
    if not value:
        return 0.0, 0.0, float(width), float(height)
    sides = [float(v) for v in value.split(",")]
    if len(sides) != 4:
        raise ValueError("bounds must be x0,y0,x1,y1")
    if sides[2] <= sides[0] or sides[3] <= sides[1]:
        raise ValueError("bounds must grow from x0, y0 to x1, y1")
    return tuple(sides)


def _points_of(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            values = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
            flat = values.reshape(-1, values.shape[-1]).astype(float)
            for at in range(0, len(flat), 1 << 16):
                part = flat[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(list(part), pa.list_(pa.float64()))], names=["path", "at", "values"])


def array_points(spark: SparkSession, folder: str, pattern: str = "*.npy") -> DataFrame:
    """(path, at, values) of every row of the arrays in a folder; all dimensions but the last are flattened. An array is read whole by one task."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content").mapInArrow(_points_of, "path string, at long, values array<double>")
