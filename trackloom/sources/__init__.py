"""Table readers and the adapters from the driver's tables to tracking tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEET_FRAMES = T.StructType([
    T.StructField("schema", T.StringType()),
    T.StructField("frames", T.ArrayType(T.StructType([
        T.StructField("frame", T.LongType()), T.StructField("frame_index", T.LongType()),
        T.StructField("timestamp_sec", T.DoubleType()), T.StructField("time_sec", T.DoubleType()), T.StructField("timestamp", T.DoubleType()),
        T.StructField("players", T.ArrayType(T.StructType([
            T.StructField("object_id", T.LongType()), T.StructField("track_id", T.LongType()), T.StructField("id", T.LongType()),
            T.StructField("floor_xy_ft", T.ArrayType(T.DoubleType())), T.StructField("source", T.StringType()), T.StructField("team", T.StringType()),
        ]))),
    ]))),
])
ROSTER = T.StructType([
    T.StructField("schema", T.StringType()),
    T.StructField("team", T.StructType([T.StructField("name", T.StringType()), T.StructField("abbreviation", T.StringType()), T.StructField("source_url", T.StringType())])),
    T.StructField("players", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("number", T.IntegerType()), T.StructField("height", T.StringType()),
        T.StructField("weight_lbs", T.IntegerType()), T.StructField("position", T.StringType()),
    ]))),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is a folder of them or one file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    held = spark.readStream.schema(table(spark, sf_dir, name).schema)
    return held.parquet(f"{sf_dir}/{name}.parquet") if folder else held.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def json_documents(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Whole-file JSON documents under a fixed schema; a broken one keeps its text in _corrupt_record."""
    held = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(held).option("multiLine", True).option("mode", "PERMISSIVE").json(paths)


def feet_points(documents: DataFrame) -> DataFrame:
    """One row per player and frame with a two-element position; alternative spellings are coalesced."""
    frames = documents.select("schema", F.posexplode("frames").alias("frame_at", "f"))
    players = frames.select("schema", "frame_at", F.coalesce("f.frame", "f.frame_index").alias("frame_index"), F.coalesce("f.timestamp_sec", "f.time_sec", "f.timestamp").alias("timestamp_sec"), F.posexplode("f.players").alias("at", "p"))
    return players.where(F.size("p.floor_xy_ft") == 2).select("schema", "frame_index", "timestamp_sec", F.coalesce("p.object_id", "p.track_id", "p.id", F.col("at").cast("long")).alias("track_id"), F.col("p.floor_xy_ft")[0].alias("x_ft"), F.col("p.floor_xy_ft")[1].alias("y_ft"), "p.source", "p.team")


#: The field in feet.
FIELD_FEET = (200.0, 85.0)


def adapted_feet(documents: DataFrame, box: tuple[float, float, float, float] = (0.0, 0.0, 1600.0, 700.0), origin: str = "top_left") -> DataFrame:
    """``feet_points`` and where they lie on a template: x, y in pixels, in_feet and in_bounds by closed bounds. Sorting is left to whoever shows them."""
    from ..functions import feet_to_field

    length, width = FIELD_FEET
    p = feet_points(documents)
    x, y = feet_to_field(F.col("x_ft"), F.col("y_ft"), box, length, width, origin)
    p = p.withColumns({"x": x, "y": y, "in_feet": F.col("x_ft").between(0, length) & F.col("y_ft").between(0, width)})
    return p.withColumn("in_bounds", F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))


def read_state(documents: DataFrame, raw: str, keys: tuple[str, ...] = ("crops", "predictions")) -> DataFrame:
    """``documents`` and what their JSON texts hold: error (``file_not_found`` for null, ``invalid_json``, ``top_level_json_is_not_an_object``; null when all is well), kind (the schema named, else what frames of players are called, else ``unknown``) and records, the number of objects in the list under the first of ``keys`` that is there."""
    text = F.col(raw)
    value = F.try_parse_json(text)
    shape = F.schema_of_variant(value)
    error = F.when(text.isNull(), "file_not_found").when(value.isNull(), "invalid_json").when(~shape.startswith("OBJECT"), "top_level_json_is_not_an_object")
    named = F.get_json_object(text, "$.schema")
    frames = F.from_json(F.get_json_object(text, "$.frames"), "array<struct<players: string>>")
    kind = F.when(error.isNull(), F.coalesce(named, F.when((F.size(frames) > 0) & F.forall(frames, lambda f: f["players"].isNotNull()), "unknown_frames_players_floor_xy").otherwise("unknown")))
    listed = F.coalesce(*[F.get_json_object(text, f"$.{k}") for k in keys])
    objects = F.filter(F.from_json(listed, "array<string>"), lambda v: v.startswith("{"))
    return documents.withColumns({"error": error, "kind": kind, "records": F.when(error.isNull(), F.greatest(F.size(objects), F.lit(0)))})


def valid_documents(documents: DataFrame, raw: str, path: str) -> DataFrame:
    """``documents`` whose text is a JSON object; the others raise, with their path and what is wrong. A path that is listed twice is read once."""
    state = read_state(documents.dropDuplicates([path]), raw)
    broken = F.raise_error(F.concat(F.col(path), F.lit(": "), F.col("error")))
    return state.withColumn("error", F.when(F.col("error").isNotNull(), broken).otherwise(F.col("error"))).where(F.coalesce("error", F.lit("")) == "").drop("error", "kind", "records")


def _empty_files(spark: SparkSession, folder: str, pattern: str, deep: bool) -> DataFrame:
    """(path) of the files without content, which Spark's readers leave out of a scan; from the file system's listing, as Spark lists on the driver itself."""
    import fnmatch

    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listed, found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, deep), []
    while listed.hasNext():
        at = listed.next()
        name = at.getPath().getName()
        if at.getLen() == 0 and fnmatch.fnmatchcase(name, pattern) and name[:1] not in "_.":
            found.append((at.getPath().toString(),))
    return spark.createDataFrame(found, "path string")


def files(spark: SparkSession, folder: str, pattern: str = "*", deep: bool = False) -> DataFrame:
    """(path, name, bytes, frame) of the files of a folder, those without content included; frame is the number in ``frame_<digits>``, null without. Hidden files (names that begin with a dot or an underscore) are left out."""
    from ..functions.text import frame_of_path

    held = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(deep).lower()).load(folder).select("path", F.col("length").alias("bytes"))
    every = held.unionAll(_empty_files(spark, folder, pattern, deep).select("path", F.lit(0).cast("long")))
    return every.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", frame_of_path(F.col("path")).alias("frame"))


def file_records(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256, oversize) of all files below a folder, those without content included; over 90 MB is oversize."""
    held = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    own = held.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), (F.col("length") > 90 * 1024 * 1024).alias("oversize"))
    return own.unionAll(_empty_files(spark, folder, pattern, True).select("path", F.lit(0).cast("long"), F.sha2(F.lit(b""), 256), F.lit(False)))


def unique_names(listed: DataFrame) -> DataFrame:
    """``files`` with one row per name; a name that occurs twice raises."""
    once = listed.groupBy("name").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n"))
    return once.select("name", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate file name: "), F.col("name")))).otherwise(F.col("path")).alias("path"))


def kept_masks(metadata: DataFrame, fusion: DataFrame) -> DataFrame:
    """One row per kept mask of a frame's metadata (frame_index, kept_masks), with the fused centroid and point count of (frame_index, mask_id); null and 0 where there is none, the last of repeats else."""
    from ..operators.joins import last_by

    masks = metadata.select("frame_index", F.explode("kept_masks").alias("m")).select("frame_index", F.col("m.mask_id"), F.col("m.bbox"), F.col("m.centroid"), F.col("m.bottom_center_point"), F.col("m.confidence_score"))
    side = last_by(fusion.select("frame_index", "mask_id", "centroid_3d", "point_count", "ordinal"), ["frame_index", "mask_id"], "ordinal").drop("ordinal")
    return masks.join(side, ["frame_index", "mask_id"], "left").withColumn("point_count", F.coalesce("point_count", F.lit(0)))


def roster_players(documents: DataFrame) -> DataFrame:
    """One row per player with its team; abbreviation in capitals, names trimmed."""
    return documents.select(F.upper(F.trim("team.abbreviation")).alias("team"), F.explode("players").alias("p")).select("team", F.trim("p.name").alias("name"), "p.number", "p.height", "p.weight_lbs", "p.position")


def observations(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """events, read here or given (as a stream), as observations: track is the user, frame the hour, the point (value, props.k)."""
    e = table(spark, sf_dir, "events") if events is None else events
    return e.select(F.col("user_id").alias("track_id"), F.expr("unix_seconds(cast(ts as timestamp)) div 3600").alias("frame"), "event_id", F.col("event_type").alias("label"), F.col("value").alias("score"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as boxes in frames (orders), inclusive corners."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as frame", "l_linenumber as box", "l_partkey as part", "cast(l_quantity as double) as x0", "cast(l_discount as double) * 100 as y0", "cast(l_quantity as double) + cast(l_tax as double) * 100 + 1 as x1", "cast(l_discount as double) * 100 + l_linenumber as y1", "cast(l_extendedprice as double) as price", "l_returnflag as kind")


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as a roster: team is the nation, the number c_custkey modulo 100."""
    return table(spark, sf_dir, "customer").selectExpr("c_nationkey as team", "cast(c_custkey % 100 as int) as number", "c_name as name", "c_custkey as player_id")
