"""Stage summaries, reconciliation and configuration rows. Texts and states are fixed values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .components import Scratch


def stage_records(summaries: DataFrame) -> DataFrame:
    """``summaries`` (id, status, found, error) as records: id, reported_status, state, error."""
    status = F.when(F.col("found"), F.col("status")).otherwise("missing")
    state = (
        F.when(~F.col("found"), "missing").when(status == "complete", "complete").when(status.isin("valid_with_warnings", "complete_with_warnings"), "complete_with_warnings")
        .when(status.isin("ocr_unavailable", "blocked"), "blocked").otherwise("available_with_nonstandard_status"))
    return summaries.select("id", status.alias("reported_status"), state.alias("state"), "error")


def checkpoint_state(records: DataFrame, engine: bool, accepted: int, identities: bool) -> DataFrame:
    """One row over ``stage_records``: stages and state. Missing summaries come first, then a missing engine, then no accepted number, then pending identities."""
    missing = F.coalesce(F.bool_or(F.col("state") == "missing"), F.lit(False))
    state = (
        F.when(F.col("_missing"), "incomplete_missing_stage_summaries").when(F.lit(not engine), "checkpoint_complete_ocr_unavailable")
        .when(F.lit(accepted == 0), "checkpoint_complete_no_accepted_jersey_numbers").when(F.lit(not identities), "checkpoint_complete_identity_pending").otherwise("complete"))
    return records.agg(F.count(F.lit(1)).alias("stages"), missing.alias("_missing")).select("stages", state.alias("state"))


def mapped_paths(rows: DataFrame, path: str, names: DataFrame, strict: bool = True) -> DataFrame:
    """``rows`` with ``path`` replaced by the path of the file of that name. ``names``: one row per name, with its path.

    Where there is no such file the row raises, or its path is null without ``strict``.
    """
    known = names.select(F.col("name").alias("_name"), F.col("path").alias("_path"))
    met = rows.join(known, F.element_at(F.split(path, "/"), -1) == F.col("_name"), "left")
    absent = F.raise_error(F.concat(F.lit("no such file: "), F.coalesce(path, F.lit("(none)")))) if strict else F.lit(None)
    found = F.when(F.col("_path").isNull(), absent.cast("string")).otherwise(F.col("_path"))
    return met.withColumn(path, found).drop("_name", "_path")


def check_inference(wanted: bool, status: str, model_is_local: bool, may_download: bool) -> None:
    """Raise unless model inference is not wanted, or both the installation is ready and the model is at hand or may be downloaded."""
    if wanted and status != "ready_for_guarded_import":
        raise RuntimeError(f"the model's code is not ready: {status}")
    if wanted and not model_is_local and not may_download:
        raise RuntimeError("a remote model needs leave to download weights")


def merged_in_order(rows: DataFrame, keys: list[str], item: str, order: str) -> DataFrame:
    """(keys, items): non-empty texts of a group without repeats, each where it comes first, ties by text."""
    first = rows.where(F.length(item) > 0).groupBy(*keys, item).agg(F.min(order).alias("_at"))
    return first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", item))), lambda s: s[item]).alias("items"))


def id_checks(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row on two tables of ids: rows, ids on one side only, repeated ids, whether the sets are equal and whether the right is within the left. Null ids count as one id."""
    side = lambda df, name: df.groupBy(F.col(key).alias("_id")).agg(F.count(F.lit(1)).alias(name))
    a, b = side(left, "l"), side(right, "r").withColumnRenamed("_id", "_jd")
    met = a.join(b, F.col("_id").eqNullSafe(F.col("_jd")), "full")
    sums = met.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"), F.count_if(F.col("l") > 1).alias("left_repeats"), F.count_if(F.col("r") > 1).alias("right_repeats"))
    return sums.withColumns({"equal_sets": (F.col("left_only") == 0) & (F.col("right_only") == 0), "subset": F.col("right_only") == 0})


def required(check: DataFrame, condition: str, message: str) -> DataFrame:
    """``check``, whose rows raise where the condition doesn't hold."""
    return check.where(F.assert_true(F.expr(condition), F.lit(message)).isNull())


def same_names(got: Column, wanted: list[str]) -> Column:
    """Whether an array holds just the wanted names, in any order, repeats aside."""
    return F.array_sort(F.array_distinct(got)) == F.array(*[F.lit(w) for w in sorted(set(wanted))])


def with_absent(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` and those of ``wanted`` whose keys they don't have."""
    return rows.unionByName(wanted.join(rows.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def keyframe_name(name: Column, frame: Column) -> Column:
    """The name of a keyframe; blank ones and the two old zone names are called after their frame."""
    plain = F.concat(F.lit("frame_"), F.lpad(frame.cast("string"), F.greatest(F.lit(3), F.length(frame.cast("string"))), F.lit("0")))
    return F.when(tx.nonempty(name) & ~name.isin("attack_zone", "mid_zone"), name).otherwise(plain)


def candidates(raw: Column) -> Column:
    """An array of candidates under their several spellings as (number, confidence); those without a number drop out."""
    one = lambda c: F.struct(F.coalesce(c["number"], c["jersey_number"], c["candidate_number"]).alias("number"), F.coalesce(c["confidence"], c["score"], c["weighted_vote"]).alias("confidence"))
    return F.filter(F.transform(raw, one), lambda c: c["number"].isNotNull())


def roster_faults(schema: Column, team: Column, players: Column) -> Column:
    """What is wrong with a roster document, in order; empty when all is well."""
    says = lambda holds, name: F.when(~holds, F.lit(f"{name} must be a non-empty string"))

    def of(player, k):
        at = F.concat(F.lit("players["), k.cast("string"), F.lit("]."))
        blank = lambda field: F.when(~tx.nonempty(player[field]), F.concat(at, F.lit(f"{field} must be a non-empty string")))
        return F.array(blank("name"), blank("position"), F.when(tx.jersey_number(player["number"]).isNull(), F.concat(at, F.lit("number "), tx.jersey_error(player["number"]))))

    head = F.array(says(tx.nonempty(schema), "schema"), *[says(tx.nonempty(team[f]), f"team.{f}") for f in ("name", "abbreviation", "source_url")], F.when(players.isNull(), "players must be an array"))
    rest = F.flatten(F.transform(players, of))
    return F.array_compact(F.concat(head, F.coalesce(rest, F.array().cast("array<string>"))))


def not_run(rows: DataFrame, note: str = "not_run") -> DataFrame:
    """``rows`` as predictions that have not been made yet."""
    return rows.withColumns({"status": F.lit(note), "jersey_number": F.lit(None).cast("string"), "recognizer_confidence": F.lit(None).cast("double")})


def placeholder_track(frames: DataFrame, most: int = 6) -> DataFrame:
    """One made-up track over the first frames, its box at fixed parts of the frame: track_id, frame_index, bbox_xyxy, mask_area_px, field_overlap, classification. ``frames``: frame_index, width, height. The parts and names."""
    first = frames.orderBy("frame_index").limit(most)
    x1, y1, x2, y2 = (F.floor(F.col(side) * part).cast("long") for side, part in (("width", 0.42), ("height", 0.35), ("width", 0.52), ("height", 0.82)))
    return first.select(F.lit("dryrun_player_0001").alias("track_id"), "frame_index", F.array(x1, y1, x2, y2).alias("bbox_xyxy"), ((x2 - x1) * (y2 - y1)).alias("mask_area_px"), F.lit(1.0).alias("field_overlap"), F.lit("candidate_player").alias("classification"))


def deep_update(base: dict, override: dict) -> dict:
    """``base`` with the values of ``override``, nested mappings merged; neither is changed."""
    out = dict(base)
    for k, v in override.items():
        out[k] = deep_update(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(read: Callable[[str], dict], name: str, seen: tuple[str, ...] = ()) -> dict:
    """A configuration with what it inherits: ``read`` gives the mapping of a name, whose ``inherits`` names its parent. A circle raises."""
    if name in seen:
        raise ValueError(f"configurations inherit in a circle: {' > '.join([*seen, name])}")
    own = dict(read(name))
    parent = own.pop("inherits", None)
    return deep_update(load_config(read, parent, (*seen, name)), own) if parent else own


def run_stages(data: dict, steps: list[tuple[str, Callable[[dict], DataFrame]]]) -> dict:
    """Steps in order; each takes all results so far and adds its own under its name."""
    out = dict(data)
    for name, step in steps:
        out[name] = step(out)
    return out


def _observed(rows: DataFrame, counts: dict[str, Column]) -> tuple[DataFrame, Observation | None]:
    seen = Observation() if counts else None
    return (rows.observe(seen, *[c.alias(n) for n, c in counts.items()]) if counts else rows), seen


def one_pass(rows: DataFrame, sinks: dict[str, tuple[Callable[[DataFrame], DataFrame], str]], counts: dict[str, Column], manifest: dict, path: str) -> dict:
    """Rows made once and written to several places: each sink is a view of them and a path, where it goes as JSON lines.

    ``counts`` are aggregates that are observed while the rows are stored,
    without a pass of their own. The manifest, with status, counts and
    outputs, goes to ``path`` last, when all else is there, and is returned.
    """
    from ..sinks import write_document, write_rows

    with Scratch(rows.sparkSession) as scratch:
        watched, seen = _observed(rows, counts)
        held = scratch.cut(watched)
        for view, place in sinks.values():
            write_rows(view(held), place)
    told = {**manifest, "status": "complete", "counts": {n: seen.get.get(n) for n in counts} if seen else {}, "outputs": {n: place for n, (_, place) in sinks.items()}}
    write_document(rows.sparkSession, told, path)
    return told


def run_with_counts(spark: SparkSession, data: dict, steps: list[tuple[str, Callable[[dict], DataFrame], dict[str, Column]]], folder: str) -> tuple[dict, dict]:
    """``run_stages`` with every result written once as Parquet below ``folder`` and read from there by the later ones; returns the results and the summary, which is written beside them.

    The counts of a stage are observed while it is written.
    """
    from ..sinks import write_document

    out, summary = dict(data), {"status": "complete", "stage": "run_summary", "counts": {}, "stage_outputs": {}}
    for name, step, counts in steps:
        watched, seen = _observed(step(out), counts)
        place = f"{folder.rstrip('/')}/{name}"
        watched.write.mode("overwrite").parquet(place)
        out[name] = spark.read.schema(watched.schema).parquet(place)
        summary["counts"] |= {n: seen.get.get(n) for n in counts} if seen else {}
        summary["stage_outputs"][name] = place
    write_document(spark, summary, f"{folder.rstrip('/')}/run_summary.json")
    return out, summary
