"""Names, numbers and paths as text. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nonempty(value: Column) -> Column:
    """Whether a text holds more than white space."""
    return F.coalesce(F.length(F.regexp_replace(value, r"\s+", "")) > 0, F.lit(False))


def slug(prompt: Column) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends; ``prompt`` where nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(prompt), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.length(kept) > 0, kept).otherwise("prompt")


def jersey_number(value: Column) -> Column:
    """A number from 0 to 99 out of a text of digits; null for all else."""
    plain = F.trim(value.cast("string"))
    number = F.when(plain.rlike(r"\A[0-9]{1,9}\z"), plain.cast("int"))
    return F.when(number.between(0, 99), number)


def jersey_error(value: Column) -> Column:
    """Why ``jersey_number`` is null; null where it isn't."""
    plain = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(~plain.rlike(r"\A[0-9]+\z"), "jersey number must be an integer or digit string").when(jersey_number(value).isNull(), "jersey number must be between 0 and 99")


def digit_candidate(text: Column) -> Column:
    """The digits of a text if they are one or two, leading zeros kept; else null."""
    kept = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(kept).between(1, 2), kept)


def safe_int(value: Column) -> Column:
    """A whole number out of a text; null where it is none."""
    return F.trim(value).try_cast("bigint")


def jersey_candidates(answer: Column) -> Column:
    """Numbers named in an answer, as texts without leading zeros, in order of their rules and without repeats.

    Rules: numbers of one or two digits within <ref> labels, then after
    "jersey (number) (is)", after "number" or "no.", and an answer that is
    nothing but a number; the last three look past <box> parts. Patterns are
    fixed values.
    """
    labels = F.regexp_extract_all(answer, F.lit(r"(?i)<ref>\s*([^<]+?)\s*</ref>"), F.lit(1))
    plain = F.regexp_replace(answer, r"(?i)<box>.*?</box>", "")
    found = lambda text, rule: F.regexp_extract_all(text, F.lit(rule), F.lit(1))
    named = F.flatten(F.transform(labels, lambda t: found(t, r"(?<!\d)(\d{1,2})(?!\d)")))
    all_ = F.concat(
        named,
        found(plain, r"(?i)jersey\s+(?:number\s+)?(?:is|:)?\s*#?\s*(\d{1,2})(?!\d)"),
        found(plain, r"(?i)(?:number|no\.)\s*(?:is|:)?\s*#?\s*(\d{1,2})(?!\d)"),
        found(plain, r"^\s*#?\s*(\d{1,2})\s*$"),
    )
    return F.coalesce(F.array_distinct(F.transform(all_, lambda n: n.cast("int").cast("string"))), F.array().cast("array<string>"))


def unique_strings(values: Column) -> Column:
    """Non-empty texts, each where it comes first."""
    return F.array_distinct(F.filter(values, lambda v: F.length(v) > 0))


def human_size(n: Column) -> Column:
    """Bytes as B, KiB, MiB or GiB with two decimals, halves to the even digit."""
    as_ = lambda by, unit: F.format_string(f"%.2f {unit}", F.bround(n.cast("double") / by, 2))
    return F.when(n < 1024, as_(1.0, "B")).when(n < 1024**2, as_(1024.0, "KiB")).when(n < 1024**3, as_(1024.0**2, "MiB")).otherwise(as_(1024.0**3, "GiB"))


def seconds_tag(value: Column) -> Column:
    """Seconds for a file name: whole ones as they are, else with p for the point."""
    whole = F.rint(value)
    return F.when(F.abs(value - whole) < 1e-6, whole.cast("bigint").cast("string")).otherwise(F.regexp_replace(value.cast("string"), r"\.", "p"))


def segment_tag(start: Column, duration: Column) -> Column:
    return F.concat(F.lit("segment_"), seconds_tag(start), F.lit("s_"), seconds_tag(duration), F.lit("s"))


def frame_of_path(path: Column) -> Column:
    """The number in ``frame_<digits>``; null where there is none."""
    return F.regexp_extract(path, r"frame_(\d+)", 1).try_cast("bigint")


def path_key(path: Column, root: str = "/") -> Column:
    """An absolute path without doubled slashes and single dots, so that equal files have equal keys."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    dots = F.regexp_replace(whole, r"/(\./)+", "/")
    return F.regexp_replace(F.regexp_replace(dots, "/+", "/"), "(?<=.)/$", "")


def portable_path(path: Column, root: str) -> Column:
    """The path under ``root`` where it lies there, else as it is; null for none."""
    base = root.rstrip("/") + "/"
    return F.when(F.length(path) > 0, F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path))


def crop_filename(track: Column, frame: Column, kind: Column, variant: Column) -> Column:
    """A null kind is called crop."""
    return F.format_string("track_%03d_frame_%03d_%s_%s.png", track, frame, F.coalesce(kind, F.lit("crop")), variant)


def number_region_path(root: str, track: Column, frame: Column, kind: Column) -> Column:
    """Where the number region of a crop lies under ``root``."""
    return F.concat(F.lit(root.rstrip("/")), F.format_string("/track_%03d/", track), crop_filename(track, frame, kind, F.lit("number_region")))
