"""Queries over crops, number evidence, rosters, track quality and reconciliation, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import points as pt
from ..functions import text as tx
from ..operators import filters, joins, select, stages, votes
from ..sources import boxes, observations, roster, table
from .catalogue import BOX, OBS, ROSTER, query

_ATT = "WITH att AS (SELECT user_id % 40 AS track_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) // 24 AS frame, event_id, event_type AS label, CASE WHEN event_type <> 'view' OR event_id % 3 > 0 THEN CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 14 + 1 AS VARCHAR) END AS number, CASE WHEN event_type = 'click' THEN 0.0 WHEN event_type <> 'error' THEN round(value / 500, 4) END AS confidence, CASE WHEN event_id % 9 > 0 THEN round(value / 500, 4) END AS readiness FROM events) "


def _attempts(spark, d):
    """events as readings of numbers; some have no number, no confidence or no readiness, and some have zero confidence."""
    o, i, label = observations(spark, d), F.col("event_id"), F.col("label")
    score = F.round(F.col("score") / 500, 4)
    return o.select((F.col("track_id") % 40).alias("track_id"), F.expr("frame div 24").alias("frame"), i, label, F.when((label != "view") | (i % 3 > 0), (F.col("y").cast("long") % 14 + 1).cast("string")).alias("number"), F.when(label == "click", 0.0).when(label != "error", score).alias("confidence"), F.when(i % 9 > 0, score).alias("readiness"))


def _vote_sql(keys: str, confidence: str, extra: str) -> str:
    return f""", u AS (SELECT *, {confidence} AS c FROM att WHERE number IS NOT NULL), g AS (SELECT {keys}, number, count(*) AS n, round(sum(coalesce(c, 0.25)), 9) AS s FROM u GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY {keys}) AS total, row_number() OVER (PARTITION BY {keys} ORDER BY length(number) = 2 AND n >= 2 DESC, n DESC, s DESC, number) AS o FROM g),
r AS (SELECT u.*, w.n, w.s AS confidence_sum, n / total AS consensus, row_number() OVER (PARTITION BY {keys} ORDER BY coalesce(u.confidence, 0) DESC, {extra}event_id) AS z FROM u JOIN w USING ({keys}, number) WHERE w.o = 1), voted AS (SELECT * FROM r WHERE z = 1) """


_G25 = _ATT + _vote_sql("track_id, frame", "confidence", "coalesce(readiness, 0) DESC, ")


@query(_G25 + """, bare AS (SELECT *, row_number() OVER (PARTITION BY track_id, frame ORDER BY coalesce(readiness, 0) DESC, event_id) AS z FROM att WHERE (track_id, frame) NOT IN (SELECT (track_id, frame) FROM voted))
SELECT track_id, frame, event_id, number, n, round(confidence_sum, 6) AS confidence_sum, round(consensus, 6) AS consensus FROM voted UNION ALL SELECT track_id, frame, event_id, NULL, 0, 0.0, 0.0 FROM bare WHERE z = 1""")
def frame_collapse(spark, d):
    """G25."""
    v = votes.collapsed_frames(_attempts(spark, d), "event_id")
    return v.select("track_id", "frame", "event_id", "number", "n", F.round("confidence_sum", 6).alias("confidence_sum"), F.round("consensus", 6).alias("consensus"))


_R = {k: v.replace("'", "''") for k, v in votes.REASONS.items()}


@query(_G25 + f""", a AS (SELECT track_id, number, count(*) AS votes, sum(coalesce(confidence, 0.3) * greatest(0.1, coalesce(readiness, 0))) AS w FROM voted GROUP BY 1, 2),
p AS (SELECT *, length(number) = 1 AND EXISTS (SELECT 1 FROM a h WHERE h.track_id = a.track_id AND length(h.number) = 2 AND contains(h.number, a.number)) AS part FROM a),
q AS (SELECT *, w * CASE WHEN part THEN 0.25 ELSE 1 END AS weight, CASE WHEN length(number) = 1 THEN 3 ELSE 2 END AS needed FROM p), s AS (SELECT *, CASE WHEN sum(weight) OVER (PARTITION BY track_id) <> 0 THEN weight / sum(weight) OVER (PARTITION BY track_id) ELSE 0 END AS consensus, row_number() OVER (PARTITION BY track_id ORDER BY weight DESC, votes DESC, number) AS o FROM q),
k AS (SELECT DISTINCT track_id FROM att) SELECT k.track_id, number, coalesce(votes, 0) AS votes, round(coalesce(weight, 0), 6) AS weight, round(coalesce(consensus, 0), 6) AS consensus, CASE WHEN NOT part AND votes >= needed AND consensus >= 0.67 THEN number END AS accepted_number,
CASE WHEN number IS NULL THEN '{_R["none"]}' WHEN part THEN '{_R["partial"]}' WHEN votes < needed THEN '{_R["few"]}' WHEN consensus < 0.67 THEN '{_R["split"]}' ELSE '{_R["accepted"]}' END AS reason FROM k LEFT JOIN (SELECT * FROM s WHERE o = 1) USING (track_id)""")
def track_vote(spark, d):
    """G26."""
    t = votes.aggregate_tracks(_attempts(spark, d), ordinal="event_id")
    return t.select("track_id", "number", "votes", F.round("weight", 6).alias("weight"), F.round("consensus", 6).alias("consensus"), "accepted_number", "reason")


@query(_ATT + """, g AS (SELECT track_id, number, count(*) AS n, sum(coalesce(confidence, 1.0)) AS w FROM att WHERE number IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, w * CASE WHEN length(number) = 1 AND EXISTS (SELECT 1 FROM g h WHERE h.track_id = g.track_id AND length(h.number) = 2 AND contains(h.number, g.number)) THEN 0.25 ELSE 1 END AS weight FROM g),
s AS (SELECT *, sum(n) OVER (PARTITION BY track_id) AS usable, weight / nullif(sum(weight) OVER (PARTITION BY track_id), 0) AS c, row_number() OVER (PARTITION BY track_id ORDER BY weight DESC, number) AS o FROM p), k AS (SELECT track_id, count(*) AS crops FROM att GROUP BY 1)
SELECT track_id, number AS leading, round(coalesce(c, 0), 6) AS consensus, crops, CAST(coalesce(usable, 0) AS BIGINT) AS usable, CASE WHEN usable >= 2 AND c >= 0.67 THEN 'accepted' ELSE 'uncertain' END AS status, CASE WHEN usable >= 2 AND c >= 0.67 THEN number END AS number FROM k LEFT JOIN (SELECT * FROM s WHERE o = 1) USING (track_id)""")
def simple_vote(spark, d):
    """G27."""
    return votes.simple_votes(_attempts(spark, d))


@query(_ATT + _vote_sql("track_id, frame, label", "CASE WHEN confidence <> 0 THEN confidence END", "") + """, bare AS (SELECT *, row_number() OVER (PARTITION BY track_id, frame, label ORDER BY coalesce(confidence, 0) DESC, event_id) AS z FROM att WHERE (track_id, frame, label) NOT IN (SELECT (track_id, frame, label) FROM voted))
SELECT track_id, frame, label, event_id, number, n, round(consensus, 6) AS consensus, CASE WHEN length(number) = 2 AND confidence >= 0.45 THEN 'readable' ELSE 'uncertain' END AS status, CASE WHEN length(number) = 1 THEN 'One digit detected; repeated track evidence is required because it may be partial.' WHEN confidence IS NULL OR confidence < 0.45 THEN 'Two digits detected below the OCR confidence threshold.' ELSE 'Two-digit crop evidence; track consensus is still required.' END AS reason FROM voted
UNION ALL SELECT track_id, frame, label, event_id, NULL, 0, 0.0, 'unreadable', 'No preprocessing variant returned digits.' FROM bare WHERE z = 1""")
def best_attempt(spark, d):
    """G24, with the status of the crop's prediction."""
    v = votes.best_attempts(_attempts(spark, d), ["track_id", "frame", "label"], "event_id")
    return v.select("track_id", "frame", "label", "event_id", "number", "n", F.round("consensus", 6).alias("consensus"), "status", "reason")


@query(_ATT + "SELECT track_id, event_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY number IS NULL, coalesce(confidence, 0) DESC, readiness DESC NULLS LAST, event_id) AS INTEGER) AS rank FROM att QUALIFY rank <= 3")
def track_evidence(spark, d):
    """C09."""
    return votes.ranked_evidence(_attempts(spark, d), 3, "event_id").select("track_id", "event_id", "rank")


@query(_ATT + "SELECT track_id, frame, number, max(coalesce(confidence, readiness, 0)) AS score FROM att WHERE number IS NOT NULL GROUP BY ALL")
def number_scores(spark, d):
    """Readiness stands for the consensus."""
    return votes.number_scores(_attempts(spark, d).withColumnRenamed("readiness", "consensus"), ["track_id", "frame"])


@query(_ATT + ", s AS (SELECT track_id, max(number) FILTER (confidence > 0.19) AS accepted, max(number) FILTER (frame % 2 = 0 AND confidence > 0.1) AS lead_n FROM att WHERE track_id % 5 <> 4 GROUP BY 1), k AS (SELECT DISTINCT track_id FROM att) SELECT k.track_id, CASE WHEN s.track_id IS NULL THEN 'not_evaluated' WHEN accepted IS NOT NULL THEN 'accepted' WHEN lead_n IS NOT NULL THEN 'candidate_low_confidence' ELSE 'no_candidate' END AS status, accepted FROM k LEFT JOIN s USING (track_id)")
def number_status(spark, d):
    """Tracks without a prediction stay."""
    a = _attempts(spark, d)
    s = a.where("track_id % 5 <> 4").groupBy("track_id").agg(F.max(F.when(F.col("confidence") > 0.19, F.col("number"))).alias("accepted"), F.max(F.when((F.col("frame") % 2 == 0) & (F.col("confidence") > 0.1), F.col("number"))).alias("leading")).withColumn("known", F.lit(True))
    met = a.select("track_id").distinct().join(s, "track_id", "left")
    return met.select("track_id", votes.number_status(F.col("accepted"), F.col("leading"), F.col("known").isNotNull()).alias("status"), "accepted")


@query(_ATT + ", e AS (SELECT track_id, event_id, row_number() OVER (PARTITION BY track_id ORDER BY confidence DESC NULLS LAST, event_id) AS o FROM att), s AS (SELECT track_id, string_agg(event_id, ',' ORDER BY o) AS evidence FROM e WHERE o <= 5 GROUP BY 1), k AS (SELECT DISTINCT track_id * 2 AS track_id FROM att) SELECT k.track_id, coalesce(evidence, '') AS evidence FROM k LEFT JOIN s USING (track_id)")
def attached_evidence(spark, d):
    """The best rows of each track as a list, empty where it has none."""
    a = _attempts(spark, d)
    tracks = a.select((F.col("track_id") * 2).alias("track_id")).distinct()
    rows = a.withColumn("worst", -F.coalesce("confidence", F.lit(-1.0))).select("track_id", "event_id", "worst")
    met = joins.attached(tracks, rows, ["track_id"], ["worst", "event_id"], "evidence", 5)
    return met.select("track_id", F.array_join(F.transform("evidence", lambda e: e["event_id"].cast("string")), ",").alias("evidence"))


_ANSWER = "WITH a AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '<ref> No ' || p_size || ' or ' || (p_size + 90) || '</ref><box>' || p_size || '</box>' WHEN 1 THEN 'The Jersey number is #' || p_size WHEN 2 THEN 'jersey: 0' || (p_size % 10) || ', number ' || p_size WHEN 3 THEN '  #' || p_size || ' ' WHEN 4 THEN 'no. ' || (p_size * 7) WHEN 5 THEN 'number <box>12</box>' || p_size WHEN 6 THEN p_brand ELSE NULL END AS answer FROM part) "


def _answers(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr("case p_partkey % 8 when 0 then concat('<ref> No ', p_size, ' or ', p_size + 90, '</ref><box>', p_size, '</box>') when 1 then concat('The Jersey number is #', p_size) when 2 then concat('jersey: 0', p_size % 10, ', number ', p_size) when 3 then concat('  #', p_size, ' ') when 4 then concat('no. ', p_size * 7) when 5 then concat('number <box>12</box>', p_size) when 6 then p_brand end").alias("answer"))


@query(_ANSWER + r""", x AS (SELECT p_partkey, regexp_replace(answer, '(?i)<box>.*?</box>', '', 'g') AS plain, list_filter(regexp_extract_all(array_to_string(regexp_extract_all(answer, '(?i)<ref>\s*([^<]+?)\s*</ref>', 1), ' '), '[0-9]+'), lambda s: length(s) <= 2) AS named FROM a),
y AS (SELECT p_partkey, list_concat(named, list_filter(regexp_extract_all(plain, '(?i)jersey\s+(?:number\s+)?(?:is|:)?\s*#?\s*([0-9]+)', 1), lambda s: length(s) <= 2), list_filter(regexp_extract_all(plain, '(?i)(?:number|no\.)\s*(?:is|:)?\s*#?\s*([0-9]+)', 1), lambda s: length(s) <= 2), list_filter(regexp_extract_all(plain, '^\s*#?\s*([0-9]+)\s*$', 1), lambda s: length(s) <= 2)) AS found FROM x),
z AS (SELECT p_partkey, i, CAST(CAST(found[i] AS INTEGER) AS VARCHAR) AS n FROM (SELECT p_partkey, found, unnest(range(1, len(found) + 1)) AS i FROM y)), f AS (SELECT p_partkey, n, min(i) AS i FROM z GROUP BY 1, 2)
SELECT a.p_partkey, coalesce((SELECT string_agg(n, ',' ORDER BY i) FROM f WHERE f.p_partkey = a.p_partkey), '') AS numbers FROM a""")
def number_regex(spark, d):
    """D44 on made-up answers, from part."""
    return _answers(spark, d).select("p_partkey", F.array_join(tx.jersey_candidates(F.col("answer")), ",").alias("numbers"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' / ' || p_type || '!'), '[^a-z0-9]+', '_', 'g'), '_') AS slug, CASE WHEN p_size * 3 BETWEEN 0 AND 99 THEN p_size * 3 END AS jersey, CASE WHEN p_size * 3 > 99 THEN 'jersey number must be between 0 and 99' END AS jersey_error, p_type <> '' AS nonempty, CASE WHEN length(regexp_replace(p_brand, '[^0-9]', '', 'g')) BETWEEN 1 AND 2 THEN regexp_replace(p_brand, '[^0-9]', '', 'g') END AS candidate, TRY_CAST(CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'x' || p_size END AS BIGINT) AS safe,
CASE WHEN b < 1024 THEN format('{:.2f} B', CAST(b AS DOUBLE)) WHEN b < 1048576 THEN format('{:.2f} KiB', b / 1024.0) WHEN b < 1073741824 THEN format('{:.2f} MiB', b / 1048576.0) ELSE format('{:.2f} GiB', b / 1073741824.0) END AS size,
'segment_' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE (p_size // 2) || 'p5' END || 's_10s' AS tag, CASE WHEN p_size % 4 > 0 THEN p_partkey END AS frame, '/data/x/' || p_partkey || '.png' AS key, CASE WHEN p_size % 2 = 0 THEN 'x/' || p_partkey ELSE '/other/' || p_partkey END AS portable, 'track_' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '_frame_' || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 3, '0') ELSE CAST(p_partkey AS VARCHAR) END || '_torso_raw.png' AS file,
'/r/track_' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '/track_' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '_frame_' || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 3, '0') ELSE CAST(p_partkey AS VARCHAR) END || '_crop_number_region.png' AS region FROM (SELECT *, CAST(p_partkey AS BIGINT) * p_size * p_size * p_size AS b FROM part)""")
def text_scalars(spark, d):
    """A16, A23, B11, C04, D40 to D43, D45, D48, D52, D63, D64."""
    p = table(spark, d, "part").selectExpr("*", "cast(p_partkey as bigint) * p_size * p_size * p_size as b")
    key, size = F.col("p_partkey"), F.col("p_size")
    three = (size * 3).cast("string")
    path = F.concat(F.when(size % 4 > 0, "/data/frame_").otherwise("/data/image_"), key.cast("string"), F.lit(".jpg"))
    there = F.when(size % 2 == 0, F.concat(F.lit("/data/x/"), key.cast("string"))).otherwise(F.concat(F.lit("/other/"), key.cast("string")))
    return p.select(
        key, tx.slug(F.concat("p_brand", F.lit(" / "), "p_type", F.lit("!"))).alias("slug"), tx.jersey_number(three).alias("jersey"), tx.jersey_error(three).alias("jersey_error"), tx.nonempty(F.col("p_type")).alias("nonempty"), tx.digit_candidate(F.col("p_brand")).alias("candidate"),
        tx.safe_int(F.when(size % 3 == 0, size.cast("string")).otherwise(F.concat(F.lit("x"), size.cast("string")))).alias("safe"), tx.human_size(F.col("b")).alias("size"), tx.segment_tag(size / 2, F.lit(10.0)).alias("tag"), tx.frame_of_path(path).alias("frame"),
        tx.path_key(F.concat(F.lit("./x//"), key.cast("string"), F.lit(".png")), "/data").alias("key"), tx.portable_path(there, "/data").alias("portable"), tx.crop_filename(size, key, F.lit("torso"), F.lit("raw")).alias("file"), tx.number_region_path("/r/", size, key, F.lit(None).cast("string")).alias("region"))


@query(
    ROSTER
    + """SELECT team, number, count(*) OVER (PARTITION BY team, number) AS players, CAST(row_number() OVER (PARTITION BY team, number ORDER BY name, player_id) AS INTEGER) AS place, name
FROM roster QUALIFY players > 1"""
)
def roster_ambiguous(spark, d):
    """Numbers given twice in a team, each player a row in the order of names."""
    return votes.duplicates(roster(spark, d))


@query(ROSTER + "SELECT number, count(DISTINCT team) AS teams, count(*) AS players FROM roster GROUP BY number HAVING count(DISTINCT team) > 1")
def roster_shared(spark, d):
    """Numbers of several teams."""
    return votes.shared_numbers(roster(spark, d))


@query(ROSTER + """, l AS (SELECT s_suppkey AS lookup_id, s_nationkey + (CASE WHEN s_suppkey % 7 = 0 THEN 100 ELSE 0 END) AS team, CAST(s_suppkey % 103 AS INTEGER) AS number FROM supplier), c AS (SELECT team, number, count(*) AS n, min(player_id) AS one FROM roster GROUP BY 1, 2)
SELECT lookup_id, team, number, status, CASE status WHEN 'resolved' THEN 'exact_roster_lookup' WHEN 'ambiguous' THEN 'ambiguous' ELSE 'none' END AS confidence, CASE WHEN status NOT IN ('invalid_number', 'team_not_found') THEN coalesce(n, 0) END AS candidate_count, CASE WHEN status = 'resolved' THEN one END AS player_id FROM (
SELECT lookup_id, l.team, l.number, n, one, CASE WHEN l.number NOT BETWEEN 0 AND 99 THEN 'invalid_number' WHEN l.team NOT IN (SELECT team FROM roster) THEN 'team_not_found' WHEN n IS NULL THEN 'number_not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM l LEFT JOIN c ON l.team = c.team AND l.number = c.number)""")
def roster_resolve(spark, d):
    """F16."""
    lookups = table(spark, d, "supplier").selectExpr("s_suppkey as lookup_id", "s_nationkey + case when s_suppkey % 7 = 0 then 100 else 0 end as team", "cast(s_suppkey % 103 as int) as number")
    return votes.resolve(lookups, roster(spark, d))


_CROP = BOX + """, crop AS (SELECT *, kind = 'R' AS torso, CAST(box * 14 + 20 AS BIGINT) AS w, CAST(part % 90 + 40 AS BIGINT) AS h, CAST(price AS DOUBLE) / 60 AS lap, CAST(y0 AS DOUBLE) * 8 AS std, CAST(x0 AS DOUBLE) / 50 AS signal, CAST(part % 100 AS DOUBLE) / 100 AS overlap, part % 5 = 0 AS cut, part % 13 <> 0 AS readable, CAST(part % 7 = 0 AS INTEGER) AS faces, CAST(part % 11 = 0 AS INTEGER) AS profiles, CAST(x0 AS DOUBLE) / 100 + 0.1 AS aspect, CAST(price AS DOUBLE) / 100000 AS quality FROM box),
v AS (SELECT *, greatest(0.0, least(1.0, std / 64)) AS plain, greatest(0.0, least(1.0, lap / (lap + 140))) AS sharp, CASE WHEN faces > 0 THEN 'front' WHEN profiles > 0 OR (aspect < 0.27 AND signal < 0.62) THEN 'side' WHEN signal >= 0.9 AND box BETWEEN 2 AND 4 AND std / 64 >= 0.6 AND aspect >= 0.33 THEN 'back' ELSE 'unknown' END AS view, greatest(0.0, least(1.0, CASE WHEN torso THEN least(w / 120.0, h / 100.0) ELSE least(w / 120.0, h / 160.0) END)) AS room FROM crop),
s AS (SELECT *, CASE WHEN readable THEN greatest(0.0, least(1.0, 0.22 * greatest(0.0, least(1.0, quality)) + 0.20 * sharp + 0.15 * plain + 0.14 * room + 0.21 * signal + 0.08 * (1 - overlap) - CASE WHEN view = 'side' THEN 0.07 ELSE 0.0 END)) ELSE 0.0 END AS score,
concat_ws(';', CASE WHEN CASE WHEN torso THEN w < 36 OR h < 32 ELSE w < 45 OR h < 70 END THEN 'low_resolution' END, CASE WHEN sharp < 0.24 THEN 'blurry' END, CASE WHEN plain < 0.12 THEN 'low_contrast' END, CASE WHEN overlap > 0.65 THEN 'high_bbox_overlap_occlusion_proxy' END) AS hard,
concat_ws(';', CASE WHEN cut THEN 'border_clipped' END, CASE WHEN signal < 0.38 THEN 'weak_number_region_signal' END, CASE WHEN view = 'side' THEN 'side_view_lower_priority' END) AS soft FROM v),
a AS (SELECT *, CASE WHEN readable AND hard = '' AND score >= 0.62 THEN 'ocr_ready' WHEN readable AND hard = '' AND score >= 0.5 THEN 'borderline' ELSE 'rejected' END AS status FROM s) """


def _audits(spark, d):
    c = F.col
    b = boxes(spark, d)
    crops = b.withColumns({
        "torso": c("kind") == "R", "width": (c("box") * 14 + 20).cast("long"), "height": (c("part") % 90 + 40).cast("long"), "laplacian_variance": c("price") / 60, "gray_std": c("y0") * 8, "signal": c("x0") / 50, "overlap": (c("part") % 100).cast("double") / 100,
        "border_clipped": c("part") % 5 == 0, "readable": c("part") % 13 != 0, "faces": (c("part") % 7 == 0).cast("int"), "profiles": (c("part") % 11 == 0).cast("int"), "aspect": c("x0") / 100 + 0.1, "source_quality": c("price") / 100000})
    view, region, sure = filters.estimated_view(c("faces"), c("profiles"), c("signal"), c("box"), c("gray_std") / 64, c("aspect"))
    return filters.audited(crops.withColumns({"view": view, "region": region, "sure": sure}), candidate=0.62, borderline=0.5)


@query(_CROP + """SELECT frame, part, box, view, CASE WHEN faces > 0 THEN 'chest' WHEN view = 'back' THEN 'back' ELSE 'unknown' END AS region, CASE WHEN faces > 0 OR profiles > 0 THEN 'medium' WHEN view IN ('side', 'back') THEN 'weak' ELSE 'none' END AS sure, round(score, 5) AS score, status, CASE WHEN NOT readable THEN 'crop_file_unreadable' WHEN status = 'ocr_ready' THEN '' WHEN status = 'borderline' THEN coalesce(nullif(soft, ''), 'below_candidate_threshold')
ELSE coalesce(nullif(concat_ws(';', nullif(hard, ''), nullif(soft, '')), ''), 'below_borderline_threshold') END AS reasons FROM a""")
def crop_audit(spark, d):
    """Lines of orders as crops; the bounds are lower than the defaults, as these crops are poor."""
    return _audits(spark, d).select("frame", "part", "box", "view", "region", "sure", F.round("audit_score", 5).alias("score"), F.col("audit_status").alias("status"), F.array_join("rejection_reasons", ";").alias("reasons"))


def _paths_sql(cond: str) -> str:
    return f"coalesce((SELECT string_agg(path, ',' ORDER BY score DESC, torso DESC, box, path) FROM (SELECT * FROM t WHERE t.track_id = g.track_id AND status = 'ocr_ready' AND {cond} ORDER BY score DESC, torso DESC, box, path LIMIT 3)), '')"


@query(_CROP + f""", t AS (SELECT part % 50 AS track_id, frame || '/' || part || '/' || box AS path, box, torso, status, view, round(score, 9) AS score FROM a), g AS (SELECT track_id, count(*) AS total, count(*) FILTER (status = 'ocr_ready') AS candidates, count(*) FILTER (status = 'ocr_ready' AND view = 'front') AS front, count(*) FILTER (status = 'ocr_ready' AND view = 'back') AS back, count(*) FILTER (status = 'borderline') AS borderline FROM t GROUP BY 1)
SELECT *, CASE WHEN candidates >= 3 THEN 'ready' WHEN candidates >= 1 OR borderline >= 2 THEN 'borderline' ELSE 'not_ready' END AS readiness, {_paths_sql("view = 'front'")} AS front_paths, {_paths_sql("true")} AS overall_paths FROM g""")
def track_visibility(spark, d):
    """C11, C12, G23."""
    a = _audits(spark, d).select((F.col("part") % 50).alias("track_id"), F.col("box").alias("frame"), "torso", F.concat_ws("/", F.col("frame").cast("string"), F.col("part").cast("string"), F.col("box").cast("string")).alias("crop_path"), "audit_status", F.col("view").alias("likely_view"), F.round("audit_score", 9).alias("score"))
    t = filters.audited_tracks(a)
    return t.select("track_id", "total", "candidates", "front", "back", "borderline", "readiness", F.array_join("best_front_paths", ",").alias("front_paths"), F.array_join("best_overall_paths", ",").alias("overall_paths"))


_EV = OBS + """, s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM obs WINDOW w AS (PARTITION BY track_id ORDER BY frame, event_id)),
f AS (SELECT *, x < 320 AND y < 90 AS inside FROM obs WHERE label <> 'view'), i AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step, x <= 25.6 OR x >= 294.4 OR y <= 7.2 OR y >= 82.8 AS edge FROM f WHERE inside WINDOW w AS (PARTITION BY track_id ORDER BY frame, event_id)),
o AS (SELECT track_id, count(*) AS n, min(frame) AS a, max(frame) AS b, avg(step) AS speed, coalesce(max(step), 0) AS jump, avg(x) AS sharp, avg(y) / 100 AS stripe, avg(score) AS sat FROM s GROUP BY 1), p AS (SELECT track_id, count(*) AS points FROM f GROUP BY 1), q AS (SELECT track_id, count(*) AS ins, coalesce(max(step), 0) AS fjump, avg(CAST(edge AS INTEGER)) AS edge FROM i GROUP BY 1), m AS (SELECT median(sat) AS base FROM o),
t AS (SELECT o.*, greatest(0, b - a + 1 - n) AS missing, coalesce(ins, 0) / greatest(1, coalesce(points, 0)) AS insh, (coalesce(points, 0) - coalesce(ins, 0)) / greatest(1, coalesce(points, 0)) AS outsh, coalesce(fjump, 0) AS fjump, edge, base FROM o LEFT JOIN p USING (track_id) LEFT JOIN q USING (track_id), m),
k AS (SELECT *, list_filter([CASE WHEN n < 60 THEN 'too_few_frames' END, CASE WHEN outsh > 0.5 THEN 'mostly_outside_field_bounds' END, CASE WHEN jump > 400 THEN 'unrealistic_image_jump' END, CASE WHEN fjump > 300 THEN 'unrealistic_field_jump' END, CASE WHEN missing >= greatest(3, n // 2) THEN 'many_missing_frames' END, CASE WHEN sharp < 18 THEN 'poor_crop_quality' END], lambda z: z IS NOT NULL) AS q,
 list_filter([CASE WHEN stripe >= 0.62 THEN 'striped_low_saturation_crop' END, CASE WHEN sat < least(55.0, 0.65 * base) THEN 'low_team_color_saturation' END, CASE WHEN stripe > 0.62 AND stripe > 0.12 THEN 'black_white_gray_appearance' END], lambda z: z IS NOT NULL) AS r, list_filter([CASE WHEN edge >= 0.32 THEN 'frequent_boards_sideline_region' END, CASE WHEN speed < 3 AND n >= 4 THEN 'very_low_motion' END], lambda z: z IS NOT NULL) AS x FROM t) """


@query(_EV + """SELECT track_id, n AS frame_count, CAST(missing AS BIGINT) AS missing_frames, round(speed, 4) AS speed, round(jump, 4) AS jump, round(fjump, 4) AS field_jump, round(insh, 6) AS inside_share, round(edge, 6) AS edge_share, array_to_string(q, ';') AS quality, array_to_string(r, ';') AS referee, array_to_string(x, ';') AS other FROM k""")
def track_flags(spark, d):
    """Evidence and flags per user."""
    t = _judged(spark, d, 320.0, 90.0)
    return t.select("track_id", "frame_count", F.col("missing_frames").cast("long").alias("missing_frames"), F.round("average_image_speed", 4).alias("speed"), F.round("maximum_image_jump", 4).alias("jump"), F.round("maximum_field_jump", 4).alias("field_jump"), F.round("inside_share", 6).alias("inside_share"), F.round("near_edge_share", 6).alias("edge_share"), *[F.array_join(f"{c}_flags", ";").alias(n) for c, n in (("quality", "quality"), ("referee", "referee"), ("non_player", "other"))])


def _judged(spark, d, width, height):
    o = observations(spark, d)
    none = F.lit(None).cast("double")
    seen = o.select("track_id", "frame", F.col("event_id").alias("at"), F.lit(100.0).alias("area"), F.col("x").alias("foot_x"), F.col("y").alias("foot_y"), none.alias("centroid_x"), none.alias("centroid_y"))
    field = o.where("label <> 'view'").select("track_id", "frame", F.col("event_id").alias("at"), "x", "y", ((F.col("x") < width) & (F.col("y") < height)).alias("inside"))
    evidence = filters.track_evidence(seen, field, width, height)
    looks = o.groupBy("track_id").agg(F.avg("x").alias("sharpness"), (F.avg("y") / 100).alias("stripe_score"), F.avg("score").alias("mean_saturation"))
    looks = looks.withColumns({"gray_share": F.col("stripe_score"), "dark_share": F.col("stripe_score"), "high_saturation": F.col("stripe_score") / 4})
    base = looks.agg(F.coalesce(F.median("mean_saturation"), F.lit(80.0)).alias("base"))  # one row
    met = evidence.join(looks, "track_id", "left").crossJoin(F.broadcast(base))
    return filters.judged_tracks(met, F.col("base"), least_frames=60, player_frames=4, image_jump=400.0, field_jump=300.0, edge_share=0.32)


_LABEL = "WITH raw AS (SELECT c_custkey AS id, c_custkey % 13 AS n, (c_custkey % 7) / 10.0 AS outside, c_custkey % 11 * 40.0 AS jump, c_custkey % 5 * 60.0 AS fjump, c_custkey % 6 AS missing, c_custkey % 29 AS sharp, (c_custkey % 17) / 17.0 AS stripe, c_custkey % 83 AS sat, (c_custkey % 19) / 18.0 AS gray, (c_custkey % 10) / 10.0 AS edge, c_custkey % 9 AS speed, (c_custkey % 23) / 100.0 AS colour, c_custkey % 31 = 0 AS bare FROM customer), f AS (SELECT *, list_filter([CASE WHEN n < 3 THEN 'too_few_frames' END, CASE WHEN outside > 0.5 THEN 'mostly_outside_field_bounds' END, CASE WHEN jump > 260 THEN 'unrealistic_image_jump' END, CASE WHEN fjump > 190 THEN 'unrealistic_field_jump' END, CASE WHEN missing >= greatest(3, n // 2) THEN 'many_missing_frames' END, CASE WHEN NOT bare AND sharp < 18 THEN 'poor_crop_quality' END], lambda z: z IS NOT NULL) AS q, list_filter([CASE WHEN NOT bare AND stripe >= 0.62 THEN 'striped_low_saturation_crop' END, CASE WHEN NOT bare AND sat < least(55.0, 0.65 * 60) THEN 'low_team_color_saturation' END, CASE WHEN NOT bare AND gray > 0.62 AND gray > 0.12 THEN 'black_white_gray_appearance' END], lambda z: z IS NOT NULL) AS r, list_filter([CASE WHEN edge >= 0.7 THEN 'frequent_boards_sideline_region' END, CASE WHEN speed < 3 AND n >= 4 THEN 'very_low_motion' END], lambda z: z IS NOT NULL) AS k FROM raw) "


@query(_LABEL + """, l AS (SELECT *, CASE WHEN len(q) >= 2 OR (n < 3 AND (outside > 0.25 OR jump > 260)) THEN 'low_quality' WHEN len(r) >= 2 AND len(q) = 0 THEN 'likely_referee' WHEN len(k) >= 2 THEN 'likely_non_player' WHEN n >= 4 AND 1 - outside >= 0.8 AND jump <= 260 AND fjump <= 190 AND len(r) < 2 THEN 'likely_player' ELSE 'uncertain' END AS label FROM f)
SELECT id, label, round(CASE label WHEN 'low_quality' THEN least(0.92, 0.58 + 0.12 * len(q)) WHEN 'likely_referee' THEN least(0.88, 0.56 + 0.10 * len(r)) WHEN 'likely_non_player' THEN least(0.82, 0.55 + 0.10 * len(k)) WHEN 'likely_player' THEN least(0.88, 0.68 + CASE WHEN NOT bare AND colour > 0.12 THEN 0.07 ELSE 0 END + CASE WHEN speed >= 5 THEN 0.05 ELSE 0 END) ELSE 0.45 + least(0.15, 0.03 * n) END, 6) AS confidence,
array_to_string(CASE label WHEN 'low_quality' THEN q WHEN 'likely_referee' THEN list_concat(r, CASE WHEN edge > 0.45 THEN ['some_boards_sideline_presence'] ELSE [] END) WHEN 'likely_non_player' THEN k WHEN 'likely_player' THEN list_concat(['persistent_in_bounds_track'], CASE WHEN NOT bare AND colour > 0.12 THEN ['visible_team_color_saturation'] ELSE [] END, CASE WHEN speed >= 5 THEN ['plausible_player_motion'] ELSE [] END) ELSE CASE WHEN len(q) > 0 THEN q WHEN len(r) > 0 THEN r WHEN len(k) > 0 THEN k ELSE ['insufficient_strong_evidence'] END END, ';') AS reasons FROM l""")
def quality_labels(spark, d):
    """Customers as tracks with made-up evidence, so that every label occurs."""
    key = F.col("c_custkey")
    own = lambda v: F.when(key % 31 != 0, v)
    t = table(spark, d, "customer").select(key.alias("id"), (key % 13).alias("frame_count"), ((key % 7) / 10.0).alias("outside_share"), (key % 11 * 40.0).alias("maximum_image_jump"), (key % 5 * 60.0).alias("maximum_field_jump"), (key % 6).alias("missing_frames"), ((key % 10) / 10.0).alias("near_edge_share"), (key % 9).cast("double").alias("average_image_speed"), own((key % 29).cast("double")).alias("sharpness"), own((key % 17) / 17.0).alias("stripe_score"), own((key % 83).cast("double")).alias("mean_saturation"), own((key % 19) / 18.0).alias("gray_share"), own((key % 19) / 18.0).alias("dark_share"), own((key % 23) / 100.0).alias("high_saturation"))
    t = filters.judged_tracks(t.withColumn("inside_share", 1 - F.col("outside_share")), F.lit(60.0))
    return t.select("id", "label", F.round("confidence", 6).alias("confidence"), F.array_join("reasons", ";").alias("reasons"))


_REG = OBS + ", r AS (SELECT track_id, frame // 24 AS frame, label AS variant, event_id, y % 10 AS source, score AS readiness, y > 50 AS torso FROM obs), g AS (SELECT track_id, frame, source, max(readiness) AS best, bool_or(torso) AS torso FROM r GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY track_id, frame ORDER BY best DESC, torso DESC, source) AS own FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY best DESC, torso DESC, frame, source) AS rank FROM o WHERE own = 1) "


@query(_REG + "SELECT r.track_id, r.event_id, r.variant, CAST(k.rank AS INTEGER) AS rank FROM r JOIN k USING (track_id, frame, source) WHERE rank <= 2")
def topk_groups_all(spark, d):
    """The two best sources of a track, one a frame, with all their variants."""
    o = observations(spark, d).select("track_id", F.expr("frame div 24").alias("frame"), F.col("label").alias("variant"), "event_id", (F.col("y") % 10).alias("source"), F.col("score").alias("readiness"), (F.col("y") > 50).alias("torso"))
    return select.best_sources(o, 2).select("track_id", "event_id", "variant", "rank")


@query(OBS + ", p AS (SELECT track_id, frame, label AS path, score, event_id FROM obs), b AS (SELECT *, row_number() OVER (PARTITION BY track_id, path ORDER BY score DESC, event_id) AS own FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, event_id) AS rank FROM b WHERE own = 1) SELECT track_id, string_agg(path, ',' ORDER BY rank) AS paths FROM r WHERE rank <= 3 GROUP BY 1")
def best_paths(spark, d):
    """C13, C14."""
    return select.best_paths(observations(spark, d), ["track_id"], "label", "score", "event_id", 3).select("track_id", F.array_join("paths", ",").alias("paths"))


@query(BOX + ", c AS (SELECT part % 60 AS track_id, frame || '/' || part || '/' || box AS path, CAST(price AS DOUBLE) AS score, l AS dup FROM (SELECT *, row_number() OVER (PARTITION BY frame, part, box ORDER BY price, x0, y0) AS l FROM box)), t AS (SELECT DISTINCT track_id, dense_rank() OVER (ORDER BY track_id) AS o FROM c), r AS (SELECT c.*, row_number() OVER (PARTITION BY c.track_id ORDER BY score DESC, path, dup) AS crop_rank FROM c JOIN t USING (track_id) WHERE t.o <= 12), u AS (SELECT track_id, path, min(crop_rank) AS crop_rank FROM r GROUP BY 1, 2) SELECT track_id, path, crop_rank FROM u QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY crop_rank) <= 4")
def selected_crops(spark, d):
    """The first twelve tracks, the four best distinct paths of each, with the rank before repeats went."""
    b = boxes(spark, d)
    dup = F.row_number().over(Window.partitionBy("frame", "part", "box").orderBy("price", "x0", "y0"))
    c = b.select((F.col("part") % 60).alias("track_id"), F.concat_ws("/", F.col("frame").cast("string"), F.col("part").cast("string"), F.col("box").cast("string")).alias("path"), F.col("price").alias("score"), dup.alias("dup"))
    return select.selected_crops(c, 12, 4).select("track_id", "path", F.col("crop_rank").cast("long").alias("crop_rank"))


@query(BOX + ", b AS (SELECT frame, part, box, (x1 - x0 + 1) * (y1 - y0 + 1) AS area FROM box) SELECT frame, arg_max(part, (round(area, 6), -box, -part)) AS part, round(max(area), 4) AS area, round(avg(area), 4) AS mean_area FROM b GROUP BY frame")
def best_detection(spark, d):
    """The largest box of a frame, the first on ties."""
    b = boxes(spark, d).withColumn("area", (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1))
    return b.groupBy("frame").agg(F.max_by("part", F.struct(F.round("area", 6).alias("a"), (-F.col("box")).alias("b"), (-F.col("part")).alias("p"))).alias("part"), F.round(F.max("area"), 4).alias("area"), F.round(F.avg("area"), 4).alias("mean_area"))


@query("SELECT d.doc_id, d.source, coalesce(l.quality, 0) AS quality, r.good AS readiness, CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS INTEGER) AS rank, count(*) OVER (PARTITION BY d.source) AS of FROM documents d JOIN labels l USING (doc_id) LEFT JOIN (SELECT source, count(*) AS good FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 AND quality = 1 GROUP BY 1 HAVING count(*) > 3) r ON r.source = d.source WHERE l.toxic = 0")
def ocr_ready_join(spark, d):
    """accepted rows with their crop, their track's readiness, their rank and their group's size."""
    docs, labels = table(spark, d, "documents").select("doc_id", "source", "n_chars"), table(spark, d, "labels")
    met = docs.join(labels, "doc_id")
    ready = met.where("toxic = 0 and quality = 1").groupBy("source").agg(F.count(F.lit(1)).alias("readiness")).where("readiness > 3")
    kept = met.where("toxic = 0")
    size = kept.groupBy("source").agg(F.count(F.lit(1)).alias("of"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return kept.withColumn("rank", rank).join(size, "source").join(ready, "source", "left").select("doc_id", "source", F.coalesce("quality", F.lit(0)).alias("quality"), "readiness", "rank", "of")


_FIVE = OBS + ", k AS (SELECT event_id, track_id, frame // 24 AS frame, y AS mask FROM obs), e AS (SELECT track_id, frame // 24 AS frame, y AS mask, max(score) AS v FROM obs WHERE label = 'purchase' GROUP BY 1, 2, 3), l AS (SELECT track_id, frame // 24 AS frame, arg_max(score, event_id) AS v FROM obs WHERE label = 'purchase' GROUP BY 1, 2), c AS (SELECT track_id, frame // 24 AS frame, count(*) AS n, max(score) AS best FROM obs WHERE label = 'click' GROUP BY 1, 2), v AS (SELECT track_id, frame // 24 AS frame, avg(y) AS a FROM obs WHERE label = 'view' GROUP BY 1, 2), f AS (SELECT frame // 24 AS frame, min(event_id) AS first FROM obs GROUP BY 1) "


@query(_FIVE + "SELECT k.event_id, coalesce(e.v, l.v) AS evidence, e.v IS NOT NULL AS exact, coalesce(c.n, 0) AS crops, round(v.a, 5) AS visibility, f.first AS decoded, greatest(c.best, v.a) AS readiness FROM k LEFT JOIN e USING (track_id, frame, mask) LEFT JOIN l ON l.track_id = k.track_id AND l.frame = k.frame LEFT JOIN c ON c.track_id = k.track_id AND c.frame = k.frame LEFT JOIN v ON v.track_id = k.track_id AND v.frame = k.frame LEFT JOIN f ON f.frame = k.frame")
def nested_evidence(spark, d):
    """Five sides, each aggregated first, the exact match before the last of the frame."""
    o = observations(spark, d).select("event_id", "track_id", F.expr("frame div 24").alias("frame"), F.col("y").alias("mask"), "label", "score")
    both = ["track_id", "frame"]
    p = o.where("label = 'purchase'")
    exact = p.groupBy(*both, "mask").agg(F.max("score").alias("v"))
    loose = joins.last_by(p.select(*both, F.col("score").alias("w"), "event_id"), both, "event_id").drop("event_id")
    clicks = o.where("label = 'click'").groupBy(*both).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))
    views = o.where("label = 'view'").groupBy(*both).agg(F.avg("mask").alias("a"))
    first = o.groupBy("frame").agg(F.min("event_id").alias("decoded"))
    met = o.select("event_id", *both, "mask").join(exact, [*both, "mask"], "left").join(loose, both, "left").join(clicks, both, "left").join(views, both, "left").join(first, "frame", "left")
    return met.select("event_id", F.coalesce("v", "w").alias("evidence"), F.col("v").isNotNull().alias("exact"), F.coalesce("n", F.lit(0)).alias("crops"), F.round("a", 5).alias("visibility"), "decoded", F.greatest("best", "a").alias("readiness"))


@query(OBS + ", i AS (SELECT frame, count(*) FILTER (label = 'purchase') AS inside, count(*) FILTER (label = 'click') AS outside, count(*) AS seen FROM obs GROUP BY 1), r AS (SELECT unnest(range(473300, 473900)) AS frame) SELECT r.frame, coalesce(seen, 0) AS expected, coalesce(inside, 0) AS inside, coalesce(outside, 0) AS outside, greatest(0, coalesce(seen, 0) - coalesce(inside, 0) - coalesce(outside, 0)) AS missing FROM r LEFT JOIN i USING (frame)")
def frame_accounting(spark, d):
    """every frame of the list, met or not."""
    frames = spark.range(473300, 473900).select(F.col("id").alias("frame"))
    o = observations(spark, d).groupBy("frame").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("label") == "purchase").alias("inside"), F.count_if(F.col("label") == "click").alias("outside"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return frames.join(o, "frame", "left").select("frame", zero("seen").alias("expected"), zero("inside").alias("inside"), zero("outside").alias("outside"), F.greatest(F.lit(0), zero("seen") - zero("inside") - zero("outside")).alias("missing"))


@query("WITH s AS (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'complete' WHEN 2 THEN 'valid_with_warnings' WHEN 3 THEN 'complete_with_warnings' WHEN 4 THEN 'ocr_unavailable' WHEN 5 THEN 'blocked' ELSE 'strange' END AS status, o_orderkey % 7 <> 0 AS found, o_orderkey % 14 = 0 AS broken FROM orders) SELECT id, CASE WHEN NOT found THEN 'missing' ELSE status END AS reported_status, CASE WHEN NOT found THEN 'missing' WHEN status = 'complete' THEN 'complete' WHEN status IN ('valid_with_warnings', 'complete_with_warnings') THEN 'complete_with_warnings' WHEN status IN ('ocr_unavailable', 'blocked') THEN 'blocked' ELSE 'available_with_nonstandard_status' END AS state, CASE WHEN NOT found AND broken THEN 'file_not_found' END AS error FROM s")
def stage_states(spark, d):
    """G32."""
    k = F.col("o_orderkey")
    status = F.when(k % 7 == 1, "complete").when(k % 7 == 2, "valid_with_warnings").when(k % 7 == 3, "complete_with_warnings").when(k % 7 == 4, "ocr_unavailable").when(k % 7 == 5, "blocked").when(k % 7 == 6, "strange")
    s = table(spark, d, "orders").select(k.alias("id"), status.alias("status"), (k % 7 != 0).alias("found"), F.when(k % 14 == 0, "file_not_found").alias("error"))
    return stages.stage_records(s)


@query("WITH c AS (SELECT conv_id, role || ':' || (turn % 3) AS item, turn FROM conversations UNION ALL SELECT conv_id, '', 1000 FROM conversations UNION ALL SELECT conv_id, 'final', 2000 + turn FROM conversations), f AS (SELECT conv_id, item, min(turn) AS t FROM c WHERE item <> '' GROUP BY 1, 2) SELECT conv_id, string_agg(item, ',' ORDER BY t, item) AS items, count(*) AS n FROM f GROUP BY 1")
def merged_limitations(spark, d):
    """Lists of several sources, merged in order without repeats and blanks."""
    c = table(spark, d, "conversations").select("conv_id", F.concat("role", F.lit(":"), (F.col("turn") % 3).cast("string")).alias("item"), "turn")
    rows = c.unionByName(c.select("conv_id", F.lit("").alias("item"), F.lit(1000).cast("long").alias("turn"))).unionByName(c.select("conv_id", F.lit("final").alias("item"), (F.col("turn") + 2000).alias("turn")))
    m = stages.merged_in_order(rows, ["conv_id"], "item", "turn")
    return m.select("conv_id", F.array_join("items", ",").alias("items"), F.size("items").cast("long").alias("n"))


@query("WITH a AS (SELECT doc_id FROM documents), b AS (SELECT doc_id + 5 AS doc_id FROM labels) SELECT (SELECT count(*) FROM a) AS left_rows, (SELECT count(*) FROM b) AS right_rows, (SELECT count(*) FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)) AS left_only, (SELECT count(*) FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)) AS right_only, 0 AS left_repeats, 0 AS right_repeats, false AS equal_sets, (SELECT count(*) FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)) = 0 AS subset")
def id_checks(spark, d):
    """Counts, uniqueness, equality and inclusion of two sets of ids, in one row."""
    return stages.id_checks(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select((F.col("doc_id") + 5).alias("doc_id")), "doc_id")


@query("WITH v AS (SELECT p_partkey, list_distinct(['raw', 'gray', CASE WHEN p_size % 2 = 0 THEN 'sharp' ELSE 'raw' END]) AS got FROM part) SELECT p_partkey, list_contains(got, 'sharp') AS complete, NOT list_contains(got, 'sharp') AS apart FROM v")
def variant_contract(spark, d):
    """Generated names against the wanted ones."""
    got = F.array(F.lit("raw"), F.lit("gray"), F.when(F.col("p_size") % 2 == 0, "sharp").otherwise("raw"))
    return table(spark, d, "part").select("p_partkey", stages.same_names(got, ["gray", "raw", "sharp"]).alias("complete"), (~F.arrays_overlap(got, F.array(F.lit("sharp")))).alias("apart"))


@query(OBS + ", k AS (SELECT DISTINCT frame // 48 AS frame, 'seen' AS name, frame % 48 > 100 AS x FROM obs), m AS (SELECT frame, name FROM k UNION ALL SELECT a.frame, 'added' FROM (SELECT unnest([9861, 9999, 10001]) AS frame) a WHERE a.frame NOT IN (SELECT frame FROM k)) SELECT m.frame, name, p.first AS path FROM m LEFT JOIN (SELECT frame // 48 AS frame, min(event_id) AS first FROM obs GROUP BY 1) p USING (frame)")
def keyframe_config(spark, d):
    """Keyframes with some added where absent, and their frames' paths."""
    o = observations(spark, d)
    have = o.select(F.expr("frame div 48").alias("frame")).distinct().withColumn("name", F.lit("seen"))
    wanted = spark.createDataFrame([(f,) for f in (9861, 9999, 10001)], "frame long").withColumn("name", F.lit("added"))
    paths = o.groupBy(F.expr("frame div 48").alias("frame")).agg(F.min("event_id").alias("path"))
    return stages.with_absent(have, wanted, ["frame"]).join(paths, "frame", "left")


@query(OBS + ", m AS (SELECT track_id, frame // 24 AS frame, CAST(y AS BIGINT) % 4 AS cell, x, score FROM obs), g AS (SELECT frame // 24 AS frame, CAST(y AS BIGINT) % 4 AS cell, x AS p, score AS conf FROM obs WHERE label = 'purchase') SELECT m.frame, m.cell, count(*) AS n, round(avg(g.p), 4) AS mean, round(max(g.p) - min(g.p), 4) AS spread FROM (SELECT DISTINCT frame, cell FROM m) m JOIN g USING (frame, cell) WHERE isfinite(g.p) AND g.conf >= 20 GROUP BY 1, 2")
def mask_fusion(spark, d):
    """Points of a frame's mask cells with enough confidence."""
    o = observations(spark, d).select(F.expr("frame div 24").alias("frame"), (F.col("y").cast("long") % 4).alias("cell"), "x", "score", "label")
    masks = o.select("frame", "cell").distinct()
    grid = o.where("label = 'purchase'").select("frame", "cell", F.col("x").alias("p"), F.col("score").alias("conf"))
    finite = ~F.isnan("p") & (F.abs("p") < float("inf"))
    return masks.join(grid.where(finite & (F.col("conf") >= 20)), ["frame", "cell"]).groupBy("frame", "cell").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 4).alias("mean"), F.round(F.max("p") - F.min("p"), 4).alias("spread"))


@query(OBS + ", t AS (SELECT DISTINCT track_id FROM obs), p AS (SELECT track_id, string_agg(event_id, ',' ORDER BY event_id) AS paths FROM obs WHERE label = 'purchase' AND score > 60 GROUP BY 1) SELECT track_id, coalesce(paths, '') AS paths FROM t LEFT JOIN p USING (track_id)")
def track_crops(spark, d):
    """crops listed by track, none where it has none."""
    o = observations(spark, d)
    rows = o.where("label = 'purchase' and score > 60").select("track_id", "event_id")
    met = joins.attached(o.select("track_id").distinct(), rows, ["track_id"], ["event_id"], "paths", 1 << 30)
    return met.select("track_id", F.array_join(F.transform("paths", lambda e: e["event_id"].cast("string")), ",").alias("paths"))


@query("SELECT n_nationkey, concat_ws(';', CASE WHEN n_nationkey % 4 = 0 THEN 'schema must be a non-empty string' END, CASE WHEN n_nationkey % 5 = 0 THEN 'team.abbreviation must be a non-empty string' END, CASE WHEN n_nationkey % 6 = 0 THEN 'players[0].position must be a non-empty string' END, CASE WHEN n_nationkey % 3 = 0 THEN 'players[1].number jersey number must be between 0 and 99' WHEN n_nationkey % 3 = 1 THEN 'players[1].number jersey number must be an integer or digit string' END) AS errors FROM nation")
def roster_errors(spark, d):
    """Nations as roster documents with faults."""
    k = F.col("n_nationkey")
    blank = lambda n, v: F.when(k % n == 0, " ").otherwise(v)
    number = F.when(k % 3 == 0, "100").when(k % 3 == 1, "x7").otherwise("07")
    players = F.array(F.struct(F.lit("A").alias("name"), blank(6, "goal").alias("position"), F.lit("5").alias("number")), F.struct(F.lit("B").alias("name"), F.lit("wing").alias("position"), number.alias("number")))
    doc = table(spark, d, "nation").select(k, blank(4, "v1").alias("schema"), F.struct(F.col("n_name").alias("name"), blank(5, "ABC").alias("abbreviation"), F.lit("http").alias("source_url")).alias("team"), players.alias("players"))
    return doc.select(k, F.array_join(stages.roster_faults(F.col("schema"), F.col("team"), F.col("players")), ";").alias("errors"))


@query(OBS + "SELECT event_id, CASE WHEN track_id % 4 = 0 THEN frame ELSE frame + 1 END AS frame_index, round(x / 200 * 1600, 4) AS px, round(y / 85 * 700, 4) AS py, x BETWEEN 0 AND 200 AND y BETWEEN 0 AND 85 AS in_feet, x / 200 * 1600 BETWEEN 0 AND 1600 AND y / 85 * 700 BETWEEN 0 AND 700 AS in_bounds FROM obs WHERE label <> 'error'")
def feet_points(spark, d):
    """Nested frames of players, unnested under either spelling and brought to template pixels."""
    from ..sources import adapted_feet

    o = observations(spark, d)
    xy = F.when(F.col("label") != "error", F.array("x", "y"))
    none = F.lit(None).cast("long")
    docs = o.select(F.lit("v1").alias("schema"), F.array(F.struct(F.when(F.col("track_id") % 4 == 0, F.col("frame")).alias("frame"), F.when(F.col("track_id") % 4 != 0, F.col("frame") + 1).alias("frame_index"), F.lit(None).cast("double").alias("timestamp_sec"), F.lit(None).cast("double").alias("time_sec"), F.lit(None).cast("double").alias("timestamp"), F.array(F.struct(none.alias("object_id"), F.col("event_id").alias("track_id"), none.alias("id"), xy.alias("floor_xy_ft"), F.lit("x").alias("source"), F.lit("t").alias("team"))).alias("players"))).alias("frames"))
    return adapted_feet(docs).select(F.col("track_id").alias("event_id"), "frame_index", F.round("x", 4).alias("px"), F.round("y", 4).alias("py"), "in_feet", "in_bounds")


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'given' WHEN 1 THEN 'unknown_frames_players_floor_xy' WHEN 2 THEN 'unknown' WHEN 3 THEN NULL ELSE NULL END AS kind, CASE doc_id % 5 WHEN 3 THEN 'top_level_json_is_not_an_object' WHEN 4 THEN 'invalid_json' END AS error, CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS records FROM documents")
def json_states(spark, d):
    """Texts as JSON documents, with what is wrong and what they hold."""
    from ..sources import read_state

    k = F.col("doc_id") % 5
    raw = F.when(k == 0, '{"schema": "given", "crops": [{"a": 1}, 7, {"a": 2}]}').when(k == 1, '{"frames": [{"players": []}], "predictions": [{"a": 1}]}').when(k == 2, '{"x": 1}').when(k == 3, "[1, 2]").otherwise('{"x": ')
    return read_state(table(spark, d, "documents").select("doc_id", raw.alias("raw")), "raw").select("doc_id", "kind", "error", "records")


@query(OBS + ", f AS (SELECT frame, 29.97 + frame % 3 AS fps, count(*) AS n FROM obs GROUP BY 1), s AS (SELECT *, greatest(1, CAST(round_even(fps / 7, 0) AS BIGINT)) AS step FROM f) SELECT frame, step, n / fps AS duration, CAST(floor(greatest(0, 1.5) * fps) AS BIGINT) AS start, CAST(least(n, floor(1.5 * fps) + ceil(greatest(0, 0.7) * fps)) AS BIGINT) AS stop FROM s")
def clip_bounds(spark, d):
    """Strides and slices out of frame rates; half-even steps."""
    o = observations(spark, d).groupBy("frame").agg(F.count(F.lit(1)).alias("n")).withColumn("fps", F.lit(29.97) + F.col("frame") % 3)
    start, stop = select.clip_bounds(F.lit(1.5), F.lit(0.7), F.col("fps"), F.col("n"))
    return o.select("frame", select.stride(F.col("fps"), F.lit(7.0)).alias("step"), select.duration(F.col("n"), F.col("fps")).alias("duration"), start.alias("start"), stop.alias("stop"))


@query("WITH p AS (SELECT p_partkey, p_size / 4.0 AS d FROM part), t AS (SELECT p_partkey, d, unnest(range(0, CAST(least(5, floor(d / 2.5) + 1) AS BIGINT))) AS k FROM p) SELECT p_partkey, k, CAST(least(greatest(round_even(k * 2.5 * 3, 0), 0), floor(d * 3)) AS BIGINT) AS frame FROM t")
def scout_frames(spark, d):
    """A frame every two and a half seconds, five at most."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 4.0).alias("d"))
    last = F.floor(F.col("d") * 3)
    at = select.interval_frames(F.col("d"), F.lit(2.5), F.lit(3.0), last, 5)
    return p.select("p_partkey", F.posexplode(at).alias("k", "frame")).select("p_partkey", F.col("k").cast("long").alias("k"), F.col("frame").cast("long").alias("frame"))


@query("WITH a AS (SELECT p_partkey, p_size, unnest(range(1, 4)) AS i FROM part), c AS (SELECT p_partkey, i, CASE WHEN i = 1 THEN CAST(p_size AS VARCHAR) WHEN i = 2 AND p_size % 2 = 0 THEN CAST(p_size + 1 AS VARCHAR) WHEN i = 3 AND p_size % 3 = 0 THEN CAST(p_size + 2 AS VARCHAR) END AS n, CASE WHEN i = 1 THEN 0.5 WHEN i = 2 THEN 0.25 END AS s FROM a) SELECT p_partkey, string_agg(n || ':' || coalesce(CAST(CAST(s AS DOUBLE) AS VARCHAR), '-'), ',' ORDER BY i) AS candidates FROM c WHERE n IS NOT NULL GROUP BY 1")
def candidate_lists(spark, d):
    """Candidates under their several spellings."""
    s = F.col("p_size").cast("string")
    one = lambda number, jersey, candidate, confidence, score: F.struct(number.alias("number"), jersey.alias("jersey_number"), candidate.alias("candidate_number"), confidence.alias("confidence"), score.alias("score"), none_d.alias("weighted_vote"))
    none, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    raw = F.array(one(s, none, none, F.lit(0.5), none_d), one(none, F.when(F.col("p_size") % 2 == 0, (F.col("p_size") + 1).cast("string")), none, none_d, F.lit(0.25)), one(none, none, F.when(F.col("p_size") % 3 == 0, (F.col("p_size") + 2).cast("string")), none_d, none_d))
    listed = F.transform(stages.candidates(raw), lambda c: F.concat(c["number"], F.lit(":"), F.coalesce(c["confidence"].cast("string"), F.lit("-"))))
    return table(spark, d, "part").select("p_partkey", F.array_join(listed, ",").alias("candidates"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN 0.0 END, CASE WHEN doc_id % 3 = 0 THEN 0.5 END, n_chars / 1000.0, 0) AS score, greatest(0.0, least(1.0, n_chars / 1000.0)) AS clipped FROM documents")
def readiness_chain(spark, d):
    """The first value that is there, zero included."""
    k = F.col("doc_id")
    n = F.col("n_chars") / 1000.0
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.when(k % 4 == 0, 0.0), F.when(k % 3 == 0, 0.5), n, F.lit(0.0)).alias("score"), pt.clipped(n).alias("clipped"))
