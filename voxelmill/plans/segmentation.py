"""Queries of the segmentation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segmentation as S
from . import projection as V
from .views import HITS, POINTS, hits, micro, micros, points

_VOTES = f"{HITS}, votes AS (SELECT point_id, class_id, COUNT(*) AS cnt FROM hits WHERE class_id > 0 AND class_id < 128 GROUP BY point_id, class_id)"
_RANKED = f"{_VOTES}, ranked AS (SELECT point_id, class_id, LEAST(cnt, 65535) AS cnt, ROW_NUMBER() OVER (PARTITION BY point_id ORDER BY cnt DESC, class_id) AS rk FROM votes)"
_VOXELS = f"""{POINTS}, {_RANKED},
    bb AS (SELECT MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1, MIN(z) AS z0, MAX(z) AS z1 FROM points),
    g AS (SELECT *, {", ".join(f"GREATEST(1, LEAST(64, CAST(FLOOR(({c}1 - {c}0) / 0.5e0 + 0.5e0) AS BIGINT))) AS g{c}" for c in "xyz")} FROM bb),
    pv AS (SELECT point_id, {", ".join(f"LEAST(CAST(FLOOR(({c} - {c}0) / ({c}1 - {c}0) * g{c}) AS BIGINT), g{c} - 1) AS v{c}" for c in "xyz")} FROM points, g),
    vv AS (SELECT vx, vy, vz, class_id, COUNT(*) AS cnt FROM pv JOIN ranked r ON r.point_id = pv.point_id AND rk = 1 GROUP BY vx, vy, vz, class_id),
    vw AS (SELECT vx, vy, vz, class_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vx, vy, vz ORDER BY cnt DESC, class_id) AS k FROM vv) s WHERE k = 1)"""


def _votes(spark, d):
    return S.vote_histogram(hits(spark, d), S.n_classes(hits(spark, d)))


def seg_votes(spark, d):
    return _votes(spark, d)


def seg_simple(spark, d):
    return S.label_simple(points(spark, d), _votes(spark, d))


def seg_top3(spark, d):
    return S.ranked(_votes(spark, d))


def seg_voxel_winner(spark, d):
    return S.voxel_winner(S.voxel_votes(S.voxel_of(points(spark, d), classes=S.n_classes(hits(spark, d))), S.ranked(_votes(spark, d))))


def seg_spatial_refine(spark, d):
    return S.spatial_refine(points(spark, d), _votes(spark, d), classes=S.n_classes(hits(spark, d)))


def seg_survey_classes(spark, d):
    """Points of 200 classes by their survey class."""
    labels = points(spark, d).select((F.col("point_id") % 200).cast("int").alias("class_id"))
    return labels.select("class_id", S.survey_class(F.col("class_id")).alias("survey_class")).groupBy("class_id", "survey_class").agg(F.count("*").alias("n"))


def seg_votes_of_masks(spark, d):
    """Votes of three masks; one image has no known camera, one no raster."""
    from ..operators import projection as P
    from ..operators.cameras import camera_of_row
    from .projection import H, W, two_cameras

    seen = P.pixels(P.seen_by(points(spark, d), two_cameras(spark)), camera_of_row(), W, H).withColumn("z", micros(F.col("z")))
    raster = P.z_buffer(seen, by=("view", "px", "py")).select(F.format_string("m%d.png", "view").alias("name"), "px", "py", "point_id")
    cells = spark.range(W * H).select((F.col("id") % W).cast("int").alias("px"), F.floor(F.col("id") / W).cast("int").alias("py"))
    masks = cells.withColumn("name", F.explode(F.array(*(F.lit(f"m{k}.png") for k in (0, 1, 2))))).withColumn("class_id", (F.col("px") + F.col("py")) % 7)
    images = spark.createDataFrame([("m0.png", "1"), ("m1.png", "9"), ("m2.png", "1")], "name string, camera_id string")
    cameras = spark.createDataFrame([("1",), ("2",)], "camera_id string")
    return S.vote_histogram(S.votes_of_masks(raster, masks, images, cameras))


def seg_first_of_color(spark, d):
    """Winners named by colour, on a palette of whose 256 colours many are one."""
    from ..functions import color

    winners = points(spark, d).select("point_id", (F.col("point_id") % 256).cast("int").alias("class_id"))
    return S.first_class_of_color(winners, color.palette(spark)).groupBy("class_id").agg(F.count("*").alias("n"))


def seg_palette_index(spark, d):
    """Colours of classes beyond the palette: by their low byte."""
    from ..functions import color

    labels = points(spark, d).select((F.col("point_id") % 700).cast("int").alias("class_id"))
    return S.shown_classes(labels, color.palette(spark)).groupBy("class_id", "rgba").agg(F.count("*").alias("n"))


def seg_n_classes(spark, d):
    return S.n_classes(hits(spark, d))


def seg_present(spark, d):
    from .views import table

    mapping = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("class_id"), F.col("n_name").alias("name"))
    return S.present_classes(mapping, hits(spark, d))


#: The same fixed values as the operator's, written out for the SQL.
_CASE = """WHEN class_id IN (48, 49, 50, 58, 71, 97, 110, 150, 92, 155, 86, 91, 133, 90, 113, 84, 87, 57, 118, 121, 122, 75, 76) THEN 2 WHEN class_id IN (60, 105, 104, 70, 130, 134, 16) THEN 3 WHEN class_id = 47 THEN 4
    WHEN class_id IN (171, 80) THEN 5 WHEN class_id IN (1, 63, 62, 59, 73, 112, 119, 120, 136, 174, 68, 74, 81, 82, 184, 51, 107, 117, 149, 156, 157, 187, 181, 182) THEN 6 WHEN class_id IN (61, 94) THEN 9 WHEN class_id IN (40, 41, 83, 185) THEN 18"""
QUERIES = {f.__name__: f for f in (seg_votes, seg_simple, seg_top3, seg_voxel_winner, seg_spatial_refine, seg_survey_classes, seg_n_classes, seg_present, seg_votes_of_masks, seg_first_of_color, seg_palette_index)}
ORACLE_SQL = {
    "seg_votes": f"WITH {_VOTES} SELECT point_id, class_id, cnt FROM votes",
    "seg_simple": f"WITH {POINTS}, {_RANKED} SELECT p.point_id, CAST(COALESCE(r.class_id, 0) AS INT) AS class_id FROM points p LEFT JOIN ranked r ON r.point_id = p.point_id AND r.rk = 1",
    "seg_top3": f"WITH {_RANKED} SELECT point_id, class_id, CAST(cnt AS BIGINT) AS cnt, CAST(rk AS INT) AS rk FROM ranked WHERE rk <= 3",
    "seg_voxel_winner": f"WITH {_VOXELS} SELECT vx, vy, vz, class_id FROM vw",
    "seg_spatial_refine": f"""WITH {_VOXELS},
        cand AS (SELECT pv.*, r.class_id, r.cnt, r.rk, SUM(r.cnt) OVER (PARTITION BY pv.point_id) + 1 AS tot FROM pv JOIN ranked r ON r.point_id = pv.point_id AND r.rk <= 3),
        o AS (SELECT range - 1 AS o FROM range(3)),
        sup AS (SELECT c.point_id, c.rk, COUNT(vw.class_id) AS s FROM cand c CROSS JOIN o ox CROSS JOIN o oy CROSS JOIN o oz
            LEFT JOIN vw ON vw.vx = c.vx + ox.o AND vw.vy = c.vy + oy.o AND vw.vz = c.vz + oz.o AND vw.class_id = c.class_id GROUP BY c.point_id, c.rk),
        best AS (SELECT c.point_id, c.class_id, ROW_NUMBER() OVER (PARTITION BY c.point_id ORDER BY CAST(c.cnt AS DOUBLE) / CAST(c.tot AS DOUBLE) * CAST(s.s + 1 AS DOUBLE) DESC, c.rk) AS k
            FROM cand c JOIN sup s ON s.point_id = c.point_id AND s.rk = c.rk)
        SELECT p.point_id, CAST(COALESCE(b.class_id, 0) AS INT) AS class_id FROM points p LEFT JOIN best b ON b.point_id = p.point_id AND b.k = 1""",
    "seg_survey_classes": f"WITH {POINTS}, l AS (SELECT CAST(point_id % 200 AS INT) AS class_id FROM points) SELECT class_id, CAST(CASE {_CASE} ELSE 1 END AS INT) AS survey_class, COUNT(*) AS n FROM l GROUP BY 1, 2",
    "seg_votes_of_masks": f"""WITH {POINTS}, {V.sql_clip()}, s AS (SELECT point_id, {V.PIXEL}, {micro('cz / cw')} AS z FROM clip WHERE {V.SEEN}), r AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY px, py ORDER BY z, point_id) AS k FROM s) q WHERE k = 1)
        SELECT point_id, (px + py) % 7 AS class_id, COUNT(*) AS cnt FROM r WHERE (px + py) % 7 > 0 GROUP BY 1, 2""",
    "seg_first_of_color": f"WITH {POINTS}, pal AS ({V.PALETTE}), f AS (SELECT class_id, MIN(class_id) OVER (PARTITION BY rgba) AS first FROM pal) SELECT first AS class_id, COUNT(*) AS n FROM points JOIN f ON f.class_id = point_id % 256 GROUP BY 1",
    "seg_palette_index": f"WITH {POINTS}, pal AS ({V.PALETTE}) SELECT CAST(point_id % 700 AS INT) AS class_id, rgba, COUNT(*) AS n FROM points JOIN pal ON pal.class_id = (point_id % 700) & 255 GROUP BY 1, 2",
    "seg_n_classes": f"WITH {HITS} SELECT CAST(GREATEST(128, MAX(class_id) + 1) AS BIGINT) AS n_classes FROM hits",
    "seg_present": f"WITH {HITS} SELECT CAST(n_nationkey AS BIGINT) AS class_id, n_name AS name FROM nation WHERE n_nationkey IN (SELECT class_id FROM hits)",
}
