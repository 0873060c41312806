"""Queries of the cloud operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cloud as C
from .views import POINTS, micro, micros, points, table


def cloud_thin(spark, d):
    return C.thinned(points(spark, d), 1000).select("point_id")


def cloud_every_tenth(spark, d):
    return C.every_tenth(points(spark, d).withColumn("idx", F.col("point_id"))).select("point_id", "id")


def cloud_downsample(spark, d):
    return C.downsampled(points(spark, d), 0.5).select("cx", "cy", "cz", "n", *(micros(F.col(c)).alias(c) for c in "xyz"))


def _marks(p):
    """The point with the lowest id of every voxel of half a unit."""
    return p.join(p.groupBy(*(F.floor(F.col(c) / 0.5).alias(f"c{c}") for c in "xyz")).agg(F.min("point_id").alias("point_id")).select("point_id"), "point_id", "left_semi")


def cloud_nearest(spark, d):
    p = points(spark, d)
    return C.nearest(p, _marks(p), 0.5).select("point_id", "other", micros(F.col("d")).alias("d"))


def cloud_within(spark, d):
    p = points(spark, d)
    return C.within(p, _marks(p), 0.5, 3).select("point_id", "other", micros(F.col("d")).alias("d"))


def cloud_adaptive_cells(spark, d):
    return C.adaptive_cells(points(spark, d), 3000).groupBy("cell_id").agg(F.count("*").alias("n"), F.min("point_id").alias("first"), F.max("point_id").alias("last"))


def cloud_missing(spark, d):
    o = points(spark, d).select(F.col("point_id").alias("image_id"))
    return C.missing(o, table(spark, d, "lineitem").where("l_quantity > 5").select(F.col("l_orderkey").alias("image_id")))


def cloud_queue(spark, d):
    return C.queue(points(spark, d).select(F.col("x").alias("distance"), F.col("point_id").alias("seq"))).withColumn("distance", micros(F.col("distance")))


def vector_neighbours(spark, d):
    v = table(spark, d, "embeddings")
    return C.nearest_vectors(v, v.where("vec_id % 50 = 0"), 5)


def cloud_without_outliers(spark, d):
    return C.without_outliers(points(spark, d), 8, 1.0).select("point_id")


def cloud_covariances(spark, d):
    """Spread of each voxel mean's neighbourhood."""
    small = C.downsampled(points(spark, d), 0.5).select(((F.col("cx") * 1000 + F.col("cy")) * 1000 + F.col("cz")).alias("point_id"), *"xyz")
    return C.covariances(small, 0.9).select("point_id", "n", *(micros(F.col(c)).alias(c) for c in ("xx", "xy", "xz", "yy", "yz", "zz")))


def _given_normals(spark, d):
    k = F.col("point_id")
    return points(spark, d).select("point_id", *((((k * m) % 41 - 22) / 20.0).alias(f"n{c}") for c, m in zip("xyz", (7, 13, 29))))


def normals_flipped(spark, d):
    """Normals that point down on average are all turned over."""
    return C.flipped_up(_given_normals(spark, d), "y").select("point_id", *(micros(F.col(f"n{c}")).alias(f"n{c}") for c in "xyz"))


def normal_stats(spark, d):
    return C.normal_stats(_given_normals(spark, d)).select(*(micros(F.col(c)).alias(c) for c in ("nx", "ny", "nz", "shortest", "longest")))


def completed_ids(spark, d):
    """Ids of orders whose line items weren't returned, once each."""
    from ..operators import projection as P

    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").cast("long").alias("seq"), (F.col("l_returnflag") == "R").alias("failed"))
    return P.completed(rows)


def cloud_normals(spark, d):
    """The whole chain: thin by voxels, estimate, orient, turn upwards, and hand the normals to every point."""
    p = points(spark, d)
    small = C.downsampled(p, 0.5).select(((F.col("cx") * 1000 + F.col("cy")) * 1000 + F.col("cz")).alias("point_id"), *"xyz")
    n = C.flipped_up(C.oriented(C.normals(small, 1.2), small, 1.2), "y")
    return C.transferred(p, small, n, 0.5).select("point_id", *(micros(F.col(f"n{c}")).alias(f"n{c}") for c in "xyz"))


QUERIES = {f.__name__: f for f in (cloud_thin, cloud_every_tenth, cloud_downsample, cloud_nearest, cloud_within, cloud_adaptive_cells, cloud_missing, cloud_queue, vector_neighbours, cloud_without_outliers, cloud_covariances, normals_flipped, normal_stats, completed_ids, cloud_normals)}
_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_MARKED = f"{POINTS}, l AS (SELECT * FROM points), r AS (SELECT * FROM points WHERE point_id IN (SELECT MIN(point_id) FROM points GROUP BY FLOOR(x / 0.5e0), FLOOR(y / 0.5e0), FLOOR(z / 0.5e0)))"
_NORMALS = f"{POINTS}, n AS (SELECT point_id, {', '.join(f'((point_id * {m}) % 41 - 22) / 20e0 AS n{c}' for c, m in zip('xyz', (7, 13, 29)))} FROM points)"
_SMALL = f"{POINTS}, sm AS (SELECT CAST((FLOOR(x / 0.5e0) * 1000 + FLOOR(y / 0.5e0)) * 1000 + FLOOR(z / 0.5e0) AS BIGINT) AS point_id, AVG(x) AS x, AVG(y) AS y, AVG(z) AS z FROM points GROUP BY FLOOR(x / 0.5e0), FLOOR(y / 0.5e0), FLOOR(z / 0.5e0))"
ORACLE_SQL = {
    "cloud_without_outliers": f"""WITH {POINTS}, pr AS (SELECT a.point_id, {_D} AS d, ROW_NUMBER() OVER (PARTITION BY a.point_id ORDER BY {_D}, b.point_id) AS k FROM points a JOIN points b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.z BETWEEN a.z - 1 AND a.z + 1),
        m AS (SELECT point_id, AVG(d) AS m FROM pr WHERE k <= 8 GROUP BY point_id), t AS (SELECT AVG(m) + 1.0e0 * stddev_samp(m) AS top FROM m) SELECT point_id FROM m, t WHERE m > 0 AND m < top""",
    "cloud_adaptive_cells": f"""WITH RECURSIVE {POINTS}, r AS (SELECT point_id, x, z, '' AS path, CAST(COUNT(*) OVER () AS BIGINT) AS n, MIN(x) OVER () AS x0, MAX(x) OVER () AS x1, MIN(z) OVER () AS z0, MAX(z) OVER () AS z1 FROM points
        UNION ALL SELECT point_id, x, z, path, CAST(COUNT(*) OVER p AS BIGINT), MIN(x) OVER p, MAX(x) OVER p, MIN(z) OVER p, MAX(z) OVER p FROM
        (SELECT point_id, x, z, path || CASE WHEN (CASE WHEN x1 - x0 >= z1 - z0 THEN x < (x0 + x1) / 2 ELSE z < (z0 + z1) / 2 END) THEN '0' ELSE '1' END AS path FROM r WHERE n > 3000) s WINDOW p AS (PARTITION BY path)),
        l AS (SELECT point_id, MAX(path) AS path FROM r GROUP BY point_id), c AS (SELECT path, COUNT(*) AS n, MIN(point_id) AS first, MAX(point_id) AS last FROM l GROUP BY path)
        SELECT ROW_NUMBER() OVER (ORDER BY path) - 1 AS cell_id, n, first, last FROM c""",
    "cloud_covariances": f"""WITH {_SMALL} SELECT a.point_id, COUNT(*) AS n, {', '.join(f"{micro(f'covar_pop(b.{p}, b.{q})')} AS {p}{q}" for p, q in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM sm a JOIN sm b ON {_D} <= 0.9e0 GROUP BY a.point_id""",
    "normals_flipped": f"WITH {_NORMALS}, m AS (SELECT CASE WHEN AVG(ny) < 0 THEN -1e0 ELSE 1e0 END AS s FROM n) SELECT point_id, {', '.join(micro(f'n{c} * s') + f' AS n{c}' for c in 'xyz')} FROM n, m",
    "normal_stats": f"WITH {_NORMALS} SELECT {', '.join(micro(f'AVG(n{c})') + f' AS n{c}' for c in 'xyz')}, {micro('MIN(sqrt(nx * nx + ny * ny + nz * nz))')} AS shortest, {micro('MAX(sqrt(nx * nx + ny * ny + nz * nz))')} AS longest FROM n",
    "completed_ids": "SELECT l_orderkey AS image_id, MIN(CAST(l_linenumber AS BIGINT)) AS seq FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey",
    "cloud_thin": f"WITH {POINTS} SELECT point_id FROM points ORDER BY (point_id * 2654435761 + 42) % 4294967296, point_id LIMIT 1000",
    "cloud_every_tenth": f"WITH {POINTS} SELECT point_id, point_id // 10 AS id FROM points WHERE point_id % 10 = 0",
    "cloud_downsample": f"WITH {POINTS} SELECT {', '.join(f'CAST(FLOOR({c} / 0.5e0) AS BIGINT) AS c{c}' for c in 'xyz')}, COUNT(*) AS n, {', '.join(f'{micro(f"AVG({c})")} AS {c}' for c in 'xyz')} FROM points GROUP BY 1, 2, 3",
    "cloud_nearest": f"WITH {_MARKED} SELECT point_id, other, {micro('d')} AS d FROM (SELECT a.point_id, b.point_id AS other, {_D} AS d, ROW_NUMBER() OVER (PARTITION BY a.point_id ORDER BY {_D}, b.point_id) AS k FROM l a, r b) s WHERE k = 1",
    "cloud_within": f"WITH {_MARKED} SELECT point_id, other, {micro('d')} AS d FROM (SELECT a.point_id, b.point_id AS other, {_D} AS d, ROW_NUMBER() OVER (PARTITION BY a.point_id ORDER BY {_D}, b.point_id) AS k FROM l a, r b WHERE {_D} <= 0.5e0) s WHERE k <= 3",
    "cloud_missing": f"WITH {POINTS} SELECT point_id AS image_id FROM points WHERE point_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 5)",
    "cloud_queue": f"WITH {POINTS} SELECT {micro('x')} AS distance, point_id AS seq FROM points",
    "vector_neighbours": """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0),
        p AS (SELECT query_id, vec_id, CAST(FLOOR((list_dot_product(e, e) + list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) - 2 * list_dot_product(e, CAST(embedding AS DOUBLE[]))) * 1e6 + 0.5e0) AS BIGINT) AS d2 FROM q, embeddings WHERE vec_id <> query_id),
        k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS rk FROM p) SELECT query_id, vec_id, CAST(rk AS INT) AS rk, d2 FROM k WHERE rk <= 5""",
}
