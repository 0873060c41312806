"""Queries of the depth operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import depth as D
from .views import DEPTHS, depths, micro, micros, table

NEAR, FAR = 0.0, 30.0


def _smooth(spark, d):
    return D.smoothed(D.histogram(depths(spark, d), NEAR, FAR))


def depth_range(spark, d):
    return D.depth_range(depths(spark, d), NEAR, FAR)


def depth_histogram(spark, d):
    return D.histogram(depths(spark, d), NEAR, FAR).select("i", "c")


def depth_smooth(spark, d):
    return _smooth(spark, d).select("i", "c", "a")


def depth_peaks(spark, d):
    return D.peaks(_smooth(spark, d)).select("i", "a", micros(F.col("depth")).alias("depth"))


def _bins(spark, d):
    return D.bins(D.peaks(_smooth(spark, d)), NEAR, FAR)


def depth_bins(spark, d):
    return _bins(spark, d).select("bin_id", micros(F.col("start")).alias("bin_start"), micros(F.col("end")).alias("bin_end"))


def depth_bins_of_views(spark, d):
    """How many bins views have of which each sees one line of the orders' items, and where they begin and end; the items of the last lines lie beyond the range, so theirs is one bin."""
    line = F.col("l_linenumber").cast("int")
    seen = table(spark, d, "lineitem").select(line.alias("view"), (F.col("l_quantity") * 0.2 + F.col("l_discount") * 20.0 + 5.0 + F.when(line > 5, 100.0).otherwise(0.0)).alias("d"))
    by = ("view",)
    found = D.bins(D.peaks(D.smoothed(D.histogram(seen, NEAR, FAR, by), by), by=by), NEAR, FAR, by, seen)
    return found.groupBy("view").agg(F.count("*").alias("n"), micros(F.min("start")).alias("first"), micros(F.max("end")).alias("last"))


def depth_slices(spark, d):
    return D.sliced(depths(spark, d), _bins(spark, d)).groupBy("bin_id").agg(F.count("*").alias("n"))


_HIST = f"""{DEPTHS}, ok AS (SELECT d FROM depths WHERE d > 0 AND NOT isnan(d) AND d BETWEEN {NEAR}e0 AND {FAR}e0),
    r AS (SELECT GREATEST({NEAR}e0, MIN(d) * 0.95e0) AS n, LEAST({FAR}e0, MAX(d) * 1.05e0) AS f, COUNT(*) AS in_view FROM ok),
    h AS (SELECT CAST(FLOOR((d - n) / (f - n) * 499) AS INT) AS i, COUNT(*) AS c FROM ok, r GROUP BY 1),
    hist AS (SELECT CAST(range AS INT) AS i, COALESCE(c, 0) AS c, n, f FROM range(500) LEFT JOIN h ON h.i = range CROSS JOIN r)"""
_SMOOTH = f"""{_HIST}, sm AS (SELECT i, c, n, f, CAST(SUM(c) OVER w AS DOUBLE) / CAST(COUNT(*) OVER w AS DOUBLE) AS a FROM hist WINDOW w AS (ORDER BY i ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING))"""
_PEAKS = f"""{_SMOOTH}, lg AS (SELECT *, LAG(a) OVER (ORDER BY i) AS b, LEAD(a) OVER (ORDER BY i) AS e FROM sm),
    peaks AS (SELECT i, a, n + CAST(i AS DOUBLE) / 500 * (f - n) AS depth FROM lg WHERE a > b AND a > e ORDER BY a DESC, i LIMIT 12)"""
_BINS = f"""{_PEAKS}, ord AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY depth) - 1 AS INT) AS k, depth, LAG(depth) OVER (ORDER BY depth) AS p, LEAD(depth) OVER (ORDER BY depth) AS q FROM peaks),
    c0 AS (SELECT k, CASE WHEN p IS NULL THEN {max(0.0, NEAR * 0.5)}e0 ELSE (p + depth) / 2 END AS s, CASE WHEN q IS NULL THEN {FAR * 1.5}e0 ELSE (depth + q) / 2 END AS e FROM ord),
    rec(k, s, e, ps, pe) AS (SELECT k, s, e, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM c0 WHERE k = 0
        UNION ALL SELECT c.k, (r.e + c.s) / 2 - LEAST(c.e - c.s, r.e - r.s) * 0.1e0, c.e, r.s, (r.e + c.s) / 2 + LEAST(c.e - c.s, r.e - r.s) * 0.1e0 FROM rec r JOIN c0 c ON c.k = r.k + 1),
    bins AS (SELECT r.k AS bin_id, r.s AS s, COALESCE(nx.pe, r.e) AS e FROM rec r LEFT JOIN rec nx ON nx.k = r.k + 1)"""
QUERIES = {f.__name__: f for f in (depth_range, depth_histogram, depth_smooth, depth_peaks, depth_bins, depth_bins_of_views, depth_slices)}
ORACLE_SQL = {
    "depth_range": f"WITH {_HIST} SELECT n, f, in_view FROM r",
    "depth_histogram": f"WITH {_HIST} SELECT i, c FROM hist",
    "depth_smooth": f"WITH {_SMOOTH} SELECT i, c, a FROM sm",
    "depth_peaks": f"WITH {_PEAKS} SELECT i, a, {micro('depth')} AS depth FROM peaks",
    "depth_bins": f"WITH RECURSIVE {_BINS} SELECT bin_id, {micro('s')} AS bin_start, {micro('e')} AS bin_end FROM bins",
    "depth_bins_of_views": f"""WITH d AS (SELECT CAST(l_linenumber AS INT) AS view, l_quantity * 0.2e0 + l_discount * 20.0e0 + 5.0e0 + CASE WHEN l_linenumber > 5 THEN 100e0 ELSE 0e0 END AS d FROM lineitem), ok AS (SELECT * FROM d WHERE d > 0 AND d BETWEEN {NEAR}e0 AND {FAR}e0),
        r AS (SELECT view, GREATEST({NEAR}e0, MIN(d) * 0.95e0) AS n, LEAST({FAR}e0, MAX(d) * 1.05e0) AS f FROM ok GROUP BY view), h AS (SELECT ok.view, CAST(FLOOR((d - n) / (f - n) * 499) AS INT) AS i, COUNT(*) AS c FROM ok JOIN r USING (view) GROUP BY 1, 2),
        hist AS (SELECT r.view, CAST(range AS INT) AS i, COALESCE(c, 0) AS c FROM r CROSS JOIN range(500) LEFT JOIN h ON h.i = range AND h.view = r.view),
        sm AS (SELECT view, i, CAST(SUM(c) OVER w AS DOUBLE) / CAST(COUNT(*) OVER w AS DOUBLE) AS a FROM hist WINDOW w AS (PARTITION BY view ORDER BY i ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING)),
        lg AS (SELECT *, LAG(a) OVER (PARTITION BY view ORDER BY i) AS b, LEAD(a) OVER (PARTITION BY view ORDER BY i) AS e FROM sm), pk AS (SELECT view, LEAST(12, COUNT(*)) AS n FROM lg WHERE a > b AND a > e GROUP BY view)
        SELECT v.view, COALESCE(n, 1) AS n, 0 AS first, CASE WHEN n IS NULL THEN {int(FAR * 1e6)} ELSE {int(FAR * 1.5e6)} END AS last FROM (SELECT DISTINCT view FROM d) v LEFT JOIN pk USING (view)""",
    "depth_slices": f"WITH RECURSIVE {_BINS} SELECT bin_id, COUNT(*) AS n FROM depths JOIN bins ON d BETWEEN s AND e GROUP BY bin_id",
}
