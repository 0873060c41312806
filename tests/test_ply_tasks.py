"""Small ranges of vertex files share tasks; lines of a text file are joined by many tasks."""

from voxelmill.sources import files, ply


def test_small_ranges_share_tasks(spark, tmp_path):
    files.register(spark)
    n = 3000
    head = f"ply\nformat ascii 1.0\nelement vertex {n}\n" + "".join(f"property float {c}\n" for c in "xyz") + "end_header\n"
    lines = spark.range(n, numPartitions=5).selectExpr("id AS piece", "concat_ws(' ', id, id + 0.5, 2) AS line")
    pieces = ply.text_pieces(lines, "t.ply")
    assert pieces.count() < 100
    ends = spark.createDataFrame([("t.ply", -1, head.encode())], "name string, piece long, content binary")
    pieces.unionByName(ends).transform(files.by_file("name", "piece")).write.format("pieces").mode("append").save(str(tmp_path))
    back = ply.read_ranges(spark, str(tmp_path), range_bytes=100)  # some 450 ranges
    assert back.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert sorted((r.point_id, r.x, r.y, r.z) for r in back.collect()) == [(k, float(k), k + 0.5, 2.0) for k in range(n)]


def test_tasks_follow_bytes(spark):
    few = 2 * spark.sparkContext.defaultParallelism
    assert [ply._tasks(spark, *a) for a in ((0, 0.0), (3, 1e9), (200_000, 1e6), (200_000, 1e12))] == [1, 3, few, int(1e12) // ply.RANGE_BYTES]
