"""Running votes equal the batch histogram of all that has arrived."""

from pyspark.sql import functions as F

from voxelmill.operators import segmentation as S
from voxelmill.streaming import votes

SCHEMA = "point_id long, class_id int"


def counted(df):
    return sorted((r.point_id, r.class_id, r.cnt) for r in df.collect())


def test_running_votes_go_on_after_a_restart(spark, tmp_path):
    folder, all_rows = str(tmp_path / "hits"), []
    for part, rows in enumerate(([(1, 2), (1, 2), (2, 0), (3, None)], [(1, 2), (2, 5)])):
        all_rows += rows
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        hits = spark.readStream.schema(SCHEMA).parquet(folder)
        query = votes.votes_into(hits, str(tmp_path / "state"), str(tmp_path / "out"), availableNow=True)
        query.awaitTermination(120)
        batch = spark.read.parquet(str(tmp_path / "out")).where(f"batch = {part}")
        assert counted(batch) == ([(1, 2, 2)] if part == 0 else [(1, 2, 3), (2, 5, 1)])
    every = spark.read.parquet(str(tmp_path / "out")).groupBy("point_id", "class_id").agg(F.max_by("cnt", "batch").alias("cnt"))
    assert counted(every) == counted(S.vote_histogram(spark.createDataFrame(all_rows, SCHEMA)))
