"""Votes that arrive as a stream: running histograms and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import segmentation as S


def votes_into(hits: DataFrame, checkpoint: str, folder: str, n_classes: int | None = None, **trigger) -> StreamingQuery:
    """Write each batch's changed votes to Parquet under ``folder``, a folder for each batch; a batch that is run again replaces its folder."""
    votes = S.vote_histogram(hits, n_classes)

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch}")

    writer = votes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
