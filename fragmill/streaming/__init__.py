"""Streams of queries against a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fragmill.plans.staged import Index, staged


def search_stream(arriving: DataFrame, index: Index, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Searches queries as they arrive and appends their hits to Parquet at `path`.

    arriving: settings of a query and its peaks array<struct<peak_id, mass, v>>. Queries hold no state: a batch is
    searched like a table, under its id, so a batch that is run again after a failure replaces its own hits.
    """

    def run(batch: DataFrame, number: int) -> None:
        queries = batch.drop("peaks")
        peaks = batch.select("query_id", F.explode("peaks").alias("p")).select("query_id", "p.*")
        hits, _ = staged(queries, peaks, index)
        hits.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = arriving.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
