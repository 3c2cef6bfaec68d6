"""The batch operators over file streams: each micro-batch lands once and merges into its keyed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lakeloom.operators import merge


def text_feed(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Lines of files that arrive in a folder, as a stream (column ``value``); parse with the readers' ``parse_*`` functions."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def merge_stream(rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], version: Sequence[str], partition: str | None = None) -> StreamingQuery:
    """Merge what has arrived into the table at ``path`` and end: newest row of each key.

    The checkpoint remembers the files that were read, so that each is merged once; a batch that is repeated after a failure
    changes nothing, since a merge with its own rows is the same table.
    """

    def merge_batch(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        if partition:
            merge.merge_partitioned(batch, path, keys, version, partition)
        else:
            merge.merge_snapshot(batch, path, keys, version)

    return rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(merge_batch).start()
