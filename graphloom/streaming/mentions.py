"""Entity mentions from a stream of documents; every micro-batch is merged and written under its number.

Extraction looks at one document at a time, so it needs no state; merging over documents happens when the written
batches are read.  A batch that is run again after a failure overwrites its own folder and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphloom.models import OFFLINE, Provider
from graphloom.operators import extract


def write_mentions(docs: DataFrame, folder: str, checkpoint: str, provider: Provider = OFFLINE) -> StreamingQuery:
    def batch(rows: DataFrame, number: int) -> None:
        extract.merge_entities(extract.window_entities(extract.named_windows(extract.windows(rows), provider))).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
