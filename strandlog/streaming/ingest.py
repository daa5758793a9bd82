"""Streams of mutations into a table, each micro-batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandlog.table import Options, Table


def ingest(mutations: DataFrame, path: str, checkpoint: str, order_by: str, name: str = "ingest", options: Options = Options(),
           compact: bool = True, **trigger) -> StreamingQuery:
    """Applies a streaming (op, key, value, order) DataFrame to the table at ``path``.

    Every micro-batch is one run, published with its batch id: a batch that is replayed after a failure changes nothing.
    The source's own limits (such as maxFilesPerTrigger) are the back pressure; ``trigger`` goes to the writer.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        table = Table(batch.sparkSession, path, options).apply(batch, order_by, name, batch_id)
        if compact:
            table.maybe_compact()

    return (mutations.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
