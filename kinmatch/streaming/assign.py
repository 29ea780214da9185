"""Assignment of a stream of new records to known entities, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from kinmatch.operators.anchor import AnchorStore


def assign_stream(records: DataFrame, store: AnchorStore, match: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Start a query that writes (record_id, entity_id, kind, batch) of each micro-batch to ``out``.

    ``match`` gives (record_id, anchor_id) of a batch. A batch overwrites its own folder, so one that is
    repeated after a failure is written once.
    """

    def one(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            store.assign(batch, match(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
