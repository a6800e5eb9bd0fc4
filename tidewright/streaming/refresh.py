"""Appending a stream to a table and refreshing its indexes, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..engine import Engine


def refresh(stream: DataFrame, engine: Engine, relation: str, folder: str, checkpoint: str, strict: bool = False) -> DataStreamWriter:
    """A writer that appends each batch to the Parquet table in ``folder`` and updates the relation's indexes that ask for it.

    A batch's rows go to a folder of their own number, so a batch that is run again
    after a failure replaces its rows. With ``strict`` a failed update fails the
    batch; otherwise the rows stay, and the next batch's update takes them in.
    """

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        engine.register(relation, engine.spark.read.parquet(folder).drop("batch"))
        for row in engine.store.manifests().where("auto_update").collect():
            if row["relation"] == relation:
                try:
                    engine.update_pindex(row["index_name"])
                except Exception:
                    if strict:
                        raise

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
