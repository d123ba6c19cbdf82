"""Current state of each nucleus while events keep arriving.

The ledger is the only data here that grows event by event.  Its state is a plain aggregate, so the batch
operator runs on a stream unchanged; only reading and writing differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from perinuc.operators.ledger import ledger_state


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Event files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def write_state(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write the state of all nuclei after each batch of events to ``folder/batch=<number>``.

    A batch that is repeated after a failure overwrites its own folder only.
    """

    def save(state: DataFrame, batch: int) -> None:
        state.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    writer = ledger_state(events).writeStream.outputMode("complete").foreachBatch(save)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
