"""Detections as streams: each micro-batch goes through the library's own batch operators and updates a stored table.

Sources should be limited by ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``: a batch is processed as a distributed job,
whatever its size, but its results are seen only when it is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnstone import constants as K
from turnstone.operators.presence import evaluate
from turnstone.session import run_folder


def decide(stream: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Decision per detection of a micro-batch: use inside ``foreachBatch`` so that the registry is fresh."""
    return evaluate(stream, vehicles)


def unknown_sink(path: str):
    """foreachBatch writer of unknown detections; batch folders make a retry overwrite itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.filter(F.col("status") == K.UNKNOWN).select("event_id", "plate_number", "detected_at")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_available(stream: DataFrame, sink, name: str) -> None:
    """Gives what is there to a foreachBatch function, batch by batch in order, and stops."""
    state = run_folder(stream.sparkSession, name)
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{state}/state").trigger(availableNow=True).start()
    query.awaitTermination()
