"""One micro-batch, several handlers: read once, hand out, record what fails for good."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAILED = "batch_id long, handler_id string, attempts int, error string"


class FanOut:
    """A foreachBatch function over handlers {name: (fn(frame, batch_id), retries)}.

    The batch is held while its handlers run and read once. A handler that fails after its retries is
    recorded in the ledger and the batch is committed; with `strict` the query fails instead and replays
    the same range. Other handlers of the batch run in any case.
    """

    def __init__(self, handlers: dict[str, tuple[Callable[[DataFrame, int], None], int]], ledger: str, strict: bool = False):
        self.handlers, self.ledger, self.strict = handlers, ledger, strict

    def __call__(self, frame: DataFrame, batch_id: int) -> None:
        frame = frame.persist()
        failed = []
        try:
            frame.count()  # nothing is handed out before the whole range is read
            for name, (fn, retries) in self.handlers.items():
                for attempt in range(1, retries + 2):
                    try:
                        fn(frame, batch_id)
                        break
                    except Exception as e:
                        if attempt > retries:
                            failed.append((batch_id, name, attempt, str(e)))
        finally:
            frame.unpersist()
        if failed:
            frame.sparkSession.createDataFrame(failed, FAILED).coalesce(1).write.mode("append").parquet(self.ledger)
            if self.strict:
                raise RuntimeError(f"batch {batch_id}: {', '.join(x[1] for x in failed)} failed")


def start(stream: DataFrame, fan: FanOut, checkpoint: str, interval: str = "0 seconds"):
    return stream.writeStream.foreachBatch(fan).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def progress(query) -> DataFrame:
    """Rates and ranges of the query's recent batches."""
    spark = query.sparkSession if hasattr(query, "sparkSession") else None
    rows = [(p.batchId, p.numInputRows, float(p.inputRowsPerSecond or 0), float(p.processedRowsPerSecond or 0)) for p in query.recentProgress]
    from pyspark.sql import SparkSession

    return (spark or SparkSession.getActiveSession()).createDataFrame(rows, "batch_id long, rows long, arrival_rate double, processing_rate double").orderBy(F.asc("batch_id"))
