"""Board payloads that arrive as files, as a stream of ingestion runs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postmill.plans.service import PostingService, payload_jobs
from postmill.session import cut, scratch
from postmill.state import Marks

PAYLOADS = "company_id long, source string, payload string, error string, polled_at timestamp"


def payload_stream(spark: SparkSession, folder: str, files_per_run: int = 1) -> DataFrame:
    """JSON-lines files of board payloads; each micro-batch takes files_per_run of them."""
    return spark.readStream.schema(PAYLOADS).option("maxFilesPerTrigger", files_per_run).json(folder)


def ingest_batch(service: PostingService, stream: str = "") -> Callable[[DataFrame, int], None]:
    """One micro-batch is one run: boards with an error count as failed, the others are merged in full.

    Which run a batch of the stream is, is written down before the run begins. A batch that comes again after a
    crash is passed over if its run had finished, and otherwise done again as the same run.
    """
    marks = Marks(service.spark, f"{service.folder}/batches-{hashlib.md5(stream.encode()).hexdigest()}", "batch")

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id + 1 in marks.numbers():
            run_id = int(marks.content(batch_id + 1))
            if service.finished(run_id):
                return
        else:
            run_id = service.next_run()
            marks.put(batch_id + 1, str(run_id))
        with scratch():
            rows = cut(batch)
            at = rows.agg(F.max("polled_at")).head()[0]
            if at is not None and service.run_ingestion(payload_jobs(rows), rows.select("company_id", "error").distinct(), at, run_id) is None:
                raise RuntimeError("another ingestion run is going on")

    return run


def start(service: PostingService, folder: str, checkpoint: str, files_per_run: int = 1) -> StreamingQuery:
    """Processes the files there are, run by run, and ends."""
    stream = payload_stream(service.spark, folder, files_per_run)
    return stream.writeStream.foreachBatch(ingest_batch(service, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
