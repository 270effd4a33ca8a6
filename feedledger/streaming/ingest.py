"""Continuous ingestion and continuous reports (H1 to H3, H5, H7)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from feedledger.operators.ingest import ingest_batch
from feedledger.plans.reports import METRICS_WINDOW_SECONDS, backlog_metrics, throughput
from feedledger.sources.commits import read_text
from feedledger.sources.pages import stream_pages
from feedledger.sources.tables import read_snapshot, write_report


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """What the checkpoint names its stream: the same after a restart, another one for a new checkpoint."""
    return json.loads(read_text(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]


def _sink(root: str, max_pages: int | None, checkpoint: str):
    def write(pages: DataFrame, micro_batch: int) -> None:
        ingest_batch(pages, root, micro_batch, max_pages, stream=stream_id(pages.sparkSession, checkpoint))

    return write


def ingest_stream(spark: SparkSession, landing: str, root: str, checkpoint: str,
                  max_pages: int | None = None, bare: bool = False, max_files: int | None = None,
                  every: str | None = None) -> StreamingQuery:
    """Pages as they land, each micro-batch taken into the tables exactly once in effect.

    Events are accepted however late they are and an id is never forgotten: dedup asks the
    stored index, not a watermark. A run may be split over micro-batches, as long as its pages land
    in order. The ledger tells micro-batches of different checkpoints apart. Without ``every``
    the stream stops once it has caught up.
    """
    writer = (stream_pages(spark, landing, bare, max_files).writeStream
              .foreachBatch(_sink(root, max_pages, checkpoint)).option("checkpointLocation", checkpoint))
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def publish_backlog(spark: SparkSession, root: str, batch_id: int, reports: str,
                    window: int = METRICS_WINDOW_SECONDS) -> None:
    """Backlog and throughput of the state after a batch, as of its newest arrival."""
    actors, repositories = (read_snapshot(spark, root, t) for t in ("actors", "repositories"))
    newest = actors.agg(F.max("updated_at").alias("now")).first()["now"]
    if newest is None:
        return
    now = F.lit(newest)
    actor = backlog_metrics("actor", actors, now, window)
    repository = backlog_metrics("repository", repositories, now, window)
    write_report(actor.unionByName(repository), f"{reports.rstrip('/')}/backlog/batch={batch_id}")
    write_report(throughput(actor, repository, now, window), f"{reports.rstrip('/')}/throughput/batch={batch_id}")


def ingest_and_report_stream(spark: SparkSession, landing: str, root: str, checkpoint: str, reports: str,
                             max_pages: int | None = None, max_files: int | None = None) -> StreamingQuery:
    """``ingest_stream`` with both reports rewritten after every micro-batch."""
    take = _sink(root, max_pages, checkpoint)

    def write(pages: DataFrame, batch_id: int) -> None:
        take(pages, batch_id)
        publish_backlog(pages.sparkSession, root, batch_id, reports)

    return (stream_pages(spark, landing, max_files=max_files).writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


