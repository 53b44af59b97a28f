"""Structured Streaming driver of discovery: new landing files become runs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rolesift import schemas
from rolesift.operators.discovery import Limits, run_discovery
from rolesift.sources.key_store import matching_keys
from rolesift.sources.landing import LANDING_KEYS, read_history
from rolesift.sources.sinks import append_run, write_shortlist, write_version


def response_stream(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses as a file stream; a batch is what arrived since the last."""
    return spark.readStream.schema(schemas.RESPONSES).parquet(path).select(*LANDING_KEYS, "body")


def incremental_discovery(
    responses: DataFrame, details: Callable[[], DataFrame], candidates: Callable[[], DataFrame],
    postings_path: str, stats_path: str, shortlist_path: str, checkpoint: str, run_date: Callable[[], date], limits: Limits = Limits(),
) -> StreamingQuery:
    """Every micro-batch is one discovery run against the stored postings.

    History must stay complete, so no watermark is used. A batch appends its new
    postings, their keys and its sightings in folders named by its batch id; a
    batch replayed after a failure reads the runs before its own and replaces
    its own, hence has no second effect.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = read_history(spark, postings_path, before=batch_id)
        result = run_discovery(
            batch, details(), stored, candidates(), run_date(), batch_id, limits,
            lambda wanted: matching_keys(spark, postings_path, wanted, before=batch_id))
        append_run(result.new, result.keys, result.sightings, postings_path, batch_id)
        write_version(result.stats, stats_path, batch_id)
        write_shortlist(result.new, f"{shortlist_path}/version={batch_id:010d}")

    return (
        responses.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
