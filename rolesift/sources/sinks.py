"""Writers. Tables are versioned or appended, never changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions.notes import shortlist_note
from rolesift.operators.reviews import split_valid, validate_review
from rolesift.sources.key_store import write_keys
from rolesift.sources.landing import RUNS, RUNS_FOLDER


def write_version(df: DataFrame, path: str, version: int) -> None:
    """A complete new version beside the older ones; readers take the newest.

    The files become visible when the job commits, so a reader never sees half
    a table, and a table can be rewritten from its own older version.
    """
    df.write.mode("overwrite").parquet(f"{path}/version={version:010d}")


def write_postings(postings: DataFrame, path: str, version: int, dry_run: bool = False) -> None:
    if not dry_run:
        write_version(postings, path, version)


write_sources = write_version


def append_run(new: DataFrame, keys: DataFrame, sightings: DataFrame, path: str, run_no: int) -> None:
    """What a run adds to the stored history, in a folder of its own per table.

    Writes grow with the run, not with the history. The run's entry in the
    manifest is written last, and readers take runs of the manifest only: a
    failure between the tables leaves nothing to see. A run that is repeated
    withdraws its entry, replaces its own folders and is entered again.
    """
    spark = new.sparkSession
    manifest = f"{path}/{RUNS_FOLDER}"
    write_version(spark.createDataFrame([], RUNS), manifest, run_no)
    for name, rows in (("postings", new), ("sightings", sightings)):
        write_version(rows, f"{path}/{name}", run_no)
    write_keys(keys, path, run_no)
    write_version(spark.createDataFrame([(run_no,)], RUNS), manifest, run_no)


def write_shortlist(postings: DataFrame, path: str) -> None:
    """One note per shortlisted posting, in folders per decision.

    Notes that exist are written again, so a repeated run leaves one set.
    """
    notes = postings.filter(F.col("status") == "shortlisted").select(
        "candidate_id", "id", shortlist_note().alias("note"), "application_decision")
    notes.write.mode("overwrite").partitionBy("application_decision").parquet(path)


def write_artifacts(records: DataFrame, path: str, written_at: Column) -> None:
    """Append records of one artifact kind; rows without a status are skipped."""
    records.filter(F.col("status").isNotNull()).withColumn("written_at", written_at).write.mode(
        "append").parquet(path)


def write_reviews(reviews: DataFrame, path: str, quarantine_path: str) -> None:
    """Valid reviews are appended; invalid ones go aside with their errors."""
    valid, invalid = split_valid(reviews, validate_review())
    valid.write.mode("append").parquet(path)
    invalid.write.mode("append").parquet(quarantine_path)
