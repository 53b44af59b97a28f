"""Readers: landed API responses, stored tables, and JSON files to import."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift import schemas

LANDING_KEYS = ["candidate_id", "connector", "source_key", "source_no", "query_no", "page_no"]


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed response file.

    Files lie in partition folders named by LANDING_KEYS. A file is one API
    response and therefore small. A failed request is landed as a blank line,
    since Spark does not see files of no bytes.
    """
    keys = T.StructType([f for f in schemas.RESPONSES.fields if f.name != "body"])
    schema = T.StructType([T.StructField("value", T.StringType()), *keys.fields])
    rows = spark.read.schema(schema).option("wholetext", True).text(path)
    return rows.select(*LANDING_KEYS, F.when(F.trim("value") != "", F.col("value")).alias("body"))


def response_entries() -> Column:
    """array<string> of the postings in a response body; NULL when unreadable."""
    chain = F.when(F.lit(False), F.lit(None).cast("array<string>"))
    for connector, envelope in schemas.ENVELOPES.items():
        if envelope is None:
            entries = F.from_json("body", "array<string>")
        else:
            # An object without the envelope field is a response without postings.
            parsed = F.from_json("body", f"struct<{envelope}:array<string>>")
            entries = F.when(
                F.json_object_keys("body").isNotNull(),
                F.coalesce(parsed[envelope], F.array().cast("array<string>")))
        chain = chain.when(F.col("connector") == connector, entries)
    return chain


def response_pages(responses: DataFrame) -> DataFrame:
    """Responses with their entries, the number of entries and a failure flag."""
    return (
        responses.withColumn("entries", response_entries())
        .withColumns({
            "failed": F.col("entries").isNull(),
            "n_rows": F.coalesce(F.size("entries"), F.lit(0)),
        })
    )


def explode_responses(pages: DataFrame) -> DataFrame:
    """raw_postings: one row per entry with its place in the page."""
    return pages.select(*LANDING_KEYS, F.posexplode("entries").alias("pos", "payload"))


def entries_of(pages: DataFrame) -> DataFrame:
    """One row per entry with the figures of its page; a page without entries keeps one row without place."""
    return pages.select(*LANDING_KEYS, "n_rows", "failed", F.posexplode_outer("entries").alias("pos", "payload"))


def read_raw_postings(spark: SparkSession, path: str) -> DataFrame:
    return explode_responses(response_pages(read_responses(spark, path)))


def parse_json_objects(lists: DataFrame, schema: T.StructType, *kept: str) -> DataFrame:
    """Objects of the JSON lists in column ``value``, with their place in the list.

    Text that is no JSON list gives no rows, entries that are no objects are
    dropped, sparse objects stay.
    """
    entries = F.posexplode(F.from_json("value", "array<string>")).alias("ordinal", "entry")
    return (
        lists.select(*kept, entries)
        .filter(F.json_object_keys("entry").isNotNull())
        .select(*kept, "ordinal", F.from_json("entry", schema).alias("row")).select(*kept, "row.*", "ordinal")
    )


def read_json_objects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tolerant import of files that hold one JSON list each; a missing path is empty."""
    try:
        files = spark.read.option("wholetext", True).text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return parse_json_objects(spark.createDataFrame([], "value string"), schema)
    return parse_json_objects(files, schema)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return read_json_objects(spark, path, schemas.STORED_POSTINGS)


def _candidate_schema() -> T.StructType:
    fields = [f for f in schemas.CANDIDATES.fields if f.name != "capabilities"]
    facts = T.StructType(schemas.CAPABILITY.fields[1:])
    return T.StructType([*fields, T.StructField("capabilities", T.MapType(T.StringType(), facts))])


def _shape_candidates(rows: DataFrame) -> DataFrame:
    """The capability map becomes a list in file order; the id defaults to the name."""
    listed = F.transform(F.map_entries("capabilities"), lambda e: F.struct(
        e["key"].alias("key"), e["value"]["strength"].alias("strength"), e["value"]["evidence"].alias("evidence")))
    return rows.withColumns({"capabilities": listed, "candidate_id": F.coalesce("candidate_id", "name")})


def parse_candidates(rows: DataFrame) -> DataFrame:
    """Candidates from JSON objects in column ``value``."""
    parsed = rows.select(F.from_json("value", _candidate_schema()).alias("c")).select("c.*")
    return _shape_candidates(parsed)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate objects from JSON files."""
    return _shape_candidates(spark.read.schema(_candidate_schema()).json(path, multiLine=True))


REGISTRY_FIELDS = {
    "greenhouse_boards": "greenhouse", "lever_companies": "lever", "ashby_boards": "ashby",
    "smartrecruiters_companies": "smartrecruiters",
}


def _registry_schema() -> T.StructType:
    workday = T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))
    lists = [T.StructField(name, T.ArrayType(T.StringType())) for name in REGISTRY_FIELDS]
    return T.StructType([*lists, T.StructField("workday", workday)])


def _shape_sources(rows: DataFrame, *kept: str) -> DataFrame:
    entries = [
        F.struct(F.lit(connector).alias("connector"), F.col(field).alias("keys"))
        for field, connector in REGISTRY_FIELDS.items()
    ]
    entries.append(F.struct(F.lit("workday").alias("connector"), F.col("workday.name").alias("keys")))
    return (
        rows.select(*kept, F.explode(F.array(*entries)).alias("e"))
        .select(*kept, "e.connector", F.posexplode("e.keys").alias("ordinal", "source_key"))
        .select(*kept, "connector", "source_key", "ordinal")
    )


def parse_sources(rows: DataFrame, *kept: str) -> DataFrame:
    """sources(connector, source_key, ordinal) from registry objects in column ``value``."""
    parsed = rows.select(*kept, F.from_json("value", _registry_schema()).alias("r")).select(*kept, "r.*")
    return _shape_sources(parsed, *kept)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Registry lists per connector from JSON files; a missing path is empty."""
    try:
        rows = spark.read.schema(_registry_schema()).json(path, multiLine=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.SOURCES)
    return _shape_sources(rows)


read_source_seeds = read_sources


def read_latest(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Newest version of a versioned table, or the newest older than ``before``.

    Nothing written yet gives no rows.
    """
    versioned = T.StructType([*schema.fields, T.StructField("version", T.IntegerType())])
    try:
        versions = spark.read.schema(versioned).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if before is not None:
        versions = versions.filter(F.col("version") < before)
    newest = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == F.lit(newest)).drop("version")


RUNS, RUNS_FOLDER = "run_no int", "runs"


def complete_runs(spark: SparkSession, path: str) -> DataFrame:
    """version: the runs below ``path`` whose manifest entry is written, one row each."""
    try:
        return spark.read.schema(f"{RUNS}, version int").parquet(f"{path}/{RUNS_FOLDER}").select("version")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "version int")


def read_runs(
    spark: SparkSession, path: str, schema: T.StructType, before: int | None = None, runs: DataFrame | None = None, numbered: bool = False,
) -> DataFrame:
    """Rows of all runs of an appended table, or of the runs before ``before``; with ``runs``, of those only.

    ``numbered`` adds the run as ``version``.
    """
    versioned = T.StructType([*schema.fields, T.StructField("version", T.IntegerType())])
    wanted = versioned.names if numbered else schema.names
    try:
        rows = spark.read.schema(versioned).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], versioned).select(*wanted)
    if before is not None:
        rows = rows.filter(F.col("version") < before)
    if runs is not None:
        rows = rows.join(runs, "version", "left_semi")
    return rows.select(*wanted)


def read_history(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Stored postings of complete runs as they stand: appended postings with their latest sighting."""
    runs = complete_runs(spark, path)
    postings = read_runs(spark, f"{path}/postings", schemas.DISCOVERED, before, runs)
    seen = read_runs(spark, f"{path}/sightings", schemas.SIGHTINGS, before, runs).groupBy("ordinal").agg(F.max("seen_at").alias("seen_at"))
    return postings.join(seen, "ordinal", "left").withColumn(
        "last_seen_at", F.greatest("last_seen_at", "seen_at")).select(*postings.columns)


def latest_artifacts(records: DataFrame, keys: list[str], written: str = "written_at") -> DataFrame:
    """Newest record per key of an append-only artifact table."""
    record = F.struct(*[c for c in records.columns if c not in keys])
    return records.groupBy(*keys).agg(F.max_by(record, written).alias("r")).select(*keys, "r.*")
