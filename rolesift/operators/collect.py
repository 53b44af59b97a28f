"""From landed payloads to the postings worth keeping, with per-source counts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesift import rules, schemas
from rolesift.functions.text import location_is_relevant, or_empty, or_no_items, title_is_relevant
from rolesift.operators.normalize import CARRIED, NORMALIZERS
from rolesift.operators.joins import salted_join, union_all

# Paths of title, identifier and place inside a list payload of each connector.
FILTER_PATHS = {
    "greenhouse": ("$.title", "$.id", "$.location.name"),
    "lever": ("$.text", "$.id", "$.categories.location"),
    "ashby": ("$.title", "$.id", "$.location"),
    "smartrecruiters": ("$.name", "$.id", "$.location.fullLocation"),
    "workday": ("$.title", "$.externalPath", "$.bulletFields"),
}
SOURCE = ["candidate_id", "connector", "source_key"]
POSITION = ["query_no", "page_no", "pos"]
# Rows of one source that are counted together before the chunks are added up.
CHUNK_ROWS = 10_000


def with_ordinal(raw: DataFrame, run_no: int = 0) -> DataFrame:
    """Total order of postings: run, connector, source, query, page, place."""
    rank = F.array_position(F.array(*[F.lit(c) for c in rules.CONNECTOR_ORDER]), F.col("connector"))
    return raw.withColumn("ordinal", F.struct(
        "candidate_id", F.lit(run_no).alias("run_no"), rank.cast("int").alias("rank"), "source_no",
        "source_key", *POSITION))


def admissible_pages(pages: DataFrame, page_size: Column | int, max_pages: int | None = None) -> DataFrame:
    """Pages a reader that stops at a short or failed page would have requested.

    ``pages(candidate_id, connector, source_key, query_no, page_no, n_rows,
    failed)`` of connectors that page. With ``max_pages`` the reader also stops
    there. The first ending page is a map-side combined minimum.
    """
    if max_pages is not None:
        pages = pages.filter(F.col("page_no") < max_pages)
    return until_last(pages, last_pages(pages, page_size))


def last_pages(pages: DataFrame, page_size: Column | int) -> DataFrame:
    """last_page per source and query that has a short or failed page."""
    ending = pages.filter((F.col("n_rows") < page_size) | F.col("failed"))
    return ending.groupBy(*SOURCE, "query_no").agg(F.min("page_no").alias("last_page"))


def until_last(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows of pages up to the last one of their source and query."""
    reached = F.coalesce(F.col("page_no") <= F.col("last_page"), F.lit(True))
    return salted_join(rows, ends, [*SOURCE, "query_no"], F.col("page_no"), "left").filter(reached).drop("last_page")


def pages_until_limit(rows: DataFrame, limit: int) -> DataFrame:
    """last_page per source: where the ``limit``-th parsed row of a source stands; no row where it is not reached.

    ``rows`` of connectors that look at the limit between pages. The running
    sum goes over pages, not rows.
    """
    pages = rows.groupBy(*SOURCE, "query_no", "page_no").agg(F.count_if(F.col("outcome") == "parsed").alias("n"))
    running = Window.partitionBy(*SOURCE).orderBy("query_no", "page_no")
    return pages.withColumn("sum", F.sum("n").over(running)).filter(F.col("sum") >= limit).groupBy(*SOURCE, "query_no").agg(
        F.min("page_no").alias("last_page"))


def is_malformed(connector: Column, title: Column, identifier: Column) -> Column:
    """No title or no id; a search row of the detail connector needs its path only."""
    untitled = or_empty(title) == ""
    return F.when(connector == "workday", or_empty(identifier) == "").otherwise(untitled | identifier.isNull())


def is_unlisted(connector: Column, payload: Column) -> Column:
    """Only an absent flag means listed; an empty, zero or null one does not."""
    flag = F.get_json_object(payload, "$.isListed")
    stated = F.array_contains(or_no_items(F.json_object_keys(payload)), "isListed")
    return (connector == "ashby") & stated & F.coalesce(flag.isin("false", "0", "", "[]", "{}"), F.lit(True))


def filter_fields(raw: DataFrame) -> DataFrame:
    """Only the three fields the filter needs, read without parsing the payload."""
    def pick(n: int) -> Column:
        chain = F.when(F.lit(False), F.lit(None).cast("string"))
        for connector, paths in FILTER_PATHS.items():
            chain = chain.when(F.col("connector") == connector, F.get_json_object("payload", paths[n]))
        return chain

    # The place of a search hit is the second entry of a list that may be short.
    place = F.when(
        F.col("connector") == "workday", F.get(F.from_json(pick(2), "array<string>"), F.lit(1))).otherwise(pick(2))
    return raw.withColumns({"f_title": pick(0), "f_id": pick(1), "f_place": place})


def classify(raw: DataFrame, phrase_tokens: Column, places: Column) -> DataFrame:
    """Adds ``outcome``: malformed, rejected or parsed, tested in that order."""
    connector = F.col("connector")
    relevant = title_is_relevant("f_title", phrase_tokens) & location_is_relevant("f_place", places)
    return (
        filter_fields(raw)
        .withColumn(
            "outcome",
            F.when(is_malformed(connector, F.col("f_title"), F.col("f_id")), "malformed")
            .when(is_unlisted(connector, F.col("payload")), "rejected")
            .when(F.coalesce(relevant, F.lit(False)), "parsed")
            .otherwise("rejected"))
    )


def cap_per_source(
    rows: DataFrame, limit: int, source: list[str] | None = None,
    order: list[str] | None = None, chunk: Column | None = None,
) -> DataFrame:
    """Rows seen before the ``limit``-th parsed row of a source, that row included.

    A running count in one task per source would not survive a source that
    holds a third of all rows. The count is therefore cut along ``chunk``, a
    coarse prefix of the order: totals per chunk are summed first, then rows
    count inside their chunk only.
    """
    source = source or SOURCE
    order = order or POSITION
    if chunk is None:
        chunk = F.struct("query_no", "page_no", F.floor(F.col("pos") / CHUNK_ROWS).alias("block"))
    rows = rows.withColumns({"chunk": chunk, "is_parsed": (F.col("outcome") == "parsed").cast("long")})
    before_chunk = Window.partitionBy(*source).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        rows.groupBy(*source, "chunk").agg(F.sum("is_parsed").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before_chunk), F.lit(0)))
        .filter(F.col("before") < limit).drop("n")
    )
    inside = (
        Window.partitionBy(*source, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.join(totals, [*source, "chunk"])
        .withColumn("seen", F.col("before") + F.coalesce(F.sum("is_parsed").over(inside), F.lit(0)))
        .filter(F.col("seen") < limit)
        .drop("chunk", "is_parsed", "before", "seen")
    )


def workday_first_path(rows: DataFrame) -> DataFrame:
    """Search hits: the first relevant hit of a path is kept, later ones uncounted.

    Misses are counted every time. The first hit is found with min() per path,
    which combines on the map side, so a path that every search returns does
    not collect in one task.
    """
    at = F.struct(*POSITION)
    key = ["candidate_id", "source_key", "f_id"]
    first = (
        rows.filter(F.col("outcome") == "parsed")
        .groupBy(*key).agg(F.min(at).alias("first_at"))
    )
    marked = salted_join(rows, first, key, at, "left")
    # A path already taken is skipped before its relevance is looked at again.
    later = F.col("outcome").isin("parsed", "rejected") & F.col("first_at").isNotNull() & (at > F.col("first_at"))
    return marked.withColumn(
        "outcome", F.when(later, "repeated").otherwise(F.col("outcome"))).drop("first_at")


def with_details(hits: DataFrame, details: DataFrame) -> DataFrame:
    """Search hits with the payload of their detail, NULL where none was landed.

    ``details(source_key, path, payload)`` may hold a path more than once; with
    a column ``ordinal`` the latest answers, else the one that is last as text.
    Only details that a hit asks for are aggregated.
    """
    order = F.struct("ordinal", "payload") if "ordinal" in details.columns else F.col("payload")
    paths = hits.select("source_key", F.col("f_id").alias("path")).distinct()
    single = details.join(paths, ["source_key", "path"], "left_semi").groupBy("source_key", "path").agg(
        F.max_by("payload", order).alias("detail"))
    return hits.drop("payload").join(
        single.withColumnsRenamed({"path": "f_id", "detail": "payload"}), ["source_key", "f_id"], "left")


def normalize_postings(parsed: DataFrame, run_date: date) -> DataFrame:
    """Full parse of the surviving rows only, one projection per connector.

    ``payload`` of the detail connector is the detail, see :func:`with_details`.
    """
    frames = []
    for connector in rules.CONNECTOR_ORDER:
        rows = parsed.filter(F.col("connector") == connector)
        schema = schemas.WORKDAY_DETAIL if connector == "workday" else schemas.PAYLOADS[connector]
        frames.append(NORMALIZERS[connector](rows.select(*CARRIED, F.from_json("payload", schema).alias("raw")), run_date))
    return union_all(frames)


def source_stats(fetches: DataFrame, outcomes: DataFrame, decided: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """Ten figures per source, also for a source that returned nothing.

    ``fetches(candidate_id, connector, source_key, n_rows, failed)`` has one row per request,
    ``outcomes`` one per seen raw row, ``decided`` one per parsed posting with
    ``is_duplicate``, ``lost`` one per hit whose detail is missing. A lost
    detail is an error; a failed request also makes its source unavailable.
    All are aggregated first and then joined.
    """
    key = SOURCE
    count = lambda c: F.count_if(c)
    requests = fetches.groupBy(*key).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.sum(F.when(F.col("failed"), 0).otherwise(F.col("n_rows"))).alias("found"),
        count(F.col("failed")).alias("failures"))
    seen = outcomes.groupBy(*key).agg(
        count(F.col("outcome") == "malformed").alias("malformed"),
        count(F.col("outcome") == "rejected").alias("rejected"))
    kept = decided.groupBy(*key).agg(
        F.count(F.lit(1)).alias("parsed"), count(F.col("is_duplicate")).alias("duplicates"),
        count(~F.col("is_duplicate")).alias("new_unique"))
    missing = (outcomes.limit(0) if lost is None else lost).groupBy(*key).agg(F.count(F.lit(1)).alias("missing"))
    errors = F.coalesce("failures", F.lit(0)) + F.coalesce("missing", F.lit(0))
    name = F.when(F.col("connector") == "workday", F.lower("source_key")).otherwise(F.col("source_key"))
    figure = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (
        requests.join(seen, key, "left").join(kept, key, "left").join(missing, key, "left")
        .withColumn("errors", errors).select(
            "candidate_id", F.concat_ws(":", "connector", name).alias("source"),
            *[figure(c) for c in (
                "attempted", "found", "parsed", "malformed", "rejected", "duplicates", "new_unique", "errors")],
            F.when(F.col("failures") > 0, "unavailable").otherwise("ok").alias("status"))
    )
