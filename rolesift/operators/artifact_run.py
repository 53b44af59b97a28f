"""The artifact pipeline: select, request, answer, check, package.

The text generator is a function from a request table to a response table; it
may be a job of another system. Everything else is joins on (candidate, job).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.operators import artifacts
from rolesift.operators.artifacts import KEY
from rolesift.operators.browse import select_jobs
from rolesift.operators.joins import look_up_long
from rolesift.session import cut_lineage
from rolesift.sources.landing import latest_artifacts

CONTEXT = [
    "total_experience_years", "verified_employers", "evidence_blob", "skills", "name", "contact_section", "experience_section",
    "education_section", "company",
]


@dataclass(frozen=True)
class Artifacts:
    """Stored records of every kind; a run returns the same with its own records."""

    analyses: DataFrame
    resumes: DataFrame
    letters: DataFrame
    answers: DataFrame


@dataclass(frozen=True)
class ArtifactRun:
    """``records`` are what the run adds to the stored tables; decisions are read, never changed."""

    requests: DataFrame
    records: Artifacts
    packages: DataFrame


def _latest(stored: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    both = stored.unionByName(added, allowMissingColumns=True)
    return latest_artifacts(both, keys, "generated_at")


def run_artifacts(
    postings: DataFrame, people: DataFrame, stored: Artifacts, respond: Callable[[DataFrame], DataFrame], generated_at: Column,
    force: bool = False,
) -> ArtifactRun:
    """One pass over the actionable postings of every candidate.

    ``postings`` carry candidate_id and their decision, ``people`` the facts and
    profile of each candidate (``candidate_context``). ``respond`` turns
    (candidate_id, job_id, artifact, question, version, cache_key, prompt) into
    the same keys with ``call_error`` and ``raw``. Records that are stored under
    the same cache key make no request, so a repeated pass makes none.
    ``generated_at`` is the time every record and package carries.
    """
    chosen = select_jobs(postings).withColumnRenamed("id", "job_id")
    # Facts are derived once, for candidates with a job only. One candidate may have most jobs.
    owners = cut_lineage(people.join(chosen.select("candidate_id").distinct(), "candidate_id", "left_semi"))
    jobs = look_up_long(chosen, owners, ["candidate_id"], F.col("job_id"))
    asked = cut_lineage(artifacts.analysis_requests(jobs, stored.analyses, force))
    replies = asked.select(*KEY, "cache_key").join(respond(asked).select(*KEY, "call_error", "raw"), KEY)
    analyses = cut_lineage(artifacts.intake_analysis(replies).withColumn("generated_at", generated_at))
    known = _latest(stored.analyses, analyses, KEY)

    wanted = cut_lineage(artifacts.artifact_requests(jobs, known, stored.resumes, stored.letters, stored.answers, force))
    answered = cut_lineage(respond(wanted).select(*KEY, "artifact", "question", "call_error", "raw"))
    context = jobs.select(*KEY, *CONTEXT).join(
        known.select(*KEY, "cache_key", F.col("status").alias("analysis_status")), KEY)

    def replies_to(artifact: str) -> DataFrame:
        return context.join(answered.filter(F.col("artifact") == artifact).drop("artifact", "question"), KEY)

    resumes = artifacts.intake_resume(replies_to("resume")).withColumn("generated_at", generated_at)
    letters = artifacts.intake_cover_letter(replies_to("cover_letter")).withColumn("generated_at", generated_at)
    usable = jobs.join(known.filter(F.col("status").isin(artifacts.USABLE)).select(
        *KEY, "cache_key", F.col("status").alias("analysis_status")), KEY)
    fresh = usable if force else usable.join(artifacts.reusable_answers(stored.answers), [*KEY, "cache_key"], "left_anti")
    texts = answered.filter("artifact = 'answer'").select(*KEY, "question", "call_error", "raw")
    answers = artifacts.intake_answers(
        artifacts.with_questions(fresh).join(texts, [*KEY, "question"], "left")).withColumn("generated_at", generated_at)
    records = Artifacts(analyses, cut_lineage(resumes), cut_lineage(letters), cut_lineage(answers))

    rows = artifacts.package_rows(
        jobs, known, _latest(stored.resumes, records.resumes, KEY), _latest(stored.letters, records.letters, KEY),
        _latest(stored.answers, records.answers, [*KEY, "position"]))
    packages = artifacts.assemble_package(rows).withColumn("generated_at", generated_at)
    requests = asked.unionByName(wanted)
    return ArtifactRun(requests, records, packages)


def stored_after(stored: Artifacts, run: ArtifactRun) -> Artifacts:
    """The stored records with those of a run; of several under one key the latest answers."""
    pairs = {
        "analyses": KEY, "resumes": KEY, "letters": KEY, "answers": [*KEY, "position"]}
    return Artifacts(**{n: _latest(getattr(stored, n), getattr(run.records, n), keys) for n, keys in pairs.items()})
