"""Which stored objects stay and which go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sweep(artifacts: DataFrame, markers: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """(job_id, path, action) for artifacts (job_id, path, modified_at).

    A job is stale if its newest object is older than ``hours``. Of stale jobs with
    a marker, input/source.* stays; everything else of stale jobs goes.
    """
    age = artifacts.groupBy("job_id").agg(F.max("modified_at").alias("newest"))
    marked = markers.select("job_id").distinct().withColumn("marked", F.lit(True))
    rows = artifacts.join(age, "job_id").join(marked, "job_id", "left")
    fresh = F.col("newest") >= now - F.expr(f"interval {int(hours)} hours")
    source = F.coalesce(F.col("marked"), F.lit(False)) & F.col("path").rlike(r"^input/source\.[^/]*$")
    return rows.select("job_id", "path", F.when(fresh | source, "keep").otherwise("delete").alias("action"))


def stale_markers(swept: DataFrame, markers: DataFrame) -> DataFrame:
    """Markers of jobs that keep no source any more."""
    kept = swept.where((F.col("action") == "keep") & F.col("path").startswith("input/source.")).select("job_id").distinct()
    return markers.join(kept, "job_id", "left_anti").join(swept.select("job_id").distinct(), "job_id", "left_semi")


def with_markers(markers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Markers after those of the given jobs are set; setting one again changes nothing."""
    return markers.select("job_id").unionByName(jobs.select("job_id")).distinct()


def without_markers(markers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Markers after those of the given jobs are cleared; jobs without one don't matter."""
    return markers.join(jobs.select("job_id"), "job_id", "left_anti")


def source_action(cleanup: Column, verified: Column) -> Column:
    """Local sources after an upload: delete if wanted and verified, retain if verified, else preserve."""
    return F.when(verified & cleanup, "delete").when(verified, "retain").otherwise("preserve")


def cleanup_policy(requested: Column, default: bool) -> Column:
    return F.coalesce(requested, F.lit(default))
