"""Objects that are checked in the pass that writes them: sound ones under their keys, others set aside.

One scan: each row's rules are columns beside it, a broken row turns into an
object below ``quarantine/`` with its content and what it breaks, and how many
rows break which rule is counted by the same job as it runs.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from framelake.sources import objects

QUARANTINE = "quarantine/"


class Report(NamedTuple):
    written: int
    quarantined: int
    #: How many rows break each rule; empty for a write that was committed before.
    rules: dict[str, int]


def broken(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, in their order; a rule that is null holds."""
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))


def sorted_out(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(key, content, broken) of rows with a key and content: under their keys, or below quarantine/ as JSON of key, broken and content."""
    found = rows.withColumn("__broken", broken(rules))
    bad = F.size("__broken") > 0
    text = F.col("content").cast("string")
    aside = F.to_json(F.struct("key", F.col("__broken").alias("broken"), text.alias("content")), {"ignoreNullFields": "false"})
    return found.select(
        F.when(bad, F.concat(F.lit(QUARANTINE), "key")).otherwise(F.col("key")).alias("key"),
        F.when(bad, aside.cast("binary")).otherwise(F.col("content").cast("binary")).alias("content"),
        F.col("__broken").alias("broken"),
    )


def write_checked_objects(rows: DataFrame, rules: dict[str, Column], root: str, name: str) -> Report:
    """Writes (key, content) rows as one commit, bad ones set aside; a name that was committed before is not written again."""
    if objects.committed(rows.sparkSession, root, name) is not None:
        counts: dict[str, int] = {}
    else:
        seen = Observation()
        breaks = [F.count_if(F.array_contains("broken", rule)).alias(f"r{i}") for i, rule in enumerate(rules)]
        objects.write_objects(sorted_out(rows, rules).observe(seen, F.count(F.lit(1)).alias("rows"), *breaks), root, name)
        counts = {rule: seen.get[f"r{i}"] for i, rule in enumerate(rules)}
    aside = F.count_if(F.col("key").startswith(QUARANTINE))
    total, bad = objects.committed(rows.sparkSession, root, name).agg(F.count(F.lit(1)), aside).first()
    return Report(total - bad, bad, counts)
