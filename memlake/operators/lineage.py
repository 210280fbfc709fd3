"""Which events may feed the curator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A folder of this name makes what lies in it private.
PRIVATE_PATH = r"(?i)(^|[/\\])\.?private([/\\]|$)"


def is_private(path: Column) -> Column:
    """Whether a path has a private folder in it; a null path has none."""
    return F.coalesce(path.rlike(PRIVATE_PATH), F.lit(False))


def eligibility(events: DataFrame, allowed: list[str], own_output: list[str] | None = None) -> DataFrame:
    """Adds ``reason``: curator_output, private, not_allowed or eligible; only kinds on the list are eligible.

    ``events`` has kind and path.  A null kind is not allowed.
    """
    kind = F.coalesce("kind", F.lit(""))
    reason = F.when(kind.isin(own_output or []), "curator_output").when(is_private(F.col("path")), "private").when(~kind.isin(allowed), "not_allowed").otherwise("eligible")
    return events.withColumn("reason", reason)


def ineligible_counts(judged: DataFrame) -> DataFrame:
    """A10: ``(reason, n)`` of the events that may not be used."""
    return judged.where("reason <> 'eligible'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
