"""Decisions on proposals and the figures of the unit ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decide(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per decision with its outcome, the proposal's ``review_status`` after it and the event to log.

    ``proposals`` has (proposal_id, review_status, fields: array of names);
    ``decisions`` (decision_id, proposal_id, approve, edits: map of name to
    value).  Decisions of a proposal count in the order of their ids.  The first
    valid one of an unreviewed proposal is ``applied``; the same again is
    ``repeated``; another one is ``refused``, as is an edit of an unknown field;
    a proposal that is not there makes it ``unknown``.  A null ``approve`` counts
    as a rejection.
    """
    edits = F.coalesce(F.map_keys("edits"), F.array().cast("array<string>"))
    target = F.when(~F.coalesce("approve", F.lit(False)), "rejected").when(F.size(edits) > 0, "edited").otherwise("approved")
    d = decisions.withColumns({"__edits": edits, "__target": target}).join(proposals.select("proposal_id", "review_status", "fields", F.lit(True).alias("__known")), "proposal_id", "left")
    fits = F.size(F.array_except("__edits", F.coalesce("fields", F.array().cast("array<string>")))) == 0
    fresh = F.coalesce("review_status", F.lit("unreviewed")) == "unreviewed"
    # The first valid decision settles a fresh proposal; its status holds for all that follow.
    w = Window.partitionBy("proposal_id").orderBy("decision_id").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__fits", fits).withColumn("__first", F.min(F.when(F.col("__fits"), F.col("decision_id"))).over(w))
    settled = F.min_by("__target", F.when(F.col("__fits"), F.col("decision_id"))).over(w)
    d = d.withColumn("__status", F.when(fresh, settled).otherwise(F.col("review_status")))
    applies = fresh & F.col("__fits") & (F.col("decision_id") == F.col("__first"))
    outcome = (F.when(F.col("__known").isNull(), "unknown").when(applies, "applied").when(F.col("__status") == F.col("__target"), "repeated").otherwise("refused"))
    out = d.withColumn("outcome", outcome)
    word = F.when(F.coalesce("approve", F.lit(False)), "approve").otherwise("reject")
    logged = F.when(F.col("outcome") == "applied", F.concat_ws("-", F.lit("decide"), F.col("proposal_id").cast("string"), word))
    status = F.when(F.col("__known").isNotNull(), F.coalesce("__status", F.lit("unreviewed")))
    return out.select("decision_id", "proposal_id", "outcome", status.alias("review_status"), logged.alias("idempotency_key"))


def ledger_metrics(units: DataFrame, audits: DataFrame) -> DataFrame:
    """One row of counts and rates over units that were ever deferred.

    ``units`` has (unit_key, status, attempts), one row each; ``audits`` (unit_key,
    status, at), a log.  A unit only the log knows counts by its last status.
    Rates are null while no deferred unit has come to an end.
    """
    last = audits.groupBy("unit_key").agg(F.max_by("status", "at").alias("__last"), F.max(F.col("status") == "deferred").alias("__was"), F.count(F.lit(1)).alias("__lines"))
    both = units.select("unit_key", "status", "attempts", F.lit(True).alias("__unit")).join(last, "unit_key", "full_outer")
    tried = F.coalesce(F.col("attempts") > 0, F.lit(False))
    only = F.coalesce(F.col("__was"), F.lit(False)) & ~tried
    status = F.when(tried, F.col("status")).when(only, F.col("__last"))
    x = both.withColumns({"__s": status, "__only": only})
    ended = F.col("__s").isin("completed", "permanently_rejected")
    out = x.agg(
        F.count("__s").alias("ever_deferred"), F.count_if(ended).alias("recovered"), F.count_if(F.col("__s") == "expired_visible").alias("expired"),
        F.count_if(F.col("__s").isin("pending", "deferred")).alias("immature"), F.count_if(F.col("__s") == "skipped_disabled").alias("skipped_disabled"),
        F.count_if(F.col("__unit") & (F.col("status") == "deferred")).alias("backlog"), F.count("__unit").alias("ledger_units"),
        F.coalesce(F.sum("__lines"), F.lit(0)).alias("audit_lines"), F.count_if("__only").alias("audit_only"))
    mature = F.nullif(F.col("recovered") + F.col("expired"), F.lit(0))
    return out.withColumns({"recovery_rate": F.col("recovered") / mature, "expiry_rate": F.col("expired") / mature})
