"""Temporal, journal and proposal operators (2.6, 2.11, 2.13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Base weight of each kind of change.
CHANGE_WEIGHTS = {
    "playbook_rule_added": 0.95, "decision_added": 0.90, "approved": 0.90, "risk_changed": 0.90, "superseded": 0.70, "rejected": 0.70, "task_completed": 0.60,
    "resolved": 0.60, "task_created": 0.55, "source_added": 0.50, "deadline_changed": 0.60, "priority_changed": 0.60, "agent_run_completed": 0.45, "created": 0.45,
    "working_state_updated": 0.35, "task_claimed": 0.35, "owner_changed": 0.35, "confidence_changed": 0.40, "updated": 0.15, "archived": 0.15}


def intervals(statements: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """SCD-2 writer: each statement holds from its time until the next one of its key (null: still)."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    return statements.withColumn("valid_from", F.col(ts)).withColumn("valid_until", F.lead(ts).over(w)).withColumn("is_current", F.col("valid_until").isNull())


def as_of(facts: DataFrame, when: Column, expired: str | None = None) -> DataFrame:
    """T-1, P5: what was valid at ``when``: half-open intervals, nulls open; retracted rows hold until they were."""
    seen = (F.col("valid_from").isNull() | (F.col("valid_from") <= when)) & (F.col("valid_until").isNull() | (F.col("valid_until") > when))
    if expired:
        seen = seen & (F.col(expired).isNull() | (F.col(expired) > when))
    return facts.where(seen)


#: Buckets of an interval at its level, and the levels: each is SPAN times as wide as the one before.
SPAN, LEVELS, FINEST = 32, 5, 3600


def valid_at(times: DataFrame, facts: DataFrame, keys: list[str], at: str = "at") -> DataFrame:
    """J19, T-1 for many times at once: every row of ``times`` with each fact of its keys that held at its time.

    Intervals are half-open, a null start or end is open.  An interval lies in at
    most SPAN + 1 time buckets of the level that fits its length; those with an
    open end, or longer than all levels, lie in one bucket beside.  A time looks
    into one bucket per level, so a busy key's facts meet only the times near
    them, and each pair meets once.  Columns of both sides are kept (keys once),
    null keys and null times match nothing.
    """
    level, bucket, low, high, moment = "__level", "__bucket", "__low", "__high", "__moment"
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    width = lambda i: FINEST * SPAN**i
    length = F.col(high) - F.col(low)
    fits = F.coalesce(*[F.when(length <= SPAN * width(i), i) for i in range(LEVELS)], F.lit(LEVELS))
    wide = F.element_at(F.array(*[F.lit(width(i)).cast("long") for i in range(LEVELS)]), F.col(level) + 1)
    held = facts.withColumns({low: seconds("valid_from"), high: seconds("valid_until")}).withColumn(level, F.when(length.isNull(), F.lit(LEVELS)).otherwise(fits))
    inside = F.when(F.col(level) == LEVELS, F.array(F.lit(0).cast("long"))).when(length < 0, F.array().cast("array<long>")).otherwise(F.sequence(F.floor(F.col(low) / wide), F.floor(F.col(high) / wide)))
    held = held.withColumn(bucket, F.explode(inside)).drop(low, high)
    looks = F.array(*[F.struct(F.lit(i).alias(level), F.floor(F.col(moment) / width(i)).alias(bucket)) for i in range(LEVELS)], F.struct(F.lit(LEVELS).alias(level), F.lit(0).cast("long").alias(bucket)))
    asked = times.withColumn(moment, seconds(at)).where(F.col(moment).isNotNull()).select(*times.columns, F.inline(looks))
    met = asked.join(held, [*keys, level, bucket])
    return met.where((F.col("valid_from").isNull() | (F.col("valid_from") <= F.col(at))) & (F.col("valid_until").isNull() | (F.col("valid_until") > F.col(at)))).drop(level, bucket)


def opening_before(events: DataFrame, keys: list[str], order: list[str], opens: Column, value: str) -> DataFrame:
    """Adds ``opening``: the value of the last opening event before this one in its session."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("opening", F.last(F.when(opens, F.col(value)), ignorenulls=True).over(w))


def supersede_fraction(facts: DataFrame, note: str, superseded: Column) -> DataFrame:
    """Share of a note's facts that are superseded, where there is any."""
    return facts.groupBy(note).agg(F.avg(superseded.cast("int")).alias("fraction")).where("fraction > 0")


def rank_changes(changes: DataFrame, start: Column, end: Column, kind: str = "change_type", ts: str = "ts", salience: str = "salience", action: str = "action_required", floor: float = 0.30) -> DataFrame:
    """T-5: adds ``importance``: base + .25 salience + .10 action + at most .05 recency, 1 at most; ``in_brief`` from the floor on."""
    base = F.lit(0.15)
    for name, w in CHANGE_WEIGHTS.items():
        base = F.when(F.col(kind) == name, w).otherwise(base)
    span = F.greatest(F.unix_timestamp(end) - F.unix_timestamp(start), F.lit(1))
    recency = F.greatest(F.unix_timestamp(F.col(ts)) - F.unix_timestamp(start), F.lit(0)) / span * 0.05
    score = F.least(base + 0.25 * F.col(salience) + F.when(F.col(action), 0.10).otherwise(0.0) + F.coalesce(recency, F.lit(0.0)), F.lit(1.0))
    return changes.withColumn("importance", score).withColumn("in_brief", F.col("importance") >= floor)


def latest(rows: DataFrame, key: str, position: list[str]) -> DataFrame:
    """The last row of each key of a log."""
    w = Window.partitionBy(key).orderBy(*[F.col(p).desc() for p in position])
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def units(events: DataFrame, turn: str, session: str, order: list[str], payload: list[str]) -> DataFrame:
    """Events by turn, else by session, else apart, each unit in time order."""
    key = F.coalesce(F.concat(F.lit("turn:"), F.col(turn).cast("string")), F.concat(F.lit("session:"), F.col(session).cast("string")), F.lit("unsessioned"))
    return events.groupBy(key.alias("unit")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct(*order, *payload))).alias("events"))


def incomplete(opens: DataFrame, closes: DataFrame, key: list[str]) -> DataFrame:
    """Openings with no closing event."""
    return opens.join(closes.select(*key).distinct(), key, "left_anti")


def proposal_metrics(p: DataFrame) -> DataFrame:
    """Counts and rates of (id, status, edited, seconds), with the upper median of the seconds."""
    n = F.count(F.lit(1))
    on = lambda s: F.count_if(F.col("status") == s)
    decided = on("accepted") + on("rejected")
    middle = F.element_at(F.array_sort(F.collect_list("seconds")), (F.floor(F.count("seconds") / 2) + 1).cast("int"))
    return p.groupBy("action").agg(
        n.alias("proposals"), on("accepted").alias("accepted"), on("rejected").alias("rejected"), on("open").alias("open"),
        F.round(F.when(decided > 0, on("rejected") / decided).otherwise(0.0), 6).alias("rejection_rate"), F.round(F.avg(F.col("edited").cast("int")), 6).alias("edit_rate"), middle.alias("median_seconds"))
