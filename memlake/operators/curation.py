"""Evidence gates, unit ledger, experience rules and proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a class of claim may rest on (class, actor, authorship, permission); all else is denied.
CLASS_POLICY = [
    ("decision", "first_party_user", "direct", "allow"),
    ("preference", "first_party_user", "direct", "allow"),
    ("fact", "first_party_user", "direct", "allow"),
    ("fact", "assistant", "direct", "allow"),
    ("fact", "first_party_user", "quoted", "weak"),
    ("fact", "first_party_user", "forwarded", "weak"),
    ("fact", "first_party_user", "pasted", "weak"),
    ("fact", "assistant", "quoted", "weak"),
    ("fact", "assistant", "forwarded", "weak"),
    ("fact", "assistant", "pasted", "weak"),
]
#: Attempts, days to live and hours of back-off of a unit.
MAX_ATTEMPTS, TTL_DAYS, BACKOFF_HOURS = 3, 14, (1, 6, 24)
TERMINAL_EFFECTS = ["reject", "defer", "noop"]
ENVELOPE = "proposals array<struct<type:string,statement:string,subject:string,evidence:array<string>>>, nothing_durable boolean"
#: Events that count as a meaningful change of a room.
ROOM_EVENTS = ["note_created", "note_superseded", "playbook_rule_added", "task_completed"]


def class_permission(claim: Column, actor: Column, authorship: Column) -> Column:
    """V5: allow, weak or deny; a null in any part is denied."""
    out = F.lit("deny")
    for c, a, w, permission in CLASS_POLICY:
        out = F.when((claim == c) & (actor == a) & (authorship == w), permission).otherwise(out)
    return out


def envelope_verdict(raw: Column) -> Column:
    """V3: null for a well-formed answer, else the first rule that it breaks."""
    x = F.from_json(raw, ENVELOPE)
    p = x["proposals"]
    breaks = lambda test: F.exists(p, test)
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    return (F.when(raw.isNull(), "missing").when(F.octet_length(raw) > 64 * 1024, "too_large").when(p.isNull() | x["nothing_durable"].isNull(), "malformed")
            .when(F.size(p) > 5, "too_many_candidates").when((F.size(p) == 0) != x["nothing_durable"], "incoherent_abstention")
            .when(breaks(lambda c: (size(c["statement"]) == 0) | (size(c["statement"]) > 300)), "statement_length")
            .when(breaks(lambda c: size(c["subject"]) > 40), "subject_length")
            .when(breaks(lambda c: c["evidence"].isNull() | ~F.size(c["evidence"]).between(1, 3)), "evidence_count"))


def dispositions(gates: DataFrame, key: str) -> DataFrame:
    """V6: ``(key, disposition, stopped_at, reviews)`` from (key, gate, effect).

    The first gate with a terminal effect decides and later gates do not run.
    Without one, any review so far makes it ``review``, else it is ``ready``.
    """
    first = F.min(F.when(F.col("effect").isin(TERMINAL_EFFECTS), F.col("gate"))).over(Window.partitionBy(key))
    ran = gates.withColumn("__stop", first).where(F.col("__stop").isNull() | (F.col("gate") <= F.col("__stop")))
    out = ran.groupBy(key).agg(
        F.max("__stop").alias("stopped_at"), F.max(F.when(F.col("gate") == F.col("__stop"), F.col("effect"))).alias("__end"),
        F.count_if(F.col("effect") == "review").alias("reviews"))
    return out.select(key, F.coalesce("__end", F.when(F.col("reviews") > 0, "review").otherwise("ready")).alias("disposition"), "stopped_at", "reviews")


def ledger_step(units: DataFrame, now: Column) -> DataFrame:
    """V9: one pass over (status, attempts, retry_after, expires_at, outcome); adds ``due`` and the next state.

    Open units past their life expire visibly; those not yet due stay as they
    are.  A due unit takes its ``outcome``: completed, rejected, skipped, or
    deferred, which counts an attempt and waits 1, 6, then 24 hours until the
    attempts are used up.  Without an outcome it stays open.
    """
    is_open = F.col("status").isin("pending", "deferred")
    late = is_open & (now >= F.col("expires_at"))
    due = is_open & ~F.coalesce(late, F.lit(False)) & ((F.col("status") == "pending") | F.col("retry_after").isNull() | (now >= F.col("retry_after")))
    tries = F.col("attempts") + 1
    defers = F.coalesce(due & (F.col("outcome") == "deferred"), F.lit(False))
    spent = defers & (tries >= MAX_ATTEMPTS)
    ends = F.coalesce(due & F.col("outcome").isin("completed", "permanently_rejected", "skipped_disabled"), F.lit(False))
    hours = F.element_at(F.array(*[F.lit(h) for h in BACKOFF_HOURS]), F.least(tries, F.lit(len(BACKOFF_HOURS))).cast("int"))
    status = F.when(late | spent, "expired_visible").when(ends, F.col("outcome")).when(defers, "deferred").otherwise(F.col("status"))
    retry = F.when(late | spent | ends, None).when(defers, F.timestamp_seconds(F.unix_timestamp(now) + hours * 3600)).otherwise(F.col("retry_after"))
    return units.withColumns({
        "due": F.coalesce(due, F.lit(False)), "next_status": status, "next_attempts": F.when(defers, tries).otherwise(F.col("attempts")), "next_retry_after": retry})


def _title_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}]", "")


def rule_evidence(events: DataFrame) -> DataFrame:
    """``(action, object_id, unit, band, event_id)``, one row per piece of evidence.

    ``events`` has event_id, event_type, ts, session_id, room, object_id, title,
    capture_method and source_refs (array).  Evidence stays as rows, so a busy
    room or session needs no list in one task.  Two deviations keep the work
    linear: a note is held against the next one of a like title in its room, not
    against all of them, and only the last end of a session counts.
    """
    e = events.where(~F.coalesce(F.col("capture_method") == "review", F.lit(False)) & ~F.coalesce(F.col("event_type").startswith("consolidation_"), F.lit(False)))
    made = lambda df, action, obj, unit, band, event: df.select(
        F.lit(action).alias("action"), obj.cast("string").alias("object_id"), unit.cast("string").alias("unit"), F.lit(band).alias("band"), event.cast("string").alias("event_id"))
    nothing = F.lit("")
    done = e.where((F.col("event_type") == "task_completed") & (F.size("source_refs") > 0)).withColumn("__src", F.try_element_at(
        F.filter("source_refs", lambda r: ~r.startswith("caused_by:") & ~r.startswith("reason:")), F.lit(1))).where(F.col("__src").isNotNull())
    strengthened = made(done, "memory_strengthened", F.col("__src"), F.col("event_id"), "high", F.col("event_id"))

    notes = e.where("event_type = 'note_created'").withColumn("__k", _title_key(F.col("title"))).where(F.octet_length("__k") >= 12)
    order = Window.partitionBy("room", F.left("__k", F.lit(12))).orderBy("ts", "event_id")
    pairs = notes.withColumns({"__b": F.lead("event_id").over(order), "__o": F.lead("object_id").over(order)}).where(F.col("__b").isNotNull())
    pairs = pairs.withColumn("__e", F.explode(F.array(F.col("event_id").cast("string"), F.col("__b").cast("string"))))
    supersede = made(pairs, "supersession_suggestion", F.col("object_id"), F.col("__o"), "medium", F.col("__e"))

    touched = e.where("event_type = 'working_state_updated'").limit(1).select(F.lit(True).alias("__touched"))
    session = F.coalesce(F.concat(F.lit("s"), F.col("session_id").cast("string")), nothing)
    ends = e.where("event_type = 'session_ended'").groupBy(session.alias("__s")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("__end"))
    chosen = e.where("event_type = 'context_decision'").withColumn("__s", session).join(ends, "__s")
    quiet = chosen.join(F.broadcast(touched), F.col("__touched"), "left_anti")  # one row at most
    name = F.coalesce(F.col("session_id").cast("string"), nothing)
    used = made(quiet, "working_state_refresh", name, F.col("__end"), "medium", F.col("event_id"))
    closing = made(quiet.select("session_id", "__end").distinct(), "working_state_refresh", name, F.col("__end"), "medium", F.col("__end"))

    rooms = made(e.where(F.col("event_type").isin(ROOM_EVENTS) & F.col("room").isNotNull()), "room_summary_refresh", F.col("room"), nothing, "low", F.col("event_id"))
    return strengthened.unionByName(supersede).unionByName(used).unionByName(closing).unionByName(rooms)


def propose(evidence: DataFrame, room_floor: int = 3) -> DataFrame:
    """Proposals with their number of pieces of evidence; a room needs three.

    The id hashes action, object, unit and an order-free digest of the evidence,
    so the same evidence gives the same proposal whatever its order.
    """
    h = F.xxhash64("event_id")
    out = evidence.distinct().groupBy("action", "object_id", "unit", "band").agg(F.count(F.lit(1)).alias("n_evidence"), F.bit_xor(h).alias("__x"), F.min("event_id").alias("__f"), F.max("event_id").alias("__l"))
    out = out.where((F.col("action") != "room_summary_refresh") | (F.col("n_evidence") >= room_floor))
    key = F.concat_ws("\u0001", "action", F.coalesce("object_id", F.lit("")), F.coalesce("unit", F.lit("")), F.col("n_evidence").cast("string"), F.col("__x").cast("string"), "__f", "__l")
    return out.select(F.substring(F.sha2(key, 256), 1, 16).alias("proposal_id"), "action", "object_id", "unit", "band", "n_evidence")


def new_proposals(proposals: DataFrame, store: DataFrame) -> DataFrame:
    """Proposals whose id is not in ``store`` yet, with the least rejected ``predecessor`` of the same action and object."""
    fresh = proposals.join(store.select("proposal_id"), "proposal_id", "left_anti")
    refused = store.where("review_status = 'rejected'").groupBy("action", "object_id").agg(F.min("proposal_id").alias("predecessor"))
    return fresh.join(refused, ["action", "object_id"], "left")


def home_activity(events: DataFrame, now: Column) -> DataFrame:
    """One row for the day of ``now``: sessions, context added and quiet, memories shown (the number in ``after``), notes changed."""
    today = (F.col("ts") >= F.date_trunc("day", now)) & (F.col("ts") <= now)
    decided = F.col("event_type") == "context_decision"
    added = decided & F.coalesce(F.col("after").startswith("inject "), F.lit(False))
    shown = F.coalesce(F.expr("try_cast(nullif(regexp_extract(after, '^[^;]*;[ ]*([0-9]+)(?:[ ;]|$)', 1), '') as bigint)"), F.lit(0))
    return events.where(today).agg(
        F.count_distinct("session_id").alias("sessions"), F.count_if(added).alias("context_added"), F.count_if(decided & ~added).alias("context_quiet"),
        F.coalesce(F.sum(F.when(added, shown)), F.lit(0)).alias("memories"), F.count_if(F.col("event_type").isin("note_created", "note_updated")).alias("notes_changed"))


def home_changes(events: DataFrame, now: Column, k: int = 5) -> DataFrame:
    """The ``k`` newest distinct (event_type, object_id) of the last 24 hours; a top-k report."""
    kinds = [*ROOM_EVENTS, "note_updated", "working_state_updated"]
    day = (F.unix_timestamp("ts") >= F.unix_timestamp(now) - 86400) & (F.col("ts") <= now)
    newest = events.where(day & F.col("event_type").isin(kinds)).groupBy("event_type", "object_id").agg(F.max("ts").alias("ts"))
    return newest.orderBy(F.col("ts").desc(), "event_type", "object_id").limit(k)
