"""Facts over time, journal, proposals and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import history as hi
from memlake.operators import lineage as li
from memlake.operators import listing as lt
from memlake.operators import ingest as ing
from memlake.registry import register, table
from memlake.streaming import journal as st
from memlake.streaming.stateful import unit_ledger

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


VAL = "(event_id % 5)"


@query(f"""WITH r AS (SELECT user_id, event_type, {VAL} AS v, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, event_type, v AS value, count(*) AS statements, min(r) = 1 AS is_current FROM r GROUP BY ALL""")
def facts_current(spark, sf_dir):
    """T-2, A3: every value a user's attribute had, the newest statement current; A, B, A ends with A."""
    e = _events(spark, sf_dir).withColumn("value", F.col("event_id") % 5)
    return ing.current_facts(e, ["user_id", "event_type"], ["ts", "event_id"], "value")


@query(f"""WITH r AS (SELECT user_id, event_type, {VAL} AS v, lag({VAL}) OVER w AS p, ts, event_id FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
k AS (SELECT * FROM r WHERE p IS NULL OR v <> p), n AS (SELECT user_id, event_type, v, count(*) AS times, max((ts, event_id)) AS last FROM k GROUP BY ALL)
SELECT user_id, event_type, v AS value, times FROM n WHERE times > 1 QUALIFY last = max(last) OVER (PARTITION BY user_id, event_type)""")
def fact_resurrect_aba(spark, sf_dir):
    """T-2: values that were replaced and came back, the last of each attribute."""
    from pyspark.sql import Window

    e = _events(spark, sf_dir).withColumn("value", F.col("event_id") % 5)
    v = ing.versions(e, ["user_id", "event_type"], ["ts", "event_id"], "value")
    n = v.groupBy("user_id", "event_type", "value").agg(F.count(F.lit(1)).alias("times"), F.max(F.struct("ts", "event_id")).alias("last")).where("times > 1")
    best = F.max("last").over(Window.partitionBy("user_id", "event_type"))
    return n.withColumn("best", best).where("last = best").select("user_id", "event_type", "value", "times")


@query(f"""WITH r AS (SELECT *, {VAL} AS v, lag({VAL}) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::INT AS version FROM r WHERE p IS NULL OR v <> p""")
def version_numbers(spark, sf_dir):
    """T-7, K5."""
    e = _events(spark, sf_dir).withColumn("value", F.col("event_id") % 5)
    return ing.versions(e, ["user_id", "event_type"], ["ts", "event_id"], "value").select("event_id", "user_id", "event_type", "version")


WHEN = "2024-01-15 12:00:00"


@query(f"""WITH i AS (SELECT *, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS until FROM events)
SELECT event_id, user_id, event_type, value FROM i WHERE ts <= TIMESTAMP '{WHEN}' AND (until IS NULL OR until > TIMESTAMP '{WHEN}')""")
def bitemporal_as_of(spark, sf_dir):
    """T-1, J19, P5."""
    facts = hi.intervals(_events(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id")
    return hi.as_of(facts, F.lit(WHEN).cast("timestamp_ntz")).select("event_id", "user_id", "event_type", "value")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN event_id END IGNORE NULLS)
OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opening FROM events""")
def session_opening_asof(spark, sf_dir):
    """Users stand as sessions, the first event type as the opening decision."""
    e = _events(spark, sf_dir)
    first = e.agg(F.min("event_type").alias("t")).select("t").scalar()
    return hi.opening_before(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == first, "event_id").select("event_id", "user_id", "opening")


@query("""WITH f AS (SELECT user_id, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) IS NOT NULL AS s FROM events)
SELECT user_id, round(avg(s::INT), 6) AS fraction FROM f GROUP BY user_id HAVING avg(s::INT) > 0""")
def supersede_fraction(spark, sf_dir):
    """R15, A4."""
    facts = hi.intervals(_events(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id")
    return hi.supersede_fraction(facts, "user_id", ~F.col("is_current")).withColumn("fraction", F.round("fraction", 6))


CHANGE = "CASE event_id % 6 WHEN 0 THEN 'decision_added' WHEN 1 THEN 'updated' WHEN 2 THEN 'task_created' WHEN 3 THEN 'superseded' WHEN 4 THEN 'archived' ELSE 'created' END"


@query(f"""WITH c AS (SELECT event_id, {CHANGE} AS k, ts FROM events), s AS (SELECT event_id, k, least((CASE k WHEN 'decision_added' THEN .90 WHEN 'task_created' THEN .55 WHEN 'superseded' THEN .70 WHEN 'created' THEN .45 ELSE .15 END)
+ .25 * ((event_id % 10) / 10.0) + (CASE WHEN event_id % 4 = 0 THEN .10 ELSE 0 END) + greatest(floor(epoch(ts)) - epoch(TIMESTAMP '2024-01-01'), 0) / greatest(epoch(TIMESTAMP '2024-02-01') - epoch(TIMESTAMP '2024-01-01'), 1) * .05, 1.0) AS x FROM c)
SELECT event_id, k AS change_type, round(x, 6) AS importance, x >= .30 AS in_brief FROM s""")
def change_ranking(spark, sf_dir):
    """T-4, T-5."""
    i = F.col("event_id")
    kind = F.when(i % 6 == 0, "decision_added").when(i % 6 == 1, "updated").when(i % 6 == 2, "task_created").when(i % 6 == 3, "superseded").when(i % 6 == 4, "archived").otherwise("created")
    c = _events(spark, sf_dir).select("event_id", kind.alias("change_type"), F.col("ts").cast("timestamp").alias("ts"), ((i % 10) / 10.0).alias("salience"), (i % 4 == 0).alias("action_required"))
    out = hi.rank_changes(c, F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp"))
    return out.select("event_id", "change_type", F.round("importance", 6).alias("importance"), "in_brief")


@query("SELECT event_id, user_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 500")
def changes_feed(spark, sf_dir):
    """K2: a feed of at most 500 rows."""
    changes = _events(spark, sf_dir).withColumn("id", F.col("event_id"))
    return lt.changes_since(changes, F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id", "user_id", "event_type")


@query("SELECT arg_max(event_id, (ts, event_id)) AS event_id, user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def log_compaction(spark, sf_dir):
    """S8."""
    return hi.latest(_events(spark, sf_dir), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("""SELECT CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'curator_output' WHEN user_id % 10 = 0 THEN 'private' WHEN event_type = (SELECT max(event_type) FROM events) THEN 'not_allowed' ELSE 'eligible' END AS reason, count(*) AS n FROM events GROUP BY 1""")
def lineage_eligibility(spark, sf_dir):
    """Why events may not be used, counted; the first kind is the curator's own, the last on no list."""
    e = _events(spark, sf_dir)
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())  # a handful
    path = F.when(F.col("user_id") % 10 == 0, "home/private/log.md").otherwise("home/log.md")
    judged = li.eligibility(e.select(F.col("event_type").alias("kind"), path.alias("path")), kinds[1:-1], kinds[:1])
    return judged.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'turn:' || conv_id AS unit, count(*) AS n, array_to_string(list(role ORDER BY turn), ',') AS roles FROM conversations GROUP BY conv_id""")
def experience_units(spark, sf_dir):
    """A8."""
    c = table(spark, sf_dir, "conversations").withColumn("session", F.lit(None).cast("long"))
    out = hi.units(c, "conv_id", "session", ["turn"], ["role"])
    return out.select("unit", "n", F.array_join(F.transform("events", lambda e: e["role"]), ",").alias("roles"))


@query("""SELECT conv_id, turn FROM conversations o WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = o.conv_id AND c.turn = o.turn + 1 AND c.role = 'assistant')""")
def incomplete_turns(spark, sf_dir):
    """User turns without an answer."""
    c = table(spark, sf_dir, "conversations")
    closes = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return hi.incomplete(c.where("role = 'user'"), closes, ["conv_id", "turn"]).select("conv_id", "turn")


@query("""WITH p AS (SELECT event_type AS action, CASE event_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'open' END AS status, event_id % 5 = 0 AS edited, CASE WHEN event_id % 3 < 2 THEN event_id % 97 END AS seconds FROM events)
SELECT action, count(*) AS proposals, count_if(status = 'accepted')::BIGINT AS accepted, count_if(status = 'rejected')::BIGINT AS rejected, count_if(status = 'open')::BIGINT AS open,
round(count_if(status = 'rejected') / count_if(status <> 'open'), 6) AS rejection_rate, round(avg(edited::INT), 6) AS edit_rate, (list(seconds ORDER BY seconds) FILTER (seconds IS NOT NULL))[(count(seconds) // 2 + 1)::INT] AS median_seconds FROM p GROUP BY action""")
def proposal_metrics(spark, sf_dir):
    """A7."""
    i = F.col("event_id")
    p = _events(spark, sf_dir).select(
        F.col("event_type").alias("action"), F.when(i % 3 == 0, "accepted").when(i % 3 == 1, "rejected").otherwise("open").alias("status"),
        (i % 5 == 0).alias("edited"), F.when(i % 3 < 2, i % 97).alias("seconds"))
    return hi.proposal_metrics(p)


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup_watermark(spark, sf_dir):
    """The stream's result; event ids are unique, so its batch form keeps every row."""
    return st.drain(st.dedup(st.read_events(spark, sf_dir), ["event_id"]).select("event_id", "user_id", "event_type"))


@query("""SELECT event_type, strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL""")
def stream_daily_counts(spark, sf_dir):
    """Our addition: tumbling windows of a day."""
    e = st.read_events(spark, sf_dir).groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return st.drain(e.select("event_type", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n"), "complete")


@query()
def stream_pending_turns(spark, sf_dir):
    """Each user's purchase journey opens with the first kind of event and ends with the last."""
    kinds = [r[0] for r in _events(spark, sf_dir).agg(F.min("event_type"), F.max("event_type")).select(F.explode(F.array("min(event_type)", "max(event_type)"))).collect()]
    return st.drain(st.pending_turns(st.read_events(spark, sf_dir), "user_id", kinds[0], kinds[1]))


@query("""WITH o AS (SELECT user_id AS key, ts AS opened_at FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id AS key, ts AS closed_at FROM events WHERE event_type = 'signup'),
w AS (SELECT least((SELECT max(opened_at) FROM o), (SELECT max(closed_at) FROM c)) - INTERVAL 2 DAY AS t)
SELECT key AS user_id, strftime(opened_at, '%Y-%m-%d %H:%M:%S.%f') AS opened_at FROM o, w
WHERE opened_at + INTERVAL 1 DAY < t AND NOT EXISTS (SELECT 1 FROM c WHERE c.key = o.key AND closed_at >= opened_at AND closed_at <= opened_at + INTERVAL 1 DAY)""")
def stream_incomplete_turns(spark, sf_dir):
    """Purchases that no signup of the user followed within a day, from two streams; all that the watermark has passed."""
    e = st.read_events(spark, sf_dir)
    joined = st.open_without_close(e.where("event_type = 'purchase'"), st.read_events(spark, sf_dir).where("event_type = 'signup'"), "user_id", "1 day")
    lost = st.drain(joined).where("closed_at IS NULL")
    return lost.select(F.col("key").alias("user_id"), F.date_format("opened_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("opened_at"))


@query()
def stream_unit_ledger(spark, sf_dir):
    """V9: errors defer a unit, a purchase completes it; a unit is a user in a run of a thousand events."""
    e = st.read_events(spark, sf_dir).withColumns({
        "unit": F.concat_ws(":", "user_id", F.floor(F.col("event_id") / 1000)), "outcome": F.when(F.col("event_type") == "error", "deferred").when(F.col("event_type") == "purchase", "completed")})
    return st.drain(unit_ledger(e, "unit", life_days=2))


@query("""WITH s AS (SELECT user_id, event_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_until FROM events WHERE event_type IN ('purchase', 'signup'))
SELECT e.event_id, s.event_id AS fact_id FROM events e JOIN s ON s.user_id = e.user_id AND s.valid_from <= e.ts AND (s.valid_until IS NULL OR s.valid_until > e.ts)""")
def facts_at_event_times(spark, sf_dir):
    """J19, T-1: what each user's last statement was at each of their events, all times at once."""
    e = _events(spark, sf_dir)
    facts = hi.intervals(e.where("event_type IN ('purchase', 'signup')"), ["user_id"], "ts", "event_id").select("user_id", F.col("event_id").alias("fact_id"), "valid_from", "valid_until")
    return hi.valid_at(e.select("event_id", "user_id", F.col("ts").alias("at")), facts, ["user_id"]).select("event_id", "fact_id")
