"""Streams over several batches against plain Python and the batch operators."""

import datetime as dt
import random

from pyspark.sql import functions as F

from memlake.operators.curation import ledger_step
from memlake.streaming import journal as st
from memlake.streaming.stateful import unit_ledger

START = dt.datetime(2024, 1, 1)
HOUR = 3_600_000


def _ms(hours):
    return int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000) + int(hours * HOUR)


def _stream(spark, folder, batches, schema):
    """A stream of one batch per list of rows; the first column named ts is in hours."""
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis(F.lit(_ms(0)) + (F.col("ts") * HOUR).cast("long"))).coalesce(1).write.mode("append").parquet(f"{folder}")
        time.sleep(1.1)  # files are taken in order of their time
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_openings_without_a_close(spark, tmp_path):
    opens = _stream(spark, f"file://{tmp_path}/o", [[("a", 0.0), ("b", 1.0), ("c", 2.0), ("c", 2.5)], [("d", 80.0)], [("f", 90.0)], [("e", 200.0)]], "k string, ts double")
    closes = _stream(spark, f"file://{tmp_path}/c", [[("a", 3.0), ("a", 3.0), ("b", 30.0), (None, 2.0)], [("z", 80.0)], [("z", 90.0)], [("c", 4.0), ("z", 200.0)]], "k string, ts double")
    rows = st.drain(st.open_without_close(opens, closes, "k", "1 day")).collect()
    at = lambda h: START + dt.timedelta(hours=h)
    missing = {(r.key, r.opened_at) for r in rows if r.closed_at is None}
    assert missing == {("b", at(1)), ("c", at(2)), ("c", at(2.5)), ("d", at(80)), ("f", at(90))}  # the closes of b and c came too late; e is open still
    assert sorted((r.key, r.closed_at) for r in rows if r.closed_at) == [("a", at(3)), ("a", at(3))]  # the doubled close


def _plain_turns(events, life, seen_until):
    out, opened = [], {}
    for t, k, kind in sorted(events):
        if k in opened and t - opened[k] > life:
            out.append((k, opened.pop(k), None, "expired"))
        if kind == "open" and k not in opened:
            opened[k] = t
        elif kind == "close" and k in opened:
            out.append((k, opened.pop(k), t, "complete"))
    return sorted(out + [(k, t, None, "expired") for k, t in opened.items() if t + life <= seen_until], key=str)


def test_pending_turns_over_batches(spark, tmp_path):
    r = random.Random(7)
    hours = sorted(r.sample(range(1000), 240))
    events = [(float(h), r.randrange(12), r.choice(["open", "close", "other"])) for h in hours]
    stream = _stream(spark, f"file://{tmp_path}/e", [events[:80], events[80:160], events[160:]], "ts double, user long, event_type string")
    got = st.drain(st.pending_turns(stream, "user", "open", "close", ttl_days=3)).collect()
    want = _plain_turns([(_ms(h), k, kind) for h, k, kind in events], 72 * HOUR, _ms(hours[-1] - 48))
    assert sorted(((x.key, x.opened, x.closed, x.status) for x in got), key=str) == want and {x.status for x in got} == {"complete", "expired"}


def test_the_ledger_equals_its_batch_step_over_ticks(spark, tmp_path):
    r = random.Random(8)
    ticks = [0, 0.5, 1, 2, 3, 6, 7.5, 9, 30, 33, 36, 60, 95, 100]  # hours; a life of four days ends after tick 95
    units = [f"u{i}" for i in range(30)]
    outcome = {(u, t): r.choice(["deferred", "deferred", "completed", "permanently_rejected", None, None]) for u in units for t in ticks[1:]}
    for u in units[:5]:
        outcome |= {(u, t): "deferred" for t in ticks[1:]}
    for u in units[5:8]:
        outcome |= {(u, t): None for t in ticks[1:]}
    for u in units[8:12]:
        outcome |= {(u, t): {1: "deferred", 60: "completed"}.get(t) for t in ticks[1:]}
    events = [(0.0, u, None) for u in units] + [(float(t), u, o) for (u, t), o in sorted(outcome.items(), key=lambda x: x[0][1]) if o] + [(400.0, "last", None)]
    batches = [[e for e in events if low <= e[0] < high] for low, high in ((0, 1), (1, 2.5), (2.5, 7), (7, 9), (9, 31), (31, 61), (61, 300), (300, 500))]
    told = st.drain(unit_ledger(_stream(spark, f"file://{tmp_path}/e", batches, "ts double, unit string, outcome string"), "unit", life_days=4, delay="1 second")).collect()
    last, due = {}, {}
    for x in sorted(told, key=lambda x: (x.at, x.attempts)):
        if x.status == "due":
            due.setdefault(x.unit, []).append((x.attempts, x.at))
        else:
            last[x.unit] = (x.status, x.attempts, x.retry_after)
    state = {u: ("pending", 0, None) for u in units}
    waits = {}
    for t in ticks[1:]:
        now = F.timestamp_millis(F.lit(_ms(t)))
        rows = [(u, *state[u], outcome[u, t]) for u in units]
        df = spark.createDataFrame(rows, "unit string, status string, attempts int, retry_after long, outcome string")
        df = df.withColumns({"retry_after": F.timestamp_millis("retry_after"), "expires_at": F.timestamp_millis(F.lit(_ms(96)))})
        for x in ledger_step(df, now).select("unit", "next_status", "next_attempts", F.unix_millis("next_retry_after").alias("retry")).collect():
            state[x.unit] = (x.next_status, x.next_attempts, x.retry)
            if x.next_status == "deferred":
                waits.setdefault(x.unit, set()).add((x.next_attempts, x.retry))
    assert {u: last[u] for u in units} == state
    assert {s for s, *_ in state.values()} == {"completed", "permanently_rejected", "expired_visible"}
    assert all(set(v) <= waits[u] for u, v in due.items()) and all(due[u] == [(1, _ms(2))] for u in units[8:12])


def test_units_that_share_a_bucket_report_what_single_ones_do(spark, tmp_path):
    r = random.Random(11)
    kinds = ["deferred", "deferred", "completed", "permanently_rejected", None, None]
    events = [(h, f"u{r.randrange(60)}" if r.random() < 0.98 else None, r.choice(kinds)) for h in sorted(round(r.uniform(0, 160), 2) for _ in range(700))]
    late = [(h - 1.5, u, "deferred") for h, u, _ in r.sample(events[350:], 20)]  # behind, but not behind the watermark
    cuts = [0, 20, 45, 70, 100, 130, 161]
    batches = [[e for e in events if a <= e[0] < b] + [e for e in late if a <= e[0] + 1.5 < b] for a, b in zip(cuts, cuts[1:])] + [[(400.0, "last", None)]]
    stream = lambda: spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    folder = f"file://{tmp_path}/e"
    _stream(spark, folder, batches, "ts double, unit string, outcome string")
    told = [sorted(map(str, st.drain(unit_ledger(stream(), "unit", life_days=2, delay="2 hours", buckets=n)).collect())) for n in (1, 100_000)]
    assert told[0] == told[1] and len(told[0]) == len(set(told[0])) > 300 and sum("status='due'" in x for x in told[0]) > 10 and any("unit=None" in x for x in told[0])


def test_the_ledgers_state_is_kept_by_buckets(spark, tmp_path):
    rows = [(0.0, f"u{i}", "deferred" if i % 2 else None) for i in range(1500)]
    out = unit_ledger(_stream(spark, f"file://{tmp_path}/e", [rows], "ts double, unit string, outcome string"), "unit", life_days=4)
    run = out.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    kept = run.recentProgress[0]["stateOperators"][0]
    assert 0 < kept["numRowsTotal"] <= 3 * 1024 and kept["customMetrics"]["numRegisteredTimers"] <= 1024  # a value and a timer of two rows at most for a bucket
