"""Queries that run the event streams to the end and read the resulting tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from accountloom.plans.catalog import query
from accountloom.sources.driver_tables import table
from accountloom.streaming import events as E
from accountloom.streaming.ledger import Ledger


def _ledger(spark, folder, delay_seconds):
    """Errors land after all other events, twice, and purchases are delivered again with them."""
    events = table(spark, folder, "events")
    errors, purchases = (events.filter(F.col("event_type") == kind) for kind in ("error", "purchase"))
    home = E.work_folder(spark, "stream-ledger")
    ledger = Ledger(f"{home}/ledger", events.schema, keys=["event_id"], at="ts", group=["user_id", "event_type"],
                    delay_seconds=delay_seconds)
    for arrival in (events.filter("event_type <> 'error'"), errors.unionByName(errors).unionByName(purchases)):
        arrival.write.mode("append").parquet(f"{home}/landing")
        ledger.append(E.read_events(spark, f"{home}/landing", events.schema))
    return ledger


def _outcomes(hours):
    return f"""deliveries AS (SELECT *, false AS second FROM events WHERE event_type <> 'error'
  UNION ALL SELECT *, true FROM events WHERE event_type IN ('error', 'purchase') UNION ALL SELECT *, true FROM events WHERE event_type = 'error'),
outcomes AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w, CASE
  WHEN second AND time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR
    <= (SELECT max(ts) FROM events WHERE event_type <> 'error') - INTERVAL {hours} HOUR THEN 'late'
  WHEN second AND event_type = 'purchase' OR row_number() OVER (PARTITION BY event_id, second) > 1 THEN 'repeated'
  ELSE 'counted' END AS outcome FROM deliveries)"""


@query("stream_dedup", f"""WITH {_outcomes(360)}
SELECT event_id, user_id, event_type, value, outcome FROM outcomes""")
def stream_dedup(spark, folder):
    """Every delivery of several triggers with what became of it: counted, repeated or late."""
    return _ledger(spark, folder, 360 * 3600).rows(spark).select("event_id", "user_id", "event_type", "value", "outcome")


@query("stream_counts", f"""WITH {_outcomes(48)}
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, user_id, event_type, count(*) AS n,
  CASE WHEN outcome = 'late' THEN 'late' WHEN w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR
       THEN 'closed' ELSE 'open' END AS status
FROM outcomes WHERE outcome <> 'repeated' GROUP BY ALL""")
def stream_counts(spark, folder):
    """Hourly counts per user and action: closed and open windows, and what came after its window had closed."""
    return _ledger(spark, folder, 48 * 3600).counts(spark).withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_late", """
SELECT event_id, 'late_event' AS kind, 'arrived after its window was closed' AS reason FROM events
WHERE event_type = 'error' AND ts < (SELECT max(ts) FROM events WHERE event_type <> 'error') - INTERVAL 1 DAY""")
def stream_late(spark, folder):
    """Errors land after all other events; those more than a day behind are queued."""
    events = table(spark, folder, "events")
    home = E.work_folder(spark, "stream-late")
    landing = f"{home}/landing"
    for arrival in ("event_type <> 'error'", "event_type = 'error'"):
        events.filter(arrival).write.mode("append").parquet(landing)
        E.run_with_late_queue(E.read_events(spark, landing, events.schema), "ts", 86_400, home)
    return E.late_queue(spark, events.schema, home).select("event_id", "kind", "reason")
