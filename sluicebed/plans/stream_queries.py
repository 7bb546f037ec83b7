"""Streams over the events table, run to completion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import table
from ..streaming import feedback as S
from .catalog import query
from .lineage import shared_dir

c = F.col
_STORE = "spark.sql.streaming.stateStore.providerClass"


def _places(spark, name):
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}-{name}"
    return f"{base}/out", f"{base}/checkpoint"


def _events(spark, d):
    stream = S.feedback_stream(spark, d, table(spark, d, "events").schema, glob="events.parquet")
    return stream.withColumn("ts", c("ts").cast("timestamp"))  # event time needs a zone; the session's is UTC


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_live_counts(spark, d):
    out, mark = _places(spark, "counts")
    S.run_available_totals(S.live_counts(_events(spark, d), ["event_type"]), out, mark)
    return S.latest_totals(spark, out, ["event_type"])


@query("SELECT date_trunc('day', ts::TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark, d):
    """Totals per day, update mode so that the last windows are reported as well."""
    out, mark = _places(spark, "windows")
    S.run_available_totals(S.windowed_counts(_events(spark, d), "ts", "event_type"), out, mark)
    return S.latest_totals(spark, out, ["w", "event_type"]).select(c("w.start").alias("day"), "event_type", "n")


@query("SELECT DISTINCT user_id FROM events")
def stream_first_reviews(spark, d):
    out, mark = _places(spark, "first")
    S.run_available(S.first_reviews(_events(spark, d), "user_id", "ts").select("user_id"), out, mark)
    return spark.read.parquet(out)


@query("SELECT event_id, event_type FROM events")
def stream_append(spark, d):
    out, mark = _places(spark, "append")
    S.run_available(_events(spark, d).select("event_id", "event_type"), out, mark)
    return spark.read.parquet(out)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def stream_open_queue(spark, d):
    """Customers without an event yet, from the maintained table of those seen."""
    out, mark = _places(spark, "seen")
    S.maintain_reviewed(_events(spark, d).select(c("user_id").alias("c_custkey")), "c_custkey", out, mark)
    return S.open_items(table(spark, d, "customer").select("c_custkey"), spark.read.parquet(out), "c_custkey")


@query("""WITH r AS (SELECT user_id, value > 90 AS hit, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), f AS (SELECT user_id, min(n) FILTER (WHERE hit AND n <= 15) AS first_hit, least(max(n), 15) AS n FROM r GROUP BY user_id)
SELECT user_id, coalesce(first_hit, n)::INT AS turns, first_hit::INT AS first_hit FROM f""")
def stream_first_hits(spark, d):
    """The state machine per user: count turns, stop at the first hit or after fifteen."""
    out, mark = _places(spark, "hits")
    e = _events(spark, d).withColumn("hit", c("value") > 90)
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        S.run_available_totals(S.first_hits(e, "user_id", "event_id", "hit"), out, mark)
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    return S.latest_totals(spark, out, ["user_id"])
