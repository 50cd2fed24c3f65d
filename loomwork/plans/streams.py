"""Streams over the events table, run over all of it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..catalog import query
from ..streaming import limiters as L
from ..streaming import windows as W


def folder(spark) -> str:
    """A new folder in the cluster's shared one, or in a local one where the session names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='loomwork-')}"
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def plain(df):
    """Window bounds without a zone, as the other engine has them."""
    return df.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("stream_tumbling", """SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def stream_tumbling(spark, sf):
    return plain(W.run_to_table(W.tumbling(W.events_stream(spark, sf), "ts", ["event_type"], "1 hour", "10 minutes"), folder(spark), "complete"))


@query("stream_sliding", """SELECT b - INTERVAL 15 MINUTE * k AS start, b - INTERVAL 15 MINUTE * k + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2000-01-01') AS b FROM events), range(4) r(k) GROUP BY 1, 2, 3""")
def stream_sliding(spark, sf):
    return plain(W.run_to_table(W.sliding(W.events_stream(spark, sf), "ts", ["event_type"], "1 hour", "15 minutes", "10 minutes"), folder(spark), "complete"))


@query(
    "stream_session",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, s""",
)
def stream_session(spark, sf):
    return plain(W.run_to_table(W.sessions(W.events_stream(spark, sf), "ts", ["user_id"], "30 minutes", "10 minutes"), folder(spark), "complete"))


@query("stream_append")
def stream_append(spark, sf):
    """Append mode: hours that the watermark has passed; those still open stay out."""
    return plain(W.run_to_table(W.tumbling(W.events_stream(spark, sf), "ts", ["event_type"], "1 hour", "10 minutes"), folder(spark), "append"))


@query("stream_limiter", "SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY ts, event_id) <= 2 AS admitted FROM events")
def stream_limiter(spark, sf):
    return W.run_to_table(L.limited(W.events_stream(spark, sf), "user_id", "event_id", "ts", "fixed_window", 2, 86400), folder(spark))
