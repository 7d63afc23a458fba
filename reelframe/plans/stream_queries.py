"""Queries on event time and lateness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import av as S
from . import views as V
from .registry import query


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def watermark_window_events(spark, d):
    events = V.table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return S.windowed_counts(events, "t").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


_STEP = "CASE WHEN e.time - r.time > 0 AND e.time - r.time <= 10 THEN e.time - r.time ELSE 0.04 END"


@query(f"""WITH RECURSIVE {V.duck("packets")[5:]}, e AS (SELECT path, seq, pts / 1e9 AS time, pts / 1e9 + seq % 7 * 0.05 AS arrival FROM packets), w AS (SELECT *, coalesce(lead(arrival) OVER (PARTITION BY path ORDER BY seq) <= arrival, false) AS waiting FROM e),
    r AS (SELECT path, seq, time, arrival AS timer, NOT (waiting AND arrival > arrival + 0.04) AS shown FROM w WHERE seq = 0
        UNION ALL SELECT e.path, e.seq, e.time, CASE WHEN e.arrival - (r.timer + {_STEP}) > 0.1 THEN e.arrival ELSE r.timer + {_STEP} END, NOT (e.waiting AND e.arrival > r.timer + {_STEP} + {_STEP}) FROM r JOIN w e ON e.path = r.path AND e.seq = r.seq + 1)
    SELECT path, seq, shown FROM r""")
def late_drop(spark, d):
    p = V.packets(spark, d).select("path", "seq", (F.col("pts") / 1e9).alias("time"), (F.col("pts") / 1e9 + (F.col("seq") % 7) * 0.05).alias("arrival"))
    return S.late_drop(p)
