"""Batch twins of the streaming operators: the same code over a bounded input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import tool_calls, with_
from ..streaming import operators as S
from .registry import query

C = with_("calls")


@query("stream_sessions", f"""{C}, g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000 THEN 1 ELSE 0 END AS s FROM calls WINDOW w AS (PARTITION BY actor ORDER BY ts, id)), e AS (SELECT actor, ts, sum(s) OVER (PARTITION BY actor ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT actor, min(ts) AS start, count(*) AS n FROM e GROUP BY actor, k""")
def stream_sessions(spark, d):
    """Session windows."""
    return S.sessions(tool_calls(spark, d)).select("actor", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_error_pattern", f"{C}, e AS (SELECT actor, unnest(list_transform(range(0, 30), lambda i: ts::DATE - i::INTEGER)) AS d FROM calls WHERE NOT ok) SELECT actor, d::TIMESTAMP AS start, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(*) >= 3")
def stream_error_pattern(spark, d):
    """Sliding windows with repeated errors."""
    return S.error_pattern(tool_calls(spark, d)).select("actor", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_activity", f"{C} SELECT tool, date_trunc('day', ts) AS start, count(*) AS n FROM calls GROUP BY 1, 2")
def stream_activity(spark, d):
    """Touches by tool and day."""
    return S.activity(tool_calls(spark, d)).select("tool", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_dedup", f"{C} SELECT DISTINCT actor, tool, k FROM calls")
def stream_dedup(spark, d):
    """Keys seen once; over a bounded input the watermark never ends, so this is plain distinct."""
    return tool_calls(spark, d).select("actor", "tool", "k").distinct()
