"""Queries on traces of any length: all events of a type make one trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import long_traces
from ..sources.scratch import materialize
from .adapters import TRACES_SQL, rounded, traces
from .catalogue import register
from .structure_queries import thinned_sql

_L = "l AS MATERIALIZED (SELECT event_type AS trace, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS x, value AS y, event_id AS step FROM events)"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of their users' traces, with their types; one without an id is none."""
    return traces(spark, sf_dir, "event_type").filter("step IS NOT NULL")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace (the event type), x in hours, y and step."""
    return _typed(spark, sf_dir).select(F.col("event_type").alias("trace"), "x", "y", "step")


@register(f"""WITH RECURSIVE {_L}, o AS (SELECT trace, x, floor(y) AS y, row_number() OVER (PARTITION BY trace ORDER BY x, step) - 1 AS pos FROM l),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY trace, y ORDER BY pos) AS run FROM o), r AS (SELECT trace, y, min(pos) AS lo, max(pos) AS hi FROM g GROUP BY trace, y, run),
b AS (SELECT *, lag(y) OVER w AS before, lead(y) OVER w AS after FROM r WINDOW w AS (PARTITION BY trace ORDER BY lo)), pk AS (SELECT trace, (lo + hi) // 2 AS pos, y FROM b WHERE y > before AND y > after AND y >= 2),
{thinned_sql('pk', 5, 'trace', 'y')} SELECT trace, th.pos, round(o.x, 6) AS x, th.y FROM th JOIN o USING (trace, pos) WHERE state = 1""")
def long_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of whole values of at least two, five samples apart and more."""
    at = materialize(long_traces.placed(_long(spark, sf_dir).withColumn("y", F.floor("y").cast("double")), "trace", ties="step"), "placed")
    return rounded(long_traces.thinned(long_traces.maxima(at, "trace", height=2.0, width=1024), 5, "trace", width=1024).select("trace", "pos", "x", "y"))


_SIDES = f"""WITH t AS ({TRACES_SQL}), e AS (SELECT t.*, event_type FROM t JOIN events ON event_id = step), p AS (SELECT * FROM e WHERE event_type = 'view'), k AS (SELECT trace, x, avg(y) AS y FROM e WHERE event_type = 'purchase' GROUP BY ALL)"""


@register(f"""{_SIDES}, b AS (SELECT p.step, p.x, k.x AS bx, k.y AS b FROM p ASOF LEFT JOIN k ON k.trace = p.trace AND k.x <= p.x), a AS (SELECT p.step, k.x AS ax, k.y AS a FROM p ASOF LEFT JOIN k ON k.trace = p.trace AND k.x >= p.x)
SELECT step, round(CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b WHEN ax > bx THEN b + (a - b) * (x - bx) / (ax - bx) ELSE b END, 6) + 0.0 AS value_at FROM b JOIN a USING (step)""")
def knot_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's purchases as knots, read at the times of the user's views."""
    every = _typed(spark, sf_dir)
    knots = every.filter("event_type = 'purchase'").select("trace", F.col("x").alias("at"), "y")
    return rounded(long_traces.interpolated(every.filter("event_type = 'view'"), knots, "x", "at", "y", ["trace"]).select("step", "value_at"))


@register(f"""{_SIDES}, q AS (SELECT DISTINCT x FROM k), b AS (SELECT p.step, p.x, q.x AS bx FROM p ASOF LEFT JOIN q ON q.x <= p.x), a AS (SELECT p.step, q.x AS ax FROM p ASOF LEFT JOIN q ON q.x >= p.x)
SELECT step, round(least(x - bx, ax - x), 6) AS gap FROM b JOIN a USING (step)""")
def knot_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours from each view to the nearest purchase of anyone."""
    every = _typed(spark, sf_dir)
    places = every.filter("event_type = 'purchase'").select(F.col("x").alias("at"))
    return rounded(long_traces.gaps(every.filter("event_type = 'view'"), places, "x", "at").select("step", "gap"))


@register(f"""WITH {_L}, u AS (SELECT trace, x, min(y) AS y FROM l GROUP BY ALL),
s AS (SELECT p.trace, p.x, p.y, max((p.y - q.y) / (p.x - q.x)) FILTER (q.x < p.x) AS left_slope, min((q.y - p.y) / (q.x - p.x)) FILTER (q.x > p.x) AS right_slope FROM u p JOIN u q ON q.trace = p.trace AND q.x <> p.x GROUP BY ALL),
h AS (SELECT trace, x, y FROM s WHERE coalesce(left_slope < right_slope, true)),
b AS (SELECT l.trace, l.step, l.x, l.y, h.x AS bx, h.y AS b FROM l ASOF LEFT JOIN h ON h.trace = l.trace AND h.x <= l.x), a AS (SELECT l.trace, l.step, h.x AS ax, h.y AS a FROM l ASOF LEFT JOIN h ON h.trace = l.trace AND h.x >= l.x)
SELECT trace, step, round(CASE WHEN ax > bx THEN b + (a - b) * (x - bx) / (ax - bx) ELSE b END, 6) + 0.0 AS baseline, round(y - CASE WHEN ax > bx THEN b + (a - b) * (x - bx) / (ax - bx) ELSE b END, 6) + 0.0 AS corrected, 'rubberband' AS method FROM b JOIN a USING (trace, step)""")
def rubber_band_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower hull of each type's events, merged from hulls of slices."""
    return rounded(long_traces.rubber_band(_long(spark, sf_dir), "trace", ties=["step"]).select("trace", "step", "baseline", "corrected", "method"))
