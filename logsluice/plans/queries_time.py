"""Queries over time formats that lines settle by elimination."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsluice.operators import time_induction
from logsluice.plans.registry import query
from logsluice.sources import rendered as R

# Per sourcetype how its lines write the time.
_KINDS = ("day_first", "month_first", "short", "iso", "seconds", "millis", "either", "half_day")
_RANGE = {"earliest": "2010-01-01", "latest": "2060-01-01"}


def _lines(spark, folder):
    """Lines of eight sourcetypes; those of ``either`` have no day above twelve, so nothing settles them."""
    ts, n = F.col("ts"), len(_KINDS)
    early = F.lpad((F.dayofmonth("ts") % 12 + 1).cast("string"), 2, "0")
    written = [
        F.date_format(ts, "dd/MM/yyyy HH:mm:ss"), F.date_format(ts, "MM/dd/yyyy HH:mm:ss"), F.date_format(ts, "dd.MM.yy HH:mm"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.unix_seconds(ts), F.unix_millis(ts),
        R.text(early, F.date_format(ts, "/MM/yyyy HH:mm:ss")), F.date_format(ts, "M/d/yyyy h:mm:ss a")]
    which = F.col("event_id") % n
    time = F.coalesce(*[F.when(which == i, w.cast("string")) for i, w in enumerate(written)])
    kind = F.coalesce(*[F.when(which == i, k) for i, k in enumerate(_KINDS)])
    line = F.when(which % 2 == 0, R.text(time, " login of ", F.col("login"), " from ", F.col("ip"))).otherwise(
        R.text(F.col("ip"), " user=", F.col("login"), " time=", time, " k=", F.col("k")))
    return R.typed_events(spark, folder).select("event_id", kind.alias("sourcetype"), line.alias("raw"))


_KIND = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"


@query("time_induced", f"""
SELECT event_id, {_KIND} AS sourcetype,
  strftime(CASE event_id % 8 WHEN 6 THEN NULL WHEN 2 THEN date_trunc('minute', ts) WHEN 3 THEN date_trunc('millisecond', ts)
    WHEN 5 THEN date_trunc('millisecond', ts) ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S.%g') AS event_time
FROM events""")
def time_induced(spark, folder):
    lines = _lines(spark, folder)
    read = time_induction.read_times(lines, time_induction.formats(lines, **_RANGE))
    return read.select("event_id", "sourcetype", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSS").alias("event_time"))


# What the dates of each sourcetype contradict, worked out from the typed times.
@query("time_formats", f"""
WITH kinds AS (
  SELECT {_KIND} AS sourcetype, count(*) AS lines, count(*) FILTER (day(ts) > 12) AS late,
    count(*) FILTER (day(ts) < 10) AS low
  FROM events GROUP BY 1)
SELECT sourcetype, lines,
  CASE sourcetype WHEN 'either' THEN 'DMY,MDY' WHEN 'day_first' THEN CASE WHEN late > 0 THEN 'DMY' ELSE 'DMY,MDY' END
    WHEN 'month_first' THEN CASE WHEN late > 0 THEN 'MDY' ELSE 'DMY,MDY' END
    WHEN 'half_day' THEN CASE WHEN late > 0 THEN 'MDY' ELSE 'DMY,MDY' END
    WHEN 'short' THEN 'DMY' || CASE WHEN late > 0 THEN '' ELSE ',MDY' END || CASE WHEN low > 0 THEN '' ELSE ',YMD' END
    WHEN 'iso' THEN CASE WHEN late > 0 THEN 'YMD' ELSE 'YMD,YDM' END ELSE sourcetype END AS formats,
  CASE sourcetype WHEN 'day_first' THEN late WHEN 'month_first' THEN late WHEN 'half_day' THEN late ELSE 0 END AS late
FROM kinds""")
def time_formats(spark, folder):
    found = time_induction.formats(_lines(spark, folder), **_RANGE)
    struck = F.when(F.col("sourcetype").isin("day_first", "month_first", "half_day"), F.coalesce(
        F.try_element_at("struck", F.lit("MDY")), F.try_element_at("struck", F.lit("DMY")), F.lit(0))).otherwise(0)
    return found.select("sourcetype", "lines", F.array_join("formats", ",").alias("formats"), struck.cast("long").alias("late"))
