"""Time formats found by elimination: every line may contradict a format, and what no line contradicts is left.

``03/04/2024`` may be a day of March or of April. ``formats`` counts per sourcetype and shape of dates the lines that each
possible format can't read, or reads as a time outside the plausible range: a later ``17/04/2024`` strikes out the month
first. The same way epoch numbers find their unit and two-digit dates the place of their year. Shapes that keep several
formats are reported as ambiguous, those that keep none as unknown.

One projection and one aggregate with a row per sourcetype and shape, combined before the shuffle; reading joins those
few rows on sourcetype and shape.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# A date of three numbers and, behind it, a time of day; not a part of a longer chain such as an address.
_DATE = r"(?<![\d.:/-])(\d{4}|\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{1,2})(?![\d/-])(?!\.\d)"
_CLOCK = (r"(?:[T ,]{1,2}(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d{0,3})?)?(?!\d)"
          r"(?:\s?([AaPp][Mm])\b)?(?:\s?(Z|[+-]\d{2}:?\d{2})(?![\d:]))?)?")
_EPOCH = r"(?<![\w.-])(\d{9,19})(?:\.(\d{1,6})\d{0,3})?(?![\w.-])"

# The places of year, month and day per format.
_ORDERS: Mapping[str, tuple[int, int, int]] = {"YMD": (0, 1, 2), "YDM": (0, 2, 1), "DMY": (2, 1, 0), "MDY": (2, 0, 1)}
# Formats of epoch numbers: how many units a second has.
_UNITS: Mapping[str, int] = {"seconds": 1, "millis": 10**3, "micros": 10**6, "nanos": 10**9}
FORMATS = (*_ORDERS, *_UNITS)
# Formats of each shape; a place of four digits is the year.
_POSSIBLE: Mapping[str, Sequence[str]] = {
    "4-2-2": ("YMD", "YDM"), "2-2-4": ("DMY", "MDY"), "2-2-2": ("DMY", "MDY", "YMD"), "epoch": tuple(_UNITS)}
# Two-digit years up to this one belong to the century of 2000, as POSIX has it.
PIVOT = 68


def _stamped(rows: DataFrame, raw: str) -> DataFrame:
    """``rows`` with what their first date, else their first epoch number consists of; NULL without either.

    ``shape`` tells the separator and where four digits stand: ``2/2/4``, ``4-2-2``, ``epoch``. ``places`` are the three numbers of
    the date, or the number and its fraction; ``clock`` is the time of day as Spark's cast reads it, NULL if there is no such time.
    """
    # One projection per step: each pattern runs once, and later steps read columns.
    rows = rows.withColumn("date", F.regexp_extract(raw, _DATE + _CLOCK, 0))
    rows = rows.withColumn("epoch", F.when(F.col("date") == "", F.regexp_extract(raw, _EPOCH, 0)).otherwise(""))
    groups = ";".join(f"${g}" for g in range(1, 11))
    rows = rows.withColumn("g", F.when(F.col("date") != "", F.split(
        F.regexp_replace("date", _DATE + _CLOCK, groups), ";")).when(F.col("epoch") != "", F.split("epoch", r"\.")))
    rows = rows.drop("epoch").withColumn("date", F.col("date") != "")
    first, sep, second, third, hour, minute, seconds, fraction, half, zone = (F.get("g", F.lit(i)) for i in range(10))

    def width(place: Column) -> Column:
        return F.when(F.length(place) == 4, "4").otherwise("2")

    number = hour.try_cast("int")
    number = F.when(half == "", number).when(number.between(1, 12), number % 12 + F.when(F.lower(half) == "pm", 12).otherwise(0))
    clock = F.when(hour == "", "00:00:00").otherwise(F.concat(
        F.lpad(number.cast("string"), 2, "0"), F.lit(":"), minute, F.lit(":"), F.rpad(seconds, 2, "0"), F.lit("."),
        F.when(fraction == "", "0").otherwise(fraction), F.regexp_replace(zone, r"^([+-]\d{2})(\d{2})$", "$1:$2")))
    return rows.select(
        *[c for c in rows.columns if c not in ("date", "g")],
        F.when(F.col("date"), F.concat(width(first), sep, F.lit("2"), sep, width(third))).when(
            F.col("g").isNotNull(), "epoch").alias("shape"),
        F.when(F.col("date"), F.array(first, second, third)).otherwise(F.col("g")).alias("places"),
        F.when(F.col("date"), clock).alias("clock"))


def _candidates(shape: Column) -> Column:
    """The formats that a shape can have: their names, the places of year, month and day, units in a second (0 for dates)."""
    kind = F.regexp_replace(shape, "[/.]", "-")

    def described(fmt: str) -> Column:
        values = (fmt, *_ORDERS.get(fmt, (0, 0, 0)), _UNITS.get(fmt, 0))
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(("format", "year", "month", "day", "unit"), values)])

    chain = F
    for name, possible in _POSSIBLE.items():
        chain = chain.when(kind == name, F.array(*[described(f) for f in possible]))
    return chain


def _read_as(candidate: Column) -> Column:
    """The time of ``places`` and ``clock`` in a candidate's format; NULL if they can't be read so. Without a zone it is the session's."""
    micros = F.get("places", F.lit(0)).try_cast("decimal(19,0)") * F.lit(10**6) / candidate["unit"].cast("decimal(10,0)")
    part = F.substring(F.rpad(F.coalesce(F.get("places", F.lit(1)), F.lit("")), 6, "0"), 1, 6).try_cast("int")
    micros = micros + F.when(candidate["unit"] == 1, part).otherwise(0)
    # Beyond this range of years a number is no time in the unit.
    epoch = F.when(micros < F.lit(253_402_300_800_000_000), F.timestamp_micros(F.floor(micros).cast("bigint")))
    year, month, day = (F.get("places", candidate[p]) for p in ("year", "month", "day"))
    short = year.try_cast("int")
    full = F.when(F.length(year) == 4, short).otherwise(short + F.when(short <= PIVOT, 2000).otherwise(1900))
    date = F.concat_ws(
        " ", F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")),
        F.coalesce("clock", F.lit("no time"))).try_cast("timestamp")
    return F.when(candidate["unit"] == 0, date).otherwise(epoch)


def formats(
    lines: DataFrame, earliest: str = "1990-01-01", latest: str | None = None, tolerance: float = 0.0,
    raw_col: str = "raw", sourcetype_col: str = "sourcetype",
) -> DataFrame:
    """A row per sourcetype and shape: ``(sourcetype, shape, lines, verdict, formats, struck)``.

    ``verdict`` is ``settled``, ``ambiguous`` or ``unknown`` as one, several or none of ``formats`` are left; ``struck`` maps
    the others to the number of lines that contradict them. A format is struck out if more than ``tolerance`` of the lines
    contradict it, by a date that doesn't exist or a time before ``earliest`` or after ``latest`` (a day from now by default).
    Lines without a time take no part; an empty table gives no rows.
    """
    first = F.lit(earliest).cast("timestamp")
    last = F.lit(latest).cast("timestamp") if latest else F.current_timestamp() + F.expr("INTERVAL 1 DAY")
    found = _stamped(lines.select(F.col(sourcetype_col).alias("sourcetype"), F.col(raw_col).alias("raw")), "raw")
    most = max(map(len, _POSSIBLE.values()))
    found = found.withColumn("wrong", F.transform(_candidates(F.col("shape")), lambda c: F.when(
        _read_as(c).between(first, last), 0).otherwise(1)))
    counts = found.groupBy("sourcetype", "shape").agg(
        F.count("shape").alias("lines"), *[F.sum(F.get("wrong", F.lit(i))).alias(f"wrong{i}") for i in range(most)])
    # Not a filter on the shape: it would move below and work out all of the above a second time.
    counts = counts.filter("lines > 0")
    allowed = F.floor(F.col("lines") * tolerance)
    struck = F.array(*[f"wrong{i}" for i in range(most)])
    all_counts = F.coalesce(F.transform(_candidates(F.col("shape")), lambda c, i: F.struct(
        c["format"].alias("format"), F.get(struck, i).alias("lines"))), F.array().cast("array<struct<format:string,lines:bigint>>"))
    left = F.filter(all_counts, lambda c: c["lines"] <= allowed)
    return counts.select(
        "sourcetype", "shape", "lines",
        F.when(F.size(left) == 1, "settled").when(F.size(left) > 1, "ambiguous").otherwise("unknown").alias("verdict"),
        left["format"].alias("formats"),
        F.map_from_entries(F.filter(all_counts, lambda c: c["lines"] > allowed)).alias("struck"))


def read_times(
    lines: DataFrame, found: DataFrame, prefer: Sequence[str] = (), raw_col: str = "raw", sourcetype_col: str = "sourcetype",
) -> DataFrame:
    """``lines`` with ``event_time``, ``time_format`` and ``time_verdict``.

    Ambiguous shapes are read by the first format of ``prefer`` that is left, else their time is NULL. Lines without a time
    have the verdict ``none``, shapes that ``found`` doesn't hold ``unknown``. Columns named like those added are replaced.
    """
    added = ("event_time", "time_format", "time_verdict")
    chosen = F.when(F.size("formats") == 1, F.get("formats", F.lit(0)))
    for fmt in prefer:
        chosen = chosen.when(F.array_contains("formats", fmt), fmt)
    rules = found.select("sourcetype", "shape", chosen.alias("format"), "verdict")
    kept = [F.col(f"`{c}`") for c in lines.columns if c not in added]
    rows = _stamped(lines.select(
        F.struct(*kept).alias("line"), F.col(sourcetype_col).alias("kind"), F.col(raw_col).alias("raw")), "raw").drop("raw")
    rows = rows.withColumnRenamed("shape", "stands")
    rows = rows.join(rules, F.col("kind").eqNullSafe(F.col("sourcetype")) & (F.col("stands") == F.col("shape")), "left")
    named = F.filter(_candidates(F.col("stands")), lambda c: c["format"] == F.col("format"))
    time = F.get(F.transform(named, _read_as), F.lit(0))
    verdict = F.when(F.col("stands").isNull(), "none").otherwise(F.coalesce("verdict", F.lit("unknown")))
    return rows.select(
        "line.*", time.alias("event_time"), F.col("format").alias("time_format"), verdict.alias("time_verdict"))
