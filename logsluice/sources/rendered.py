"""Raw log lines rendered from typed tables.

The typed columns stay next to the line, so what an extractor reads back can be compared with what
was written. Rendering is a projection; nothing is collected or stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logsluice.sources.tables import table

FORMATS = ["apache", "json", "csv", "kv", "syslog", "xml"]


def text(*parts: Column | str) -> Column:
    """Concatenate columns and plain text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def digits(number: Column, width: int) -> Column:
    """The lowest digits of a number with leading zeros."""
    return F.lpad((number % 10**width).cast("string"), width, "0")


def typed_events(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` with the values that appear in rendered lines."""
    return with_typed_values(table(spark, folder, "events"))


def with_typed_values(events: DataFrame) -> DataFrame:
    """The same for any frame of events, also a stream."""
    user_id, event_id = F.col("user_id"), F.col("event_id")
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        text("10.", F.floor(user_id / 256), ".", user_id % 256, ".", event_id % 250).alias("ip"),
        text("user", user_id).alias("login"),
        text("user", user_id, "@mail.example.com").alias("email"),
        text("host", user_id % 10).alias("host"),
        F.format_string("%.2f", F.col("value")).alias("val"))


def apache_line() -> Column:
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    return text(
        F.col("ip"), " - ", F.col("login"), " [", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"),
        ' +0000] "GET /', F.col("event_type"), "/", F.col("k"), ' HTTP/1.1" ', status, " ",
        F.col("user_id") * 10 + F.col("k"))


def apache_access_line() -> Column:
    """The longer form; every tenth line has no byte count, the odd ones no referer and agent."""
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    size = F.when(F.col("k") % 10 == 0, "-").otherwise((F.col("user_id") * 10).cast("string"))
    tail = F.when(F.col("k") % 2 == 0, text(
        ' "http://ref.example.com/', F.col("k"), '" "agent/', F.col("k"), '" ', F.col("k"))
    ).otherwise("")
    return text(
        F.col("ip"), " - ", F.col("login"), " [", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"),
        ' +0000] "POST /', F.col("event_type"), ' HTTP/1.1" ', status, " ", size, tail)


def message_text() -> Column:
    """A message in three dialects: ``k=v``, ``k: v``, ``k = v``."""
    return text(
        "event=", F.col("event_type"), " user=", F.col("login"), " value: ", F.col("val"),
        " code = ", F.col("k"))


def _syslog_time() -> Column:
    return F.concat(
        F.date_format("ts", "MMM"), F.lit(" "), F.lpad(F.dayofmonth("ts").cast("string"), 2, " "),
        F.lit(" "), F.date_format("ts", "HH:mm:ss"))


def syslog_line() -> Column:
    return text(_syslog_time(), " ", F.col("host"), " ", message_text())


def syslog_3164_line() -> Column:
    return text("<", F.col("k") + 1, ">", syslog_line())


def syslog_5424_line() -> Column:
    return text(
        "<", F.col("k") + 1, ">1 ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "Z ",
        F.col("host"), " app", F.col("k") % 5, " ", F.col("user_id"), " ID", F.col("k"), " ",
        message_text())


def json_line() -> Column:
    """Text, number, boolean, nested object and array."""
    return text(
        '{"timestamp":"', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), 'Z","event":"',
        F.col("event_type"), '","user_id":', F.col("user_id"), ',"ok":',
        F.when(F.col("event_type") == "error", "false").otherwise("true"), ',"src":"', F.col("ip"),
        '","email":"', F.col("email"), '","ctx":{"k":', F.col("k"), ',"host":"', F.col("host"),
        '"},"tags":["', F.col("event_type"), '","t', F.col("k") % 3, '"]}')


def kv_line() -> Column:
    return text(
        "ts=", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), " user=", F.col("login"), ' email="',
        F.col("email"), '" client_ip=', F.col("ip"), " event=", F.col("event_type"), " value=",
        F.col("val"))


def kv_quoted_line() -> Column:
    """Quoted values with spaces, a comma, and a repeated key of which the first counts."""
    return text(
        'user="', F.col("login"), ' of ', F.col("host"), '", event=', F.col("event_type"),
        ", value=", F.col("val"), " event=again")


def csv_line() -> Column:
    """Quotes, doubled quotes and a comma inside the message."""
    return text(
        F.col("event_id"), ",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), ",",
        F.col("event_type"), ',"said ""', F.col("login"), '"", then left",', F.col("val"), ",")


def xml_simple_line() -> Column:
    return text(
        "<event><id>", F.col("event_id"), "</id><type>", F.col("event_type"), "</type><user>",
        F.col("login"), "</user></event>")


def xml_self_closing_line() -> Column:
    return text(
        '<event id="', F.col("event_id"), '" type="', F.col("event_type"), '"/> <user name="',
        F.col("login"), '"/>')


def xml_attributes_line() -> Column:
    return text(
        '<event id="', F.col("event_id"), '" type="', F.col("event_type"), '">', F.col("login"),
        "</event>")


def rendered_events(spark: SparkSession, folder: str) -> DataFrame:
    """One raw line per event in one of six formats, the format turning with the event id.

    ``sourcetype`` names the format, ``index_name`` the event type.
    """
    lines = [
        apache_line(), json_line(), csv_line(), kv_line(), syslog_line(), xml_simple_line()]
    turn = (F.col("event_id") % len(FORMATS)).cast("int")
    raw, kind = F.when(turn == 0, lines[0]), F.when(turn == 0, FORMATS[0])
    for i in range(1, len(FORMATS)):
        raw, kind = raw.when(turn == i, lines[i]), kind.when(turn == i, FORMATS[i])
    return typed_events(spark, folder).withColumns({
        "sourcetype": kind, "index_name": F.col("event_type"), "raw": raw,
    }).withColumn("source", text("file:", F.col("host"), ".log"))


def hard_events(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose form or time is easily taken for something else, one sourcetype per form.

    Commas in access lines and pairs, a time far behind in a JSON line, a zone that is not UTC, the two
    framed forms of syslog, CSV without a header, lines without a sourcetype.
    """
    zoned = text(F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), "+02:00")
    lines = {
        "access": text(
            F.col("ip"), " - ", F.col("login"), " [", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), ' +0000] "GET /',
            F.col("event_type"), ' HTTP/1.1" 200 ', F.col("k"), ' "-" "Mozilla/5.0 (KHTML, like Gecko)"'),
        "pairs": text("user=", F.col("login"), ", ip=", F.col("ip"), ", ok=1 at=", zoned),
        "deep": text('{"pad":"', F.repeat(F.lit("x, "), 120), '","timestamp":"', F.date_format(
            "ts", "yyyy-MM-dd'T'HH:mm:ss"), '.5Z","event":"', F.col("event_type"), '"}'),
        "old": syslog_3164_line(),
        "new": syslog_5424_line(),
        "table": text(F.col("event_id"), ",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), ",", F.col("event_type"),
                      ',"said ""', F.col("login"), '"", then left",', F.col("val")),
        None: text("kind=", F.col("event_type"), " ts=", zoned),
        "other": text("mail ", F.col("email"), " at ", F.col("ip")),
    }
    turn, raw, kind = (F.col("event_id") % len(lines)).cast("int"), None, None
    for i, (name, line) in enumerate(lines.items()):
        raw = F.when(turn == i, line) if raw is None else raw.when(turn == i, line)
        kind = F.when(turn == i, F.lit(name)) if kind is None else kind.when(turn == i, F.lit(name))
    return typed_events(spark, folder).withColumns({"sourcetype": kind.cast("string"), "raw": raw})


def _customers(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """Customers, dealt out in equal parts: lines rendered from them take far longer to search than their few short columns
    take to shuffle, and a million customers are one row group, so one task."""
    return table(spark, folder, "customer").select("c_custkey", *names).hint("rebalance")


def customer_notes(spark: SparkSession, folder: str) -> DataFrame:
    """A free text per customer with one value for each number and handle we have a detector for."""
    key = F.col("c_custkey")
    note = text(
        F.col("c_name"), " born ", F.lit("19"), digits(key, 2), "-", digits(key % 9 + 1, 2), "-",
        digits(key % 28 + 1, 2), ", licence ABCDE", digits(key, 6), "AB", key % 10, "XY, code SW",
        key % 9 + 1, "A ", key % 10, "AA, number AB", digits(key, 6), "C, ref 12345 ",
        digits(key, 5), ", plate AB", digits(key, 2), " CDE, by @cust", key, " skype: live.user",
        key, " password=pw", digits(key, 6), "x")
    return _customers(spark, folder, "c_name").select("c_custkey", note.alias("note"))


def customer_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """A line per customer with e-mail, address, phone, social security and card number and URL, as
    pairs, as JSON or as an access log line."""
    key = F.col("c_custkey")
    email = text("c", key, "@shop.example.org")
    ip = text("192.168.", key % 256, ".", key % 250)
    phone = text("555-", digits(key, 3), "-", digits(key * 7, 4))
    ssn = text(digits(key, 3), "-", digits(key, 2), "-", digits(key * 3, 4))
    card = text("4111-1111-", digits(key, 4), "-", digits(key * 11, 4))
    pairs = text("mail=", email, " addr=", ip, " tel=", phone, " seg=", F.col("c_mktsegment"))
    json = text('{"ssn":"', ssn, '","card":"', card, '","seg":"', F.col("c_mktsegment"), '"}')
    access = text(
        ip, ' - - [01/Jan/2024:12:00:00 +0000] "GET /?m=', F.lit("x"), ' HTTP/1.1" 200 12 ', email)
    turn = key % 3
    return _customers(spark, folder, "c_mktsegment").select(
        "c_custkey", "c_mktsegment", email.alias("email"), ip.alias("ip"), phone.alias("phone"),
        ssn.alias("ssn"), card.alias("card"),
        F.when(turn == 0, pairs).when(turn == 1, json).otherwise(access).alias("raw"))
