"""WARC archives: writing with revisits, reading back, and a merged capture index.

Every page is one record. Of pages with equal payloads of at least ``min_bytes`` the one with the largest id
is the response, the others are revisits that name it. Each task writes files of up to ``file_records``
records, a gzip member per record, and for each file a locally sorted run of index entries. The
runs are merged to one globally ordered capture history per URL key: Spark deals the entries out by ranges of key,
time and id, and in each range a loser tree merges the slices of the runs.

Files go through ``pyarrow.fs`` to the shared folder. A file's name is new in every attempt of a task and only entries
of attempts that succeeded point to files, so a lost executor leaves unused files but no wrong result.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import partial
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, functions as F

from logsluice.llm.common import cut, fresh_folder, small

FILE_RECORDS = 20_000
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ_BYTES = 1 << 20

_ENTRY = pa.schema([
    ("urlkey", pa.string()), ("time", pa.string()), ("page_id", pa.int64()), ("run", pa.string()), ("offset", pa.int64()),
    ("length", pa.int64()), ("digest", pa.string()), ("record_type", pa.string())])
ENTRY = ("urlkey string, time string, page_id long, run string, offset long, length long, digest string, "
         "record_type string")
_RECORD = pa.schema([
    ("run", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("time", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("payload", pa.binary())])
RECORD = ("run string, offset long, page_id long, url string, time string, payload_bytes long, payload_digest string, "
          "record_type string, refers_to long, payload binary")


# --- one record ----------------------------------------------------------------------------------------

def url_key(url: str) -> str:
    """Host labels reversed, then path and query: captures of one site sort together."""
    try:
        parts = urlsplit(url)
        host, rest = parts.hostname or "", parts.path + ("?" + parts.query if parts.query else "")
    except ValueError:
        host, rest = "", url
    return f"{','.join(reversed(host.split('.')))}){rest.lower()}"


def _header(value: str) -> bytes:
    return value.replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "replace")


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id, url: str, time: str, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """A WARC record; a revisit keeps the HTTP header, which tells the payload's size, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id)),
        ("WARC-Target-URI", url), ("WARC-Date", time), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = b"".join(k.encode() + b": " + _header(v) + b"\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines if ": " in line)


def parse(data: bytes) -> dict:
    """The fields of one record; raises if it is cut off."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[:int(fields["Content-Length"])]
    if not head.startswith(b"WARC/1.1") or len(rest) != len(block) + 4:
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    return dict(
        page_id=_page(fields["WARC-Record-ID"]), url=fields.get("WARC-Target-URI", ""), time=fields["WARC-Date"],
        payload_bytes=int(_fields(http)["Content-Length"]), payload_digest=fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        record_type=fields["WARC-Type"], refers_to=_page(fields["WARC-Refers-To"]) if revisit else None,
        payload=None if revisit else payload)


# --- files -------------------------------------------------------------------------------------------------

def _write(batches: Iterator[pa.RecordBatch], folder: str, file_records: int) -> Iterator[pa.RecordBatch]:
    files, base = FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    out, run, offset, entries = None, "", 0, []

    def finish() -> pa.RecordBatch:
        out.close()
        entries.sort(key=lambda e: _order(e))
        return pa.RecordBatch.from_pylist(entries, _ENTRY)

    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names}
        for i in range(batch.num_rows):
            page_id, url, html, sha, refers_to, revisit = (
                columns[n][i].as_py() for n in ("page_id", "url", "html", "sha", "refers_to", "revisit"))
            if out is None:
                run, offset, entries = f"{uuid.uuid4().hex}.warc.gz", 0, []
                out = files.open_output_stream(f"{base}/{run}", compression=None)
            time = (EPOCH + timedelta(seconds=(page_id or 0) % 10 ** 9)).strftime("%Y-%m-%dT%H:%M:%SZ")
            digest = base64.b32encode(bytes.fromhex(sha)).decode()
            packer = zlib.compressobj(1, zlib.DEFLATED, 31)
            data = packer.compress(record(page_id, url or "", time, html or b"", digest, refers_to, revisit)) + packer.flush()
            out.write(data)
            entries.append(dict(
                urlkey=url_key(url or ""), time=time, page_id=page_id, run=run, offset=offset, length=len(data),
                digest=digest, record_type="revisit" if revisit else "response"))
            offset += len(data)
            if len(entries) == file_records:
                yield finish()
                out = None
    if out is not None:
        yield finish()


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 0, file_records: int = FILE_RECORDS, id_col: str = "page_id",
    url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """Write all pages to archives below ``folder``; returns the index entries, one sorted run per file.

    NULL html is an empty payload, a NULL URL an empty one. Rows that repeat the id of the response with its
    payload are responses too. A NULL id can't be referred to: its payload is a revisit of one with an id, or a
    response. An empty table writes no file. Other columns are not read.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    groups = rows.filter(F.octet_length("html") >= min_bytes).groupBy("sha").agg(
        F.count("*").alias("n"), F.max("page_id").alias("refers_to")).filter("n > 1 AND refers_to IS NOT NULL")
    groups = small(cut(groups.select(F.col("sha").alias("_sha"), "refers_to")))
    rows = rows.join(groups, F.col("sha") == F.col("_sha"), "left").drop("_sha")
    revisit = F.coalesce(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")), F.lit(False))
    rows = rows.withColumn("revisit", revisit)
    return cut(rows.mapInArrow(partial(_write, folder=folder, file_records=file_records), ENTRY))


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    files, base = FileSystem.from_uri(folder)
    for batch in batches:
        for run in batch.column("run").to_pylist():
            rows = []
            with files.open_input_stream(f"{base}/{run}", compression=None) as source:
                for offset, data in _members(source):
                    found = parse(data)
                    if not payloads:
                        found["payload"] = None
                    rows.append(found | dict(run=run, offset=offset))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, _RECORD)


def _members(source) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a stream."""
    held, start = b"", 0
    while True:
        held = held or source.read(_READ_BYTES)
        if not held:
            return
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while True:
            parts.append(unpack.decompress(held))
            used += len(held) - len(unpack.unused_data)
            if unpack.eof:
                held = unpack.unused_data
                break
            held = source.read(_READ_BYTES)
            if not held:
                raise ValueError("archive ends inside a record")
        yield start, b"".join(parts)
        start += used


def read_archives(entries: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the files that the entries name, each file read from its start by a task of its own."""
    runs = entries.select("run").distinct()
    # A fixed number, as Spark would put so few names into one task.
    runs = runs.repartition(max(1, runs.count()), "run")
    return runs.mapInArrow(partial(_read, folder=folder, payloads=payloads), RECORD)


# --- the merged index --------------------------------------------------------------------------------------

def _order(entry: dict) -> tuple:
    return entry["urlkey"], entry["time"], entry["page_id"] is not None, entry["page_id"] or 0, entry["run"], entry["offset"]


def loser_tree(runs: list[list[dict]], key=_order) -> Iterator[dict]:
    """The elements of sorted runs in order.

    The tree's leaves are the runs; each inner node keeps the run that lost its match, the winner moves on. After
    the winner's element is taken only its path to the root is played again.
    """
    k, done = len(runs), (1,)
    if not k:
        return
    at = [0] * k
    keys = [(0, key(run[0])) if run else done for run in runs]

    def beats(a: int, b: int) -> bool:
        return (keys[a], a) < (keys[b], b)

    losers, winner_of = [0] * k, [0] * (2 * k)
    for node in range(2 * k - 1, 0, -1):
        if node >= k:
            winner_of[node] = node - k
        else:
            a, b = winner_of[2 * node], winner_of[2 * node + 1]
            winner_of[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    winner = winner_of[1]
    while keys[winner] != done:
        run = runs[winner]
        yield run[at[winner]]
        at[winner] += 1
        keys[winner] = (0, key(run[at[winner]])) if at[winner] < len(run) else done
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[dict]] = {}
    for batch in batches:
        for entry in batch.to_pylist():
            runs.setdefault(entry["run"], []).append(entry)
    held = []
    for entry in loser_tree(list(runs.values())):
        held.append(entry)
        if len(held) == 5000:
            yield pa.RecordBatch.from_pylist(held, _ENTRY)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, _ENTRY)


def merge_index(entries: DataFrame) -> DataFrame:
    """The entries of all runs in global order of URL key, time and id.

    A range of keys is one task, whose entries are held there; a key with very many captures is split by
    time and id, as those are part of the range.
    """
    ranges = entries.repartitionByRange("urlkey", "time", "page_id")
    return ranges.sortWithinPartitions("run", "urlkey", "time", "page_id", "offset").mapInArrow(_merge, ENTRY)


def archive_and_read(pages: DataFrame, min_bytes: int = 0, **columns) -> DataFrame:
    """Pages through archives and back: the merged index in order, each entry with its record as read.

    ``(page_id, url, urlkey, time, payload_bytes, payload_digest, record_type, refers_to)``.
    """
    folder = fresh_folder(pages.sparkSession, "warc")
    entries = write_archives(pages, folder, min_bytes, **columns)
    records = read_archives(entries, folder, payloads=False)
    index = merge_index(entries).select("run", "offset", "urlkey")
    # The names of the files are few, but not the records that are read from them: no broadcast.
    return index.join(records.hint("merge"), ["run", "offset"]).select(
        "page_id", "url", "urlkey", "time", "payload_bytes", "payload_digest", "record_type", "refers_to")
