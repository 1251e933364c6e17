"""Token ids as binary shards, and a minimal perfect hash index from document keys to places in them.

A shard is a file of raw little-endian ids and nothing else, with a table of offsets beside it: the ids of document ``i``
of a shard lie between offsets ``i`` and ``i + 1``. Documents follow each other in ascending order of their key, within and
across shards. The index maps a key to its shard and place in constant time: a minimal perfect hash sends the keys of an
index part to the numbers from 0 on without gaps, and the slot there holds a fingerprint, which tells keys that are not
stored, and the shard and place of the key's first document. Documents that share a key follow each other, so a slot
needs only their number in the shard; if they go on in the next shards, the part lists one run for each of those.

The perfect hash is built in levels: at each level the keys left over are hashed to about ``GAMMA`` times as many bits; a
bit that one key alone hits is set and settles that key, all others go on. A key's number is the rank of its bit.

Files go through ``pyarrow.fs`` to the shared folder. Their names are new in every attempt of a task and only the rows of
attempts that succeeded name them, so a lost executor leaves unused files but no wrong result.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from logsluice.llm.common import cut, fresh_folder, pieces, small
from logsluice.llm.words import mixed

END_ID = 0
# Ids per shard; a document is never cut, so a shard can exceed it by one document.
SHARD_IDS = 1 << 24
# Keys per part of the index, on average.
INDEX_KEYS = 1 << 20
GAMMA = 2.0
# Pieces of texts whose ids a task remembers, and the longest piece that is remembered.
CACHED_PIECES = 800_000
CACHED_CHARS = 40
# Characters that are encoded at a time.
SEGMENT = 1 << 18

_MAGIC = b"MPHIDX1\n"
_PLACE = pa.schema([
    ("id", pa.int64()), ("range", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("row", pa.int64()),
    ("offset", pa.int64()), ("n", pa.int64())])
PLACE = "id long, range int, seq int, file string, row long, offset long, n long"
_FOUND = pa.schema([
    ("id", pa.int64()), ("shard", pa.int64()), ("row", pa.int64()), ("copies", pa.int64())])
FOUND = "id long, shard long, row long, copies long"


# --- encoding -------------------------------------------------------------------------------------------

# White space that splits pieces for certain, and everything that some definition of white space may include; letters and
# marks that all definitions agree on.
_SURE = r" \t\n\r"
_OTHER = "\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\ufeff"
_LETTER = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_MARK = r"!-/:-@\[-`{-~"
_ANY = _SURE + _OTHER
_RUN_OF = f"(?:[^{_ANY}{_LETTER}]++|[{_LETTER}]++(?![{_MARK}]))*+[{_LETTER}]*+"
# Most pieces are a word with or without a blank in front; the general form comes second.
_WORD = f"[{_SURE}]?[{_LETTER}]++(?=[{_SURE}{_MARK}])"
_PIECES = re.compile(f"{_WORD}|[{_ANY}]*+(?=[^{_ANY}]){_RUN_OF}(?:[{_OTHER}][{_ANY}]*+{_RUN_OF})*+|[{_ANY}]++")
_WHITE = re.compile(f"[{_ANY}]")
_BORDER = re.compile(f"[^{_ANY}](?=[{_SURE}])")


def pieces_of(text: str) -> list[str]:
    """The text in pieces that a byte-level pair encoder treats apart.

    Its pattern never joins a character with white space behind it, nor a letter with a mark behind it, so a piece ends
    before a run of white space and between a letter and a mark.
    """
    return _PIECES.findall(text)


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """A long text in parts of about ``size`` characters that end where a piece does."""
    at = 0
    while len(text) - at > size:
        border = _BORDER.search(text, at + size)
        if border is None:
            break
        yield text[at:border.end()]
        at = border.end()
    yield text[at:]


class Encoder:
    """Ids of texts by a byte-level tokenizer; each piece is encoded once and then remembered, up to a bound.

    New pieces are joined and encoded together. Their ids are told apart by the bytes that each id stands for.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer  # here, as only tasks that encode need it

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.cache: dict[str, bytes] = {}
        self.long: list[str] = []
        vocabulary = self.tokenizer.get_vocab()
        # A character of a token's name is a byte, but for added tokens, which are named by their text.
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for name, number in vocabulary.items():
            self.bytes_of[number] = len(name)
        added = self.tokenizer.get_added_tokens_decoder()
        for number, token in added.items():
            if _WHITE.search(token.content) or token.lstrip or token.rstrip or token.single_word:
                raise ValueError("added tokens that reach into white space or words can't be told apart from pieces")
            self.bytes_of[number] = len(token.content.encode())
        names = [re.escape(t.content) for t in added.values() if not (t.special and special_as_text)]
        self.added = re.compile(f"({'|'.join(sorted(names, key=len, reverse=True))})") if names else None

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as native 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            known = self._learn(held)
            for i, parts in held:
                out[i].append(b"".join(map(known.__getitem__, parts)))
            for p in [p for p in self.long if p in known]:
                del known[p]
            self.long = []

        for i, text in enumerate(texts):
            for segment in segments(text):
                held.append((i, self._pieces(segment)))
                size += len(segment)
                if size > SEGMENT:
                    settle()
                    held, size = [], 0
        settle()
        return [b"".join(x) for x in out]

    def _pieces(self, text: str) -> list[str]:
        """Pieces of the text between added tokens, and these."""
        if self.added is None or not self.added.search(text):
            return pieces_of(text)
        return [p for j, part in enumerate(self.added.split(text)) for p in ([part] if j % 2 else pieces_of(part))]

    def _learn(self, held: list[tuple[int, list[str]]]) -> dict[str, bytes]:
        """A map that holds all pieces of the texts."""
        every = set().union(*(parts for _, parts in held))
        new = [p for p in every if p not in self.cache]
        if len(self.cache) + len(new) > CACHED_PIECES:
            self.cache = {p: self.cache[p] for p in every if p in self.cache}
        joint = [p for p in new if p[0] in " \t\n\r" and (p[-1].isalnum() or not _WHITE.match(p[-1]))]
        found = dict(zip(joint, self._joined(joint)))
        alone = [p for p in new if p not in found]
        found.update(zip(alone, (array("I", e.ids).tobytes() for e in self._encode(alone))))
        self.long = [p for p in alone if len(p) > CACHED_CHARS] + [p for p in joint if len(p) > CACHED_CHARS]
        self.cache.update(found)
        return self.cache

    def _joined(self, pieces: list[str], count: int = 2000) -> Iterator[bytes]:
        """Ids of pieces that begin with white space and end without, so that no token spans a border."""
        groups = [pieces[at:at + count] for at in range(0, len(pieces), count)]
        for group, encoding in zip(groups, self._encode(["".join(g) for g in groups])):
            ids = np.array(encoding.ids, np.uint32)
            ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in group])
            upto = np.cumsum(self.bytes_of[ids])
            last = np.searchsorted(upto, ends) + 1
            if last[-1] != len(ids) or (upto[last - 1] != ends).any():
                raise ValueError("the tokenizer joins pieces or isn't a byte-level one")
            raw = ids.tobytes()
            at = 0
            for end in (4 * last).tolist():
                yield raw[at:end]
                at = end

    def _encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)


@lru_cache(maxsize=1)
def encoder_of(path: str, special_as_text: bool) -> Encoder:
    """One encoder per Python worker: its memory serves the worker's later tasks."""
    return Encoder(path, special_as_text)


def id_width(path: str) -> int:
    """Bytes per id: two if the vocabulary fits, else four."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


# --- shards -----------------------------------------------------------------------------------------------

def _write(
    batches: Iterator[pa.RecordBatch], folder: str, path: str, special_as_text: bool, end_id: int, width: int, shard_ids: int,
) -> Iterator[pa.RecordBatch]:
    files, base = FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    encoder, place = None, TaskContext.get().partitionId()
    out, name, seq, keys, offsets = None, "", -1, [], [0]
    end = np.array([end_id], np.uint32)

    def finish() -> pa.RecordBatch:
        out.close()
        with files.open_output_stream(f"{base}/{name}.off", compression=None) as table:
            table.write(np.array(offsets, "<i8").tobytes())
        size = len(keys)
        places = np.array(offsets, np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(keys, pa.int64()), pa.array([place] * size, pa.int32()), pa.array([seq] * size, pa.int32()),
            pa.array([name] * size), pa.array(np.arange(size)), pa.array(places[:-1]), pa.array(np.diff(places))], schema=_PLACE)

    for batch in batches:
        encoder = encoder or encoder_of(path, special_as_text)
        sizes = pc.binary_length(batch.column("text")).to_numpy()
        for lo, hi in pieces(sizes, 4 * SEGMENT):
            part = batch.slice(lo, hi - lo)
            for key, raw in zip(part.column("id").to_pylist(), encoder.ids(part.column("text").to_pylist())):
                if out is None:
                    name, seq, keys, offsets = uuid.uuid4().hex, seq + 1, [], [0]
                    out = files.open_output_stream(f"{base}/{name}.ids", compression=None, buffer_size=1 << 20)
                ids = np.concatenate([np.frombuffer(raw, np.uint32), end])
                out.write(ids.astype(f"<u{width}").tobytes())
                keys.append(key)
                offsets.append(offsets[-1] + len(ids))
                if offsets[-1] >= shard_ids:
                    yield finish()
                    out = None
    if out is not None:
        yield finish()


def write_shards(
    docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
    special_as_text: bool = False, shard_ids: int = SHARD_IDS,
) -> tuple[DataFrame, DataFrame]:
    """Encode all documents into shards below ``folder``.

    Returns the places ``(id, shard, row, offset, n)`` of the documents and the shards ``(shard, file, width, start,
    docs, ids)``, numbered in order, with the number of ids before each. NULL ids come first. Documents that share an id are
    in the order of a hash of their text, which also parts them into ranges if they are very many.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = narrow.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    width = id_width(path)
    places = cut(rows.select("id", "text").mapInArrow(partial(
        _write, folder=folder, path=path, special_as_text=special_as_text, end_id=end_id, width=width,
        shard_ids=shard_ids), PLACE))
    shards = places.groupBy("range", "seq").agg(
        F.first("file").alias("file"), F.count("*").alias("docs"), F.sum("n").alias("ids"))
    # A row per file, of SHARD_IDS ids or the ids of one task, whichever is less: small beside the documents.
    order = Window.partitionBy(F.lit(0)).orderBy("range", "seq")
    shards = cut(shards.select(
        (F.row_number().over(order) - 1).cast("long").alias("shard"), "range", "seq", "file", F.lit(width).alias("width"),
        (F.sum("ids").over(order) - F.col("ids")).alias("start"), "docs", "ids"))
    places = places.join(small(shards.select("range", "seq", "shard")), ["range", "seq"])
    return places.select("id", "shard", "row", "offset", "n"), shards.drop("range", "seq")


# --- the minimal perfect hash ---------------------------------------------------------------------------

_STEP = np.uint64(0x9E3779B97F4A7C15)


def key_hashes(keys: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words per key; the first is one-to-one on keys, NULL differs from all in the second."""
    values = np.where(null, 0, keys).astype(np.int64).view(np.uint64)
    return mixed(values), mixed(mixed(values + _STEP) ^ null.astype(np.uint64))


def _positions(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(a + b * np.uint64(2 * level + 1) + _STEP * np.uint64(level)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct keys, from bit arrays and their running counts."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        bits = [np.concatenate([[0], np.cumsum(np.unpackbits(x.view(np.uint8)).reshape(-1, 64).sum(axis=1))]) for x in levels]
        base = np.cumsum([0, *(int(x[-1]) for x in bits)])
        self.ranks = [x + y for x, y in zip(bits, base)]
        self.size = int(base[-1])

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, gamma: float = GAMMA) -> PerfectHash:
        levels = []
        while len(a):
            size = -(-max(64, int(gamma * len(a))) // 64) * 64
            at = _positions(a, b, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = ~alone[at]
            a, b = a[rest], b[rest]
        return cls(levels)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each key; -1 or that of another key for one that was not built in."""
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                break
            at = _positions(a[left], b[left], level, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            ones = np.unpackbits(np.ascontiguousarray(below).view(np.uint8)).reshape(-1, 64).sum(axis=1)
            out[left[hit]] = ranks[at[hit] >> 6] + ones
            left = left[~hit]
        return out


_RUN = np.dtype([("shard", "<i8"), ("row", "<i8"), ("copies", "<i8")])
# ``runs`` further runs from ``more`` on in the part's list.
_SLOT = np.dtype([("print", "<u4"), *((n, "<i8") for n in ("shard", "row", "copies", "more", "runs"))])


def _prints(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mixed(a ^ (b + _STEP)) >> np.uint64(32)).astype(np.uint32)


def dump_part(perfect: PerfectHash, slots: np.ndarray, runs: np.ndarray) -> bytes:
    """Magic, numbers of levels, keys and runs, words of each level, bit arrays, slots, runs."""
    sizes = [len(x) for x in perfect.levels]
    return b"".join([
        _MAGIC, struct.pack("<qqq", len(sizes), perfect.size, len(runs)), struct.pack(f"<{len(sizes)}q", *sizes),
        *(x.astype("<u8").tobytes() for x in perfect.levels), slots.tobytes(), runs.tobytes()])


def load_part(data: bytes) -> tuple[PerfectHash, np.ndarray, np.ndarray]:
    if not data.startswith(_MAGIC):
        raise ValueError("not a part of an index")
    at = len(_MAGIC)
    levels, size, more = struct.unpack_from("<qqq", data, at)
    sizes = struct.unpack_from(f"<{levels}q", data, at + 24)
    at += 24 + 8 * levels
    if len(data) != at + 8 * sum(sizes) + size * _SLOT.itemsize + more * _RUN.itemsize:
        raise ValueError("part of an index is cut off")
    words = []
    for n in sizes:
        words.append(np.frombuffer(data, "<u8", n, at).astype(np.uint64))
        at += 8 * n
    slots = np.frombuffer(data, _SLOT, size, at)
    return PerfectHash(words), slots, np.frombuffer(data, _RUN, more, at + slots.nbytes)


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("id")
    null = column.is_null().to_numpy(zero_copy_only=False)
    return key_hashes(column.fill_null(0).to_numpy(), null)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of one part after the other; they come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        parts = batch.column("part").to_numpy()
        for border in [*(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]:
            if held and at < border and held[0].column("part")[0].as_py() != int(parts[at]):
                yield held[0].column("part")[0].as_py(), pa.Table.from_batches(held)
                held = []
            if border > at:
                held.append(batch.slice(at, border - at))
            at = border
    if held:
        yield held[0].column("part")[0].as_py(), pa.Table.from_batches(held)


def _build(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, base = FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    for part, rows in _parts(batches):
        rows = rows.combine_chunks().to_batches()[0]
        a, b = _keys(rows)
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        first = np.flatnonzero(new)
        perfect = PerfectHash.build(a[first], b[first])
        at = perfect.find(a[first], b[first])
        slots, runs = np.zeros(perfect.size, _SLOT), np.zeros(int((~new).sum()), _RUN)
        slots["print"][at] = _prints(a[first], b[first])
        for name in _RUN.names:
            column = rows.column(name).to_numpy()
            slots[name][at], runs[name] = column[first], column[~new]
        slots["runs"][at] = np.diff(np.append(first, len(a))) - 1
        slots["more"][at] = first - np.arange(len(first))
        name = f"{uuid.uuid4().hex}.mph"
        with files.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(dump_part(perfect, slots, runs))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "index_file": [name]})


def _part(keys: DataFrame, parts: int) -> DataFrame:
    return keys.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("long"))


def build_index(places: DataFrame, folder: str, index_keys: int = INDEX_KEYS) -> DataFrame:
    """Write the index of all documents below ``folder``; returns its files ``(part, index_file, parts)``."""
    runs = cut(places.groupBy("id", "shard").agg(F.min("row").alias("row"), F.count("*").alias("copies")))
    parts = -(-runs.count() // index_keys) or 1
    rows = _part(runs, parts).repartition("part").sortWithinPartitions("part", "id", "shard")
    built = rows.mapInArrow(partial(_build, folder=folder), "part long, index_file string")
    return cut(built).withColumn("parts", F.lit(parts).cast("long"))


# --- access -------------------------------------------------------------------------------------------------

def _look_up(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, base = FileSystem.from_uri(folder)
    for _, rows in _parts(batches):
        with files.open_input_stream(f"{base}/{rows.column('index_file')[0].as_py()}", compression=None) as source:
            perfect, slots, runs = load_part(source.read())
        for batch in rows.to_batches(max_chunksize=1 << 16):
            a, b = _keys(batch)
            at = perfect.find(a, b)
            known = at >= 0
            known[known] = slots["print"][at[known]] == _prints(a[known], b[known])
            hit, ids = slots[at[known]], batch.column("id").filter(pa.array(known))
            times = hit["runs"]
            more = np.repeat(hit["more"] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            again = ids.take(pa.array(np.repeat(np.arange(len(hit)), times)))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(hit[n]) for n in _RUN.names)], schema=_FOUND)
            yield pa.RecordBatch.from_arrays([again, *(pa.array(runs[more][n]) for n in _RUN.names)], schema=_FOUND)


def look_up(keys: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """``(id, shard, row, copies)`` of the keys ``(id)`` that are stored, a row per shard; other keys give none."""
    parts = index.select("parts").first()
    if parts is None:
        return keys.sparkSession.createDataFrame([], FOUND)
    named = _part(keys.select("id"), parts["parts"]).join(small(index.drop("parts")), "part")
    return named.repartition("part").sortWithinPartitions("part").mapInArrow(partial(_look_up, folder=folder), FOUND)


_DOC = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
DOC = "id long, start long, n long, ids binary"


class _Shard:
    """An open shard; reads that follow each other come from one window of it."""

    def __init__(self, files: FileSystem, path: str, width: int):
        self.path, self.width, self.at, self.window = path, width, 0, b""
        with files.open_input_stream(f"{path}.off", compression=None) as source:
            self.offsets = np.frombuffer(source.read(), "<i8")
        self.source = files.open_input_file(f"{path}.ids")

    def ids(self, row: int) -> tuple[int, np.ndarray]:
        lo, hi = int(self.offsets[row]) * self.width, int(self.offsets[row + 1]) * self.width
        if lo < self.at or hi > self.at + len(self.window):
            self.source.seek(lo)
            self.at, self.window = lo, self.source.read(max(hi - lo, 1 << 20))
            if len(self.window) < hi - lo:
                raise ValueError(f"shard {self.path} is cut off")
        ids = np.frombuffer(self.window, f"<u{self.width}", (hi - lo) // self.width, lo - self.at)
        return lo // self.width, ids.astype("<u4")


def _documents(batches: Iterator[pa.RecordBatch], folder: str, digests: bool) -> Iterator[pa.RecordBatch]:
    files, base = FileSystem.from_uri(folder)
    shard: _Shard | None = None
    out: list[tuple] = []
    size = 0
    for batch in batches:
        for r in batch.to_pylist():
            if shard is None or shard.path != f"{base}/{r['file']}":
                if shard is not None:
                    shard.source.close()
                shard = _Shard(files, f"{base}/{r['file']}", r["width"])
            for row in range(r["row"], r["row"] + r["copies"]):
                at, ids = shard.ids(row)
                raw = ids.tobytes()
                out.append((r["id"], r["start"] + at, len(ids), zlib.crc32(raw).to_bytes(4, "big") if digests else raw))
                size += len(out[-1][-1]) + 32
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pydict(dict(zip(_DOC.names, map(list, zip(*out)))), schema=_DOC)
                    out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pydict(dict(zip(_DOC.names, map(list, zip(*out)))), schema=_DOC)


def read_documents(found: DataFrame, shards: DataFrame, folder: str, digests: bool = False) -> DataFrame:
    """``(id, start, n, ids)``: the ids of documents that were looked up, as little-endian 32-bit integers.

    ``start`` counts the ids of all documents before, ``n`` those of the document. With ``digests``, ``ids`` holds the
    four bytes of their CRC-32 instead.
    """
    sizes = small(shards.select("shard", "file", "width", "start"))
    # A fixed number, as Spark would put so narrow rows into few tasks, which then would read all shards.
    rows = found.join(sizes, "shard").repartition(max(1, shards.count()), "shard").sortWithinPartitions("shard", "row")
    return rows.mapInArrow(partial(_documents, folder=folder, digests=digests), DOC)


def store_and_read(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Documents through the files and back, by key: ``(id, start, n, ids_crc32)``.

    All texts are encoded whole and written; every key of the table is then looked up in the index and its documents
    read from the shards. NULL text is empty and gives the end id alone; a NULL id is a key like any other and comes
    first. Repeated ids keep each row. An empty table writes nothing and gives no rows. Other columns are not read.
    """
    folder = fresh_folder(docs.sparkSession, "tokens")
    places, shards = write_shards(docs, folder, path, id_col, text_col, **options)
    index = build_index(places, folder)
    keys = docs.select(F.col(id_col).cast("long").alias("id")).distinct()
    back = read_documents(look_up(keys, index, folder), shards, folder, digests=True)
    return back.select("id", "start", "n", F.conv(F.hex("ids"), 16, 10).cast("long").alias("ids_crc32"))


if sys.byteorder != "little":  # the pieces' ids are joined as native integers
    raise ImportError("token_store needs a little-endian machine")
