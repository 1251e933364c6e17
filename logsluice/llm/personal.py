"""Personal data: base rules and a character-level BiLSTM-CRF over overlapping windows.

The rules find four kinds with certainty. The tagger is trained on their spans in a bounded sample of
documents (``TRAIN_DOCS`` by hash order, texts up to ``TRAIN_CHARS`` characters) and then reads every whole
text in overlapping windows. Spans of the windows are reconciled over the document: pieces of one kind that
overlap are joined, a joined span must be what its kind demands (digits, parts, check digit), and of
spans that overlap the set with the largest total confidence stays. The rules' spans always stay.

Every kind demands an ``@`` or four digits, so a window with neither can't hold a valid span and is not
decoded.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from logsluice.llm.tagger import PAD, Tagger, encode

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
TRAIN_DOCS = 600
TRAIN_CHARS = 50_000
TRAIN_WINDOWS = 1500
MIN_WINDOWS = 40
STEPS = 160
CONFIDENCE = 0.9
_DECODE_AT_ONCE = 256

SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"

# --- rules ------------------------------------------------------------------------------------------

_TRIGGER = re.compile("[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def _digits(text: str) -> str:
    return _NOT_DIGIT.sub("", text)


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def is_ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def is_card(text: str) -> bool:
    digits = _digits(text)
    return 12 <= len(digits) <= 19 and _luhn(digits)


def is_phone(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def is_email(text: str) -> bool:
    local, at, domain = text.partition("@")
    return bool(local and at and _DOMAIN.fullmatch(domain))


_VALID = {"email": is_email, "ip": is_ip, "card": is_card, "phone": is_phone}


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` the run before it and the domain behind it, so time is linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                free = domain.end()
                yield start, free
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the rules, by start, then kind as listed."""
    if not _TRIGGER.search(text):
        return []
    found = [("email", s, e) for s, e in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _VALID[kind](m.group())]
    return sorted(found, key=_place)


def _place(span: tuple) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


# --- windows -------------------------------------------------------------------------------------------

def _codes(text: str) -> np.ndarray:
    return encode(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64))


def window_starts(codes: np.ndarray) -> np.ndarray:
    """Starts of the windows that can hold a valid span; together they cover every such place."""
    starts = np.arange(0, max(1, len(codes) - WINDOW + STRIDE), STRIDE)
    ends = np.minimum(starts + WINDOW, len(codes))
    digits = np.concatenate([[0], np.cumsum((codes >= 48) & (codes <= 57))])
    ats = np.concatenate([[0], np.cumsum(codes == 64)])
    return starts[(digits[ends] - digits[starts] >= 4) | (ats[ends] > ats[starts])]


def cut_window(codes: np.ndarray, start: int) -> np.ndarray:
    out = np.full(WINDOW, PAD, np.int16)
    piece = codes[start:start + WINDOW]
    out[:len(piece)] = piece
    return out


def _tagged(size: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    tags = np.zeros(size, np.int64)
    for kind, start, end in spans:
        if not tags[start:end].any():
            k = KINDS.index(kind)
            tags[start] = 1 + 2 * k
            tags[start + 1:end] = 2 + 2 * k
    return tags


def training_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows around the rules' spans at varying places, and windows of digits without spans.

    What looks like a kind but fails its check may hold a span that the rules can't cut out, so windows
    with such text teach nothing and are left out.
    """
    rng, codes, tags = np.random.default_rng(3), [], []
    for text in texts:
        spans, code = base_spans(text), _codes(text)
        tag = _tagged(len(code), spans)
        starts = [max(0, s - int(rng.integers(0, WINDOW))) for _, s, _ in spans]
        starts += [int(s) for s in window_starts(code) if not tag[s:s + WINDOW].any()][:4]
        unsure = np.zeros(len(code) + 1, bool)
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            for m in pattern.finditer(text):
                if len(_digits(m.group())) >= 9 and not _VALID[kind](m.group()):
                    unsure[m.start():m.end()] = True
        for start in starts:
            if unsure[start:start + WINDOW].any():
                continue
            codes.append(cut_window(code, start))
            tags.append(np.concatenate([tag[start:start + WINDOW], np.zeros(WINDOW, np.int64)])[:WINDOW])
        if len(codes) >= TRAIN_WINDOWS:
            break
    return np.array(codes, np.int16).reshape(-1, WINDOW), np.array(tags, np.int64).reshape(-1, WINDOW)


def train(docs: DataFrame, text_col: str = "text", steps: int = STEPS) -> Tagger | None:
    """A tagger from a bounded sample of the documents; None if there is too little to learn from."""
    text = F.col(text_col).cast("string")
    keyed = docs.select(text.alias("text")).filter(
        text.rlike("[0-9@]") & (F.length(text) <= TRAIN_CHARS)).withColumn("hash", F.xxhash64("text"))
    # Which texts is settled on hashes alone; only then are texts fetched, each once.
    last = keyed.select("hash").distinct().orderBy("hash").limit(TRAIN_DOCS).agg(F.max("hash")).first()[0]
    if last is None:
        return None
    sample = keyed.filter(F.col("hash") <= last).groupBy("hash").agg(F.min("text").alias("text"))
    codes, tags = training_windows([r["text"] for r in sorted(sample.collect(), key=lambda r: r["hash"])])
    if len(codes) < MIN_WINDOWS or not tags.any():
        return None
    model = Tagger(KINDS)
    model.fit(codes, tags, steps)
    return model


# --- decoding and reconciling -----------------------------------------------------------------------------

def _window_spans(tags: np.ndarray, sure: np.ndarray, start: int) -> list[tuple[str, int, int, float]]:
    spans, t = [], 0
    while t < len(tags):
        if not tags[t]:
            t += 1
            continue
        end, inside = t + 1, 2 + 2 * ((tags[t] - 1) // 2)
        while end < len(tags) and tags[end] == inside:
            end += 1
        spans.append((KINDS[(tags[t] - 1) // 2], start + t, start + end, float(sure[t:end].mean())))
        t = end
    return spans


def reconcile(
    text: str, base: list[tuple[str, int, int]], pieces: list[tuple[str, int, int, float]],
) -> list[tuple[str, int, int, float, bool]]:
    """One set of spans for the document from the windows' pieces and the rules' spans."""
    joined: list[list] = []
    for kind, start, end, score in sorted(pieces):
        last = joined[-1] if joined else None
        if last and last[0] == kind and start < last[2]:
            last[2], last[3] = max(last[2], end), max(last[3], score)
        else:
            joined.append([kind, start, end, score])
    fixed = sorted((s, e) for _, s, e in base)
    reach = np.maximum.accumulate([e for _, e in fixed]) if fixed else []
    open_ = []
    for kind, start, end, score in joined:
        before = bisect_right(fixed, (end - 1, len(text) + 1)) - 1
        free = before < 0 or reach[before] <= start
        if free and score >= CONFIDENCE and _VALID[kind](text[start:end]):
            open_.append((kind, start, end, score))
    open_.sort(key=lambda s: (s[2], s[1]))
    ends, best = [s[2] for s in open_], [(0.0, None, 0)]
    for i, (_, start, _, score) in enumerate(open_):
        before = bisect_right(ends, start, 0, i)
        best.append(max(best[i], (best[before][0] + score, i, before), key=lambda b: b[0]) if
                    best[before][0] + score > best[i][0] else (best[i][0], None, i))
    chosen, at = [], len(open_)
    while at:
        _, took, before = best[at]
        if took is not None:
            chosen.append((*open_[took], False))
        at = before
    every = [(k, s, e, 1.0, True) for k, s, e in base] + chosen
    return sorted(every, key=_place)


def spans_of(texts: list[str], model: Tagger | None) -> list[list[tuple[str, int, int, float, bool]]]:
    """Spans of each text, windows of all texts decoded together."""
    base = [base_spans(t) for t in texts]
    pieces: list[list] = [[] for _ in texts]
    if model is not None:
        owners, starts, windows = [], [], []

        def flush() -> None:
            if windows:
                tags, sure = model.decode(np.array(windows))
                for owner, start, tag, p in zip(owners, starts, tags, sure):
                    pieces[owner] += _window_spans(tag, p, start)
            owners.clear(), starts.clear(), windows.clear()

        for i, text in enumerate(texts):
            if not _TRIGGER.search(text):
                continue
            codes = _codes(text)
            for start in window_starts(codes).tolist():
                owners.append(i), starts.append(start), windows.append(cut_window(codes, start))
                if len(windows) == _DECODE_AT_ONCE:
                    flush()
        flush()
    return [reconcile(t, b, p) for t, b, p in zip(texts, base, pieces)]


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                   ("score", pa.float64()), ("base", pa.bool_())])


def _find(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in _SPAN]
    for batch in batches:
        found = spans_of(_texts(batch, "text"), model.value)
        spans = pa.array([[dict(zip(names, s)) for s in spans] for spans in found], pa.list_(_SPAN))
        yield pa.RecordBatch.from_arrays([batch.column("id"), spans], ["id", "spans"])


def find_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None,
) -> DataFrame:
    """``(id, spans)`` of every row; offsets are code points of the whole text, end exclusive.

    Without ``model`` one is trained on a sample of ``docs``. NULL or empty text has no spans; repeated
    rows are answered each; if there is too little to train on, the rules' spans alone remain. Other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(model or train(docs, text_col))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(partial(_find, model=model), f"id {narrow.schema['id'].dataType.simpleString()}, spans {SPANS}")


def redacted(text: str, spans: list[tuple]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first one."""
    out, at = [], 0
    for kind, start, end, *_ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _redact(batches: Iterator[pa.RecordBatch], model: Broadcast, text_col: str, length_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        old = batch.column(text_col).to_pylist()
        found = spans_of([t or "" for t in old], model.value)
        new = [t if not s else redacted(t, s) for t, s in zip(old, found)]
        columns, names = list(batch.columns), batch.schema.names
        columns[names.index(text_col)] = pa.array(new, batch.column(text_col).type)
        if length_col in names:
            sizes = batch.column(length_col)
            lengths = [n if not s else len(t) for n, t, s in zip(sizes.to_pylist(), new, found)]
            columns[names.index(length_col)] = pa.array(lengths, sizes.type)
        yield pa.RecordBatch.from_arrays(columns, names)


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", model: Tagger | None = None) -> DataFrame:
    """``docs`` with personal data replaced by ``<KIND>``; ``length_col``, if there, follows the text.

    NULL stays NULL. Texts without personal data stay as they are, all rows and columns stay.
    """
    model = docs.sparkSession.sparkContext.broadcast(model or train(docs, text_col))
    return docs.mapInArrow(partial(_redact, model=model, text_col=text_col, length_col=length_col), docs.schema)


def digest(spans: str = "spans", base_only: bool = False):
    """``kind:start:end`` of the spans, comma-joined."""
    rows = F.filter(spans, lambda s: s["base"]) if base_only else F.col(spans)
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
