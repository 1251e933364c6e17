"""Chat formatting: records of many layouts become canonical turns, turns one marked-up text.

A record is a JSON object. Its nested field paths, list elements merged, are hashed to a fingerprint; a table from
fingerprint to declarative mapping tells how to read the layout. Mappings are data: where the list of
turns is, which fields hold role and text, what foreign role names mean, or which fields stand for which
role in which order. Records of an unknown layout are told apart by their fingerprint and come out without
turns, so that a mapping can be added.

The text of a conversation marks each turn as ``<turn>role`` newline text ``</turn>`` newline. ``<`` and the backslash
inside roles and texts are escaped reversibly, so no text can open or close a turn. The loss mask lists the
places of the assistant's texts in it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
LEARNED = "assistant"

TURNS = "array<struct<role:string,text:string>>"
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])


# --- layouts --------------------------------------------------------------------------------------------

def paths(value, prefix: str = "") -> set[str]:
    """Nested field paths of a JSON value; elements of a list share one path."""
    if isinstance(value, dict):
        found = {prefix + "{}"} if not value else set()
        return found.union(*(paths(v, f"{prefix}.{k}") for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths(v, prefix + "[]") for v in value)) if value else {prefix + "[]"}
    return {prefix}


def fingerprint(names: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """How to read one layout.

    Either ``turns`` names a list whose elements hold ``role`` and ``text``, or ``fields`` lists pairs of role and field
    in the order of their turns; several fields of one role in a row are joined by an empty line.
    ``optional`` fields may be absent. ``roles`` translates role names.
    """

    name: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: Sequence[tuple[str, str]] = ()
    optional: frozenset[str] = frozenset()
    roles: Mapping[str, str] = field(default_factory=dict)

    def fingerprints(self) -> set[str]:
        """Of every set of paths the layout can have."""
        if self.turns:
            whole = {f".{self.turns}[].{self.role}", f".{self.turns}[].{self.text}"}
            return {fingerprint(whole), fingerprint({f".{self.turns}[]"})}
        names = [name for _, name in self.fields]
        sets = [frozenset(f".{n}" for n in names if n not in self.optional)]
        for extra in sorted(self.optional):
            sets += [s | {f".{extra}"} for s in sets]
        return {fingerprint(set(s)) for s in sets}

    def read(self, record: dict) -> list[tuple[str, str]]:
        if self.turns:
            every = [(t.get(self.role), t.get(self.text)) for t in record.get(self.turns) or []]
            return [(self.roles.get(r, r) if r is not None else "", x or "") for r, x in every]
        out: list[tuple[str, str]] = []
        last = None
        for role, name in self.fields:
            if name not in record:
                continue
            text = record[name] or ""
            if role == last:
                out[-1] = (role, f"{out[-1][1]}\n\n{text}" if text else out[-1][1])
            else:
                out.append((role, text))
            last = role
        return out


# Layouts in public use.
LAYOUTS = (
    Layout("messages", turns="messages"),
    Layout("conversations", turns="conversations", role="from", text="value",
           roles={"human": "user", "gpt": "assistant"}),
    Layout("prompt_completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("question_answer", fields=(("system", "system_prompt"), ("user", "question"), ("assistant", "response")),
           optional=frozenset({"system_prompt"})),
    Layout("instruction", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output")),
           optional=frozenset({"input"})),
)


def layout_table(layouts: Sequence[Layout] = LAYOUTS) -> dict[str, Layout]:
    table: dict[str, Layout] = {}
    for layout in layouts:
        for key in layout.fingerprints():
            if key in table:
                raise ValueError(f"layouts {table[key].name} and {layout.name} have the same paths")
            table[key] = layout
    return table


def _canonical(batches: Iterator[pa.RecordBatch], table: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, names, turns = [], [], []
        for text in batch.column("record").to_pylist():
            try:
                record = json.loads(text) if text else None
            except ValueError:
                record = None
            layout = None
            if isinstance(record, dict):
                prints.append(fingerprint(paths(record)))
                layout = table.value.get(prints[-1])
            else:
                prints.append(None)
            names.append(layout.name if layout else None)
            turns.append([dict(role=str(r), text=str(t)) for r, t in layout.read(record)] if layout else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(prints, pa.string()), pa.array(names, pa.string()),
             pa.array(turns, pa.list_(_TURN))], ["id", "fingerprint", "layout", "turns"])


def canonical_turns(
    records: DataFrame, id_col: str = "id", record_col: str = "record", layouts: Sequence[Layout] = LAYOUTS,
) -> DataFrame:
    """``(id, fingerprint, layout, turns)`` per JSON record; ``turns`` is a list of role and text.

    A record that is no JSON object has no fingerprint; one of an unknown layout has no layout. Both have
    NULL turns. NULL roles and texts are empty. Repeated rows are answered each; an empty table gives no rows. Other
    columns are not read.
    """
    table = records.sparkSession.sparkContext.broadcast(layout_table(layouts))
    narrow = records.select(F.col(id_col).alias("id"), F.col(record_col).cast("string").alias("record"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(
        partial(_canonical, table=table), f"id {kind}, fingerprint string, layout string, turns {TURNS}")


# --- the template -----------------------------------------------------------------------------------------

def escape(text: str) -> str:
    return text.replace("\\", "\\b").replace("<", "\\l")


def unescape(text: str) -> str:
    return text.replace("\\l", "<").replace("\\b", "\\")


def render(turns: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The marked-up text, and start and end of the assistant's texts in it, in code points."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
        parts += [head, body, CLOSE]
        at += len(head)
        if role == LEARNED:
            mask.append((at, at + len(body)))
        at += len(body) + len(CLOSE)
    return "".join(parts), mask


_TURN_TEXT = re.compile(f"{OPEN}([^\n]*)\n([^<]*){CLOSE}")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a marked-up text; raises if it is none."""
    turns, at = [], 0
    for m in _TURN_TEXT.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        turns.append((unescape(m[1].replace("\\n", "\n")), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text behind the last turn")
    return turns


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        texts, masks = [], []
        for turns in batch.column("turns").to_pylist():
            text, mask = render([(t["role"], t["text"]) for t in turns]) if turns is not None else (None, None)
            texts.append(text)
            masks.append(mask and [dict(start=s, end=e) for s, e in mask] or (None if mask is None else []))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("layout"), pa.array(texts, pa.string()), pa.array(masks, pa.list_(span))],
            ["id", "layout", "formatted", "loss_mask"])


def format_turns(canonical: DataFrame) -> DataFrame:
    """``(id, layout, formatted, loss_mask)`` from canonical turns; NULL turns give NULL."""
    kind = canonical.schema["id"].dataType.simpleString()
    return canonical.select("id", "layout", "turns").mapInArrow(
        _render, f"id {kind}, layout string, formatted string, loss_mask array<struct<start:long,end:long>>")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    for batch in batches:
        rows = []
        for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss_mask").to_pylist()):
            turns = parse(text or "")
            learned = "".join(unescape(text[m["start"]:m["end"]]) for m in mask or [])
            rows.append((len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), digest(learned),
                         len(text or "")))
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
            ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what a reader finds in the formatted texts and under their loss masks."""
    kind = formatted.schema["id"].dataType.simpleString()
    return formatted.select("id", "formatted", "loss_mask").mapInArrow(
        _read_back, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


# --- records from rows of turns ---------------------------------------------------------------------------

def records_of(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """``(id, record)``: a JSON record per conversation, in the layout that fits its roles.

    User and assistant alone become prompt and completion; system, user, assistant become question and
    response; conversations of known roles with an odd number of turns the foreign role names; all
    others plain messages. Rows are ordered by turn, then role and text, so ties don't depend on the
    order of reading; NULL roles and texts are empty; a NULL id is a conversation of its own. One conversation is one
    record, whatever its length.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles = F.array_join(F.transform("t", lambda t: t["role"]), ",")
    text = F.transform("t", lambda t: t["text"])
    foreign = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"), F.lit("system"), F.lit("system"))
    known = F.forall("t", lambda t: t["role"].isin("user", "assistant", "system"))
    record = F.when(roles == "user,assistant", F.to_json(F.struct(
        F.get(text, 0).alias("prompt"), F.get(text, 1).alias("completion"))))
    record = record.when(roles == "system,user,assistant", F.to_json(F.struct(
        F.get(text, 0).alias("system_prompt"), F.get(text, 1).alias("question"), F.get(text, 2).alias("response"))))
    record = record.when(known & (F.size("t") % 2 == 1), F.to_json(F.struct(F.transform("t", lambda t: F.struct(
        foreign[t["role"]].alias("from"), t["text"].alias("value"))).alias("conversations"))))
    record = record.otherwise(F.to_json(F.struct(F.transform("t", lambda t: F.struct(
        t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))))
    return grouped.select("id", record.alias("record"))
