"""Patterns learned from many lines: the templates of each sourcetype, as a tree over tokenised lines.

A line is cut into tokens, each of a class: times, addresses and numbers, which always vary, marks and white space, which
stand for themselves, and open tokens (words, names with digits, quoted text), of which only frequency tells whether they
belong to the template. Lines with the same classes in the same places form a root of the tree.

A node splits at a place whose few values each settle the value of another place, as the words of a message
do ("login … from", "call … via"); values that come in all combinations (methods, states) are fields. Splits go
on until no node has such a place. In each node, an open place with one value is text, all others are fields.

Everything is an aggregate over tokenised lines with map-side combine, lines with equal open tokens once;
numbers of values are sketched first and counted only where they are few. The templates are a table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from logsluice.functions.literals import lookup
from logsluice.functions.rows import bind
from logsluice.operators.rules import Extraction
from logsluice.session import cut

# A place with more values than this is a field, whatever they settle.
MAX_BRANCH = 12
# Lines that each value of a splitting place must have.
MIN_LINES = 3
# Tokens of a line that are told apart; what follows is one field.
MAX_TOKENS = 200

_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_CLOCK = r"\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?"


@dataclass(frozen=True)
class TokenClass:
    """``open`` tokens are text or field by frequency, the others are always fields. ``frame`` is shown, not read."""

    name: str
    pattern: str
    open: bool = False
    frame: str = ""


CLASSES = (
    TokenClass("time", rf"\d{{4}}-\d{{2}}-\d{{2}}[T ]{_CLOCK}(?:Z|[+-]\d{{2}}:?\d{{2}})?|{_MONTH} [ \d]\d {_CLOCK}"
                       rf"|\d{{1,2}}/{_MONTH}/\d{{4}}:{_CLOCK}(?: [+-]\d{{4}})?"),
    TokenClass("email", r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+"),
    TokenClass("url", r"[a-z][a-z0-9+.-]*://[^\s\"'<>,;]+"),
    TokenClass("ip", r"\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\w)"),
    TokenClass("uuid", r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    TokenClass("number", r"[+-]?\d+(?:\.\d+)?(?!\w|\.\w)"),
    TokenClass("quoted", r'[^"]*', True, '"'),
    TokenClass("path", r"/[^\s\"'<>,;=]*\w[^\s\"'<>,;=]*"),
    TokenClass("word", r"[^\W\d]+(?:[.-][^\W\d]+)*(?!\w|[.-]\w)", True),
    TokenClass("name", r"\w(?:[\w.-]*\w)?", True),
)
REST = "rest"
_WHOLE = {c.name: f"{c.frame}(?:{c.pattern}){c.frame}" for c in CLASSES}
# Unicode word characters, the same in the tokens and in the patterns built from them.
_FLAGS = "(?U)"
_TOKENS = _FLAGS + "|".join(_WHOLE.values()) + r"|\s+|[\s\S]"


def _class_of(token: Column) -> Column:
    """The class of one token; white space is a blank, a mark is itself."""
    found = F.when(F.length(token) == 0, F.lit(""))
    first = F.substring(token, 1, 1)
    found = found.when(first.rlike(_FLAGS + r"^\s"), F.lit(" "))
    for c in CLASSES:
        found = found.when(token.rlike(f"{_FLAGS}\\A(?:{_WHOLE[c.name]})\\z"), F.lit(f"<{c.name}>"))
    return found.otherwise(token)


def tokens(raw: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """The line as ``array<struct<class,text>>``; what follows ``max_tokens`` is one token of class ``<rest>``."""
    def named(parts: Column) -> Column:
        head = F.transform(F.slice(parts, 1, max_tokens), lambda t: F.struct(_class_of(t).alias("class"), t.alias("text")))
        tail = F.array_join(F.slice(parts, max_tokens + 1, 1 << 30), "")
        rest = F.array(F.struct(F.lit(f"<{REST}>").alias("class"), tail.alias("text")))
        return F.when(F.size(parts) > max_tokens, F.concat(head, rest)).otherwise(head)

    return bind(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(_TOKENS), F.lit(0)), named)


_OPEN_TAGS = [f"<{c.name}>" for c in CLASSES if c.open]


def _with_shape(df: DataFrame, raw: str, max_tokens: int) -> DataFrame:
    """Add ``tokens``, ``shape`` (their classes) and ``words`` (texts of the open ones)."""
    shaped = df.withColumn("tokens", tokens(F.col(raw), max_tokens))
    shape = F.transform("tokens", lambda t: t["class"])
    words = F.transform(F.filter("tokens", lambda t: t["class"].isin(_OPEN_TAGS)), lambda t: t["text"])
    return shaped.withColumns({"shape": shape, "words": words})


_NODE = ["sourcetype", "shape", "node"]


# --- the tree -----------------------------------------------------------------------------------------------

def _few_valued(nodes: DataFrame, max_branch: int) -> DataFrame:
    """``(sourcetype, shape, node, places)``: places with 2 to ``max_branch`` values; sketched before counted."""
    each = nodes.select(*_NODE, "n", F.posexplode("words").alias("place", "word"))
    rough = each.groupBy(*_NODE, "place").agg(F.approx_count_distinct("word").alias("d"))
    # The sketch errs by five percent; twice the bound lets no place with fewer values go.
    rough = rough.filter(F.col("d").between(2, 2 * max_branch)).groupBy(*_NODE).agg(F.collect_set("place").alias("places"))
    values = _join(nodes, rough).select(*_NODE, "n", F.explode("places").alias("place"), F.col("words")).withColumn(
        "word", F.get("words", F.col("place"))).groupBy(*_NODE, "place").agg(F.count_distinct("word").alias("d"))
    return values.filter(F.col("d").between(2, max_branch)).groupBy(*_NODE).agg(F.sort_array(F.collect_set("place")).alias("places"))


def _join(nodes: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
    """``nodes`` with the columns that ``side`` has for the same node; NULL sourcetypes meet."""
    named = side.withColumnsRenamed({k: f"_{k}" for k in _NODE})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in _NODE]
    return nodes.join(named, same[0] & same[1] & same[2], how).drop(*[f"_{k}" for k in _NODE])


def _splits(nodes: DataFrame, max_branch: int, min_lines: int) -> DataFrame:
    """``(sourcetype, shape, node, at)``: the place at which a node splits, for those that do."""
    few = _few_valued(nodes, max_branch)
    mixed = _join(nodes, few)
    chosen = F.transform("places", lambda p: F.struct(p.alias("place"), F.get("words", p).alias("word")))
    combined = mixed.select(*_NODE, chosen.alias("chosen"), "n").groupBy(*_NODE, "chosen").agg(F.sum("n").alias("n"))
    one = combined.select(*_NODE, "chosen", "n", F.explode("chosen").alias("a"))
    pairs = one.select(*_NODE, "n", "a", F.explode("chosen").alias("b")).filter("a.place <> b.place")
    per_value = pairs.groupBy(*_NODE, F.col("a.place").alias("at"), F.col("a.word").alias("word"), F.col("b.place").alias("other")).agg(
        F.count_distinct("b.word").alias("others"), F.sum("n").alias("n"))
    settled = per_value.groupBy(*_NODE, "at", "other").agg(
        F.max("others").alias("others"), F.min("n").alias("least"), F.count("*").alias("values"))
    good = settled.filter((F.col("others") == 1) & (F.col("least") >= min_lines))
    # The place that settles most others, then that with more values, then the first.
    ranked = good.groupBy(*_NODE, "at").agg(F.count("*").alias("settles"), F.max("values").alias("values"))
    return ranked.groupBy(*_NODE).agg(F.min_by("at", F.struct(-F.col("settles"), -F.col("values"), F.col("at"))).alias("at"))


def learn(
    lines: DataFrame, raw: str = "raw", max_branch: int = MAX_BRANCH, min_lines: int = MIN_LINES, max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """Templates of ``(sourcetype, raw)``: one row each, with the pattern that reads its lines.

    ``(sourcetype, shape, template, lines, pattern, names)`` and ``literals``, the places and texts of open tokens that
    belong to the template. ``pattern`` has a group per field, ``names`` their names: the key in front of the
    value, else the class, numbered if it occurs again. Every line that was learned from has one template and fits its
    pattern. NULL and empty lines share a template without fields. NULL sourcetypes are a sourcetype.

    A shape that fewer than ``min_lines`` lines have gets a template too; its words then all count as text if they occur in one
    form only.
    """
    shaped = _with_shape(lines.select("sourcetype", raw), raw, max_tokens)
    nodes = cut(shaped.groupBy("sourcetype", "shape", "words").agg(F.count("*").alias("n")).withColumn("node", F.lit("")))
    done = None
    while True:
        splits = cut(_splits(nodes, max_branch, min_lines))
        if splits.isEmpty():
            break
        joined = _join(nodes, splits, "left")
        word = F.get("words", F.col("at"))
        step = F.concat("node", F.lit("/"), F.col("at").cast("string"), F.lit(":"), word)
        # Nodes that don't split are finished and leave the loop.
        rest = cut(joined.filter("at IS NULL").drop("at"))
        done = rest if done is None else done.unionByName(rest)
        nodes = cut(joined.filter("at IS NOT NULL").withColumn("node", step).drop("at"))
    nodes = nodes if done is None else done.unionByName(nodes)
    return _templates(nodes)


def _templates(nodes: DataFrame) -> DataFrame:
    lines = nodes.groupBy(*_NODE).agg(F.sum("n").alias("lines"))
    # Least and largest texts would sort a wide row per word; those of hashes are two numbers per place. Places that hold
    # one hash are counted by text then, which settles what hashes can't.
    each = nodes.select(*_NODE, F.posexplode("words").alias("place", "word"))
    hashed = each.select(*_NODE, "place", F.xxhash64("word").alias("h"))
    alike = hashed.groupBy(*_NODE, "place").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low = high")
    places = alike.groupBy(*_NODE).agg(F.collect_list("place").alias("places"))
    words = _join(nodes, places).select(*_NODE, F.explode("places").alias("place"), "words").withColumn(
        "word", F.get("words", F.col("place")))
    fixed = words.groupBy(*_NODE, "place", "word").agg(F.lit(1).alias("one")).groupBy(*_NODE, "place").agg(
        F.count("*").alias("texts"), F.min("word").alias("text"))
    fixed = fixed.filter("texts = 1").groupBy(*_NODE).agg(
        F.sort_array(F.collect_list(F.struct("place", "text"))).alias("literals"))
    none = F.array().cast("array<struct<place:int,text:string>>")
    both = _join(lines, fixed, "left").withColumn("literals", F.coalesce("literals", none))
    both = both.withColumn("parts", _parts(F.col("shape"), F.col("literals")))
    pattern = F.concat(F.lit(_FLAGS + r"\A"), F.array_join(F.transform("parts", lambda p: p["pattern"]), ""), F.lit(r"\z"))
    names = F.transform(F.filter("parts", lambda p: p["name"].isNotNull()), lambda p: p["name"])
    template = F.substring(F.sha2(F.concat_ws("\x00", F.col("shape"), F.transform("literals", lambda x: F.concat(
        x["place"].cast("string"), F.lit(":"), x["text"]))), 256), 1, 16)
    return both.select(
        "sourcetype", "shape", template.alias("template"), "lines", pattern.alias("pattern"),
        _numbered(names).alias("names"), "literals")


_SPECIAL = r"([\\.^$|?*+()\[\]{}\-&#~])"


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, _SPECIAL, r"\\$1")


def _parts(shape: Column, literals: Column) -> Column:
    """Per place of the shape its pattern, and for fields a name."""
    is_open = F.transform(shape, lambda c: c.isin(_OPEN_TAGS).cast("int"))
    text_at = F.map_from_entries(literals)

    def placed(flags: Column) -> Column:
        before = F.transform(flags, lambda f, i: F.aggregate(F.slice(flags, F.lit(1), i), F.lit(0), lambda a, x: a + x))
        texts = F.transform(shape, lambda c, i: F.when(F.get(flags, i) == 1, F.try_element_at(text_at, F.get(before, i))))
        return bind(texts, built)

    def built(texts: Column) -> Column:
        def key(i: Column) -> Column:
            """The text in front of ``=``, ``:`` or ``: ``."""
            sign = F.when(F.get(shape, i - 1).isin("=", ":"), i - 1).when(
                (F.get(shape, i - 1) == " ") & F.get(shape, i - 2).isin("=", ":"), i - 2)
            sign = F.when(F.get(shape, sign - 1) == " ", sign - 1).otherwise(sign)
            word = F.regexp_replace(F.get(texts, sign - 1), _FLAGS + r'^"|"$|[^\w]', "")
            return F.when(F.length(word) > 0, word)

        def part(c: Column, i: Column) -> Column:
            name = F.when(c.startswith("<") & (F.length(c) > 1) & F.get(texts, i).isNull(),
                          F.coalesce(key(i), F.substring(c, 2, F.length(c) - 2)))
            group = lookup(c, {
                **{f"<{k.name}>": f"{k.frame}({k.pattern}){k.frame}" for k in CLASSES}, f"<{REST}>": r"([\s\S]*)"})
            text = F.when(c == " ", F.lit(r"\s+")).otherwise(_escaped(F.coalesce(F.get(texts, i), c)))
            return F.struct(F.when(name.isNotNull(), group).otherwise(text).alias("pattern"), name.alias("name"))

        return F.transform(shape, part)

    return bind(is_open, placed)


def _numbered(names: Column) -> Column:
    """Names made distinct: the second of a name ends in ``_2``."""
    def one(every: Column) -> Column:
        def numbered(name: Column, i: Column) -> Column:
            earlier = F.size(F.filter(F.slice(every, F.lit(1), i), lambda n: n == name))
            return F.when(earlier > 0, F.concat(name, F.lit("_"), (earlier + 1).cast("string"))).otherwise(name)

        return F.transform(every, numbered)

    return bind(names, one)


# --- use --------------------------------------------------------------------------------------------------------

def read(lines: DataFrame, templates: DataFrame, raw: str = "raw", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``lines`` with ``template`` and ``fields``, a ``map<string,string>``; both NULL for a line that fits no template.

    Lines find the templates of their sourcetype and shape by an equi-join on hashes; a template fits if its texts stand
    in their places. Fields come straight from the tokens, so no pattern runs. Of several fitting templates that with
    most texts counts. ``max_tokens`` must be that of :func:`learn`.
    """
    hashed = F.xxhash64("sourcetype", F.array_join("shape", "\x00"))
    shaped = lines.select(F.struct("*").alias("line"), F.col("sourcetype"), F.col(raw).alias("raw"))
    shaped = _with_shape(shaped, "raw", max_tokens).withColumn("key", hashed)
    sides = templates.select(
        hashed.alias("_key"), F.col("sourcetype").alias("_sourcetype"),
        F.col("shape").alias("_shape"), F.struct(
            (-F.size("literals")).alias("order"), F.col("template").alias("template"), "literals", "names").alias("_t"))
    # All templates of one sourcetype and shape are one row: few, as a shape splits into a handful.
    sides = sides.groupBy("_key", "_sourcetype", "_shape").agg(F.sort_array(F.collect_list("_t")).alias("_ts"))
    joined = shaped.join(sides, (F.col("key") == F.col("_key")) & F.col("sourcetype").eqNullSafe(F.col("_sourcetype")) & (
        F.col("shape") == F.col("_shape")), "left")
    fitting = F.filter("_ts", lambda t: F.forall(t["literals"], lambda x: F.get("words", x["place"]) == x["text"]))
    joined = joined.withColumn("_t", F.get(fitting, 0))
    found = joined.select("line", F.col("_t.template").alias("template"), _values().alias("fields"))
    return found.select("line.*", "template", "fields")


def _values() -> Column:
    """The texts of the fields under their names."""
    is_open = F.transform("shape", lambda c: c.isin(_OPEN_TAGS).cast("int"))

    def fields(flags: Column) -> Column:
        texts = F.transform("tokens", lambda t, i: F.struct(
            t["class"].alias("class"), t["text"].alias("text"),
            F.when(F.get(flags, i) == 1, F.aggregate(F.slice(flags, F.lit(1), i), F.lit(0), lambda a, x: a + x)).alias("place")))
        fixed = F.transform(F.col("_t.literals"), lambda x: x["place"])
        variable = F.filter(texts, lambda t: t["class"].startswith("<") & (F.length(t["class"]) > 1) & ~F.coalesce(
            F.array_contains(fixed, t["place"]), F.lit(False)))
        bare = F.transform(variable, lambda t: F.when(
            t["class"] == "<quoted>", F.substring(t["text"], F.lit(2), F.length(t["text"]) - 2)).otherwise(t["text"]))
        return F.map_from_arrays(F.col("_t.names"), bare)

    return F.when(F.col("_t").isNotNull(), bind(is_open, fields))


def extractions(templates: DataFrame, least: int = MIN_LINES, most: int = 50) -> dict[str | None, list[Extraction]]:
    """Patterns per sourcetype on the driver, for a specification: those of ``least`` lines, the ``most`` frequent."""
    rank = F.row_number().over(Window.partitionBy("sourcetype").orderBy(F.col("lines").desc(), "template"))
    rows = templates.filter(F.col("lines") >= least).withColumn("rank", rank).filter(F.col("rank") <= most)
    out: dict[str | None, list[Extraction]] = {}
    for r in rows.orderBy("sourcetype", "rank").collect():
        out.setdefault(r["sourcetype"], []).append(Extraction(r["pattern"], tuple(r["names"])))
    return out


def extract_any(raw: Column, found: list[Extraction]) -> Column:
    """A map of the fields that the first fitting pattern reads, NULL if none fits."""
    def one(extraction: Extraction) -> Column:
        pairs = [F.struct(F.lit(n).alias("key"), F.regexp_extract(raw, extraction.pattern, i).alias("value"))
                 for i, n in enumerate(extraction.names, 1)]
        return F.map_from_entries(F.array(*pairs)) if pairs else F.expr("CAST(map() AS map<string,string>)")

    if not found:
        return F.lit(None).cast("map<string,string>")
    return F.coalesce(*[F.when(raw.rlike(e.pattern), one(e)) for e in found])
