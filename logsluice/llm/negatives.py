"""Hard negatives: for an anchor and one of its nearest rows of the same label, the nearest rows of other labels below it.

The anchors are a query set that meets all rows, in blocks. Spark deals the anchors out by label and direction, cuts
them into blocks of bounded size and joins the anchors of each block by a minimum spanning tree over their
distances. One block at a time goes to all tasks. A task walks down the tree: with the score ``s`` of a row at an anchor's
parent, the edge's length ``d`` and the row's norm ``n``, the row's score at the anchor lies between ``s - d n`` and
``s + d n``. Only rows whose bounds overlap the window that the anchor still asks for are scored anew; the others
hand their widened bounds on to the anchor's children. Scores are exact integers, so bounds only save work.

Two passes are made: the first finds each anchor's positives, the best rows of its label. These give the windows of the
second, which finds each pair's negatives. In both, a task keeps the best few per anchor, and Spark takes the best of
these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from logsluice.llm.common import cut

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
# A negative's score in percent of the positive's: at least and at most.
LOW, HIGH = 50, 95
# Numbers in the anchors of a block, and rows that a task scores at a time.
BLOCK_NUMBERS = 1 << 20
BLOCK_ROWS = 2048
CHUNK_ROWS = 8192
# Integer arithmetic on doubles is exact below this.
_EXACT = float(1 << 53)

_NODE = "block long, node long, parent long, edge double, anchor long, vec_id long, label long, v array<double>"
_HIT = pa.schema([
    ("anchor", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int64()), ("id", pa.int64()), ("row", pa.int64()),
    ("score", pa.int64())])
HIT = "anchor long, anchor_id long, place long, id long, row long, score long"


# --- rows ---------------------------------------------------------------------------------------------------

def usable(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """``(row, vec_id, label, v)``: rows with a label and a vector of finite numbers, scaled and rounded down.

    ``row`` tells rows apart that share an id.
    """
    vector = F.col(vector_col).cast("array<double>")
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.alias("v"))
    # abs(x) < infinity is false for NaN, which Spark orders above all numbers.
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    whole = whole.filter(F.col("label").isNotNull() & F.col("v").isNotNull()).filter(finite)
    scaled = F.transform("v", lambda x: F.floor(x * SCALE).cast("double"))
    return whole.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", scaled.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; what a shorter one lacks is zero."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    at = 0
    for i, n in enumerate(sizes):
        out[i, :min(n, width)] = flat[at:at + min(n, width)]
        at += n
    return out


# --- anchors ---------------------------------------------------------------------------------------------

def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order in which to visit, parent of each visited node (a place in the order, -1 for the root), edge lengths.

    Prim's tree, visited in depth, at each node the smallest subtree first: then few nodes wait for a child at any time.
    """
    n = len(points)
    norms = (points * points).sum(axis=1)
    near, parent = np.full(n, np.inf), np.full(n, -1)
    done, children = np.zeros(n, bool), [[] for _ in range(n)]
    joined, at = [], 0
    while True:
        done[at] = True
        joined.append(at)
        if len(joined) == n:
            break
        distance = norms + norms[at] - 2 * (points @ points[at])
        closer = ~done & (distance < near)
        near[closer], parent[closer] = distance[closer], at
        at = int(np.argmin(np.where(done, np.inf, near)))
        children[parent[at]].append(at)
    size = np.ones(n, np.int64)
    for i in reversed(joined):
        if parent[i] >= 0:
            size[parent[i]] += size[i]
    order, place, stack = [], np.full(n, -1), [0]
    while stack:
        i = stack.pop()
        place[i] = len(order)
        order.append(i)
        stack.extend(sorted(children[i], key=lambda c: -size[c]))
    order = np.array(order)
    up = np.where(parent[order] >= 0, place[parent[order]], -1)
    edge = np.where(parent[order] >= 0, np.sqrt(((points[order] - points[parent[order]]) ** 2).sum(axis=1)), 0)
    return order, up, edge


def _trees(batches: Iterator[pa.RecordBatch], block_rows: int, block_numbers: int) -> Iterator[pa.RecordBatch]:
    base, held = TaskContext.get().partitionId() << 32, []

    def block(rows: pa.Table, number: int) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        vectors = rows.column("v").combine_chunks()
        width = max(1, int(np.diff(vectors.offsets.to_numpy()).max()))
        order, up, edge = spanning_tree(_matrix(vectors, width))
        moved = rows.take(pa.array(order))
        n = len(order)
        return pa.RecordBatch.from_arrays([
            pa.array([base + number] * n, pa.int64()), pa.array(np.arange(n)), pa.array(up.astype(np.int64)), pa.array(edge),
            *(moved.column(c).combine_chunks() for c in ("row", "vec_id", "label", "v"))],
            ["block", "node", "parent", "edge", "anchor", "vec_id", "label", "v"])

    number = rows = numbers = 0
    for batch in batches:
        sizes = np.diff(batch.column("v").offsets.to_numpy())
        at = 0
        for i, size in enumerate(sizes):
            if rows and (rows == block_rows or numbers + size > block_numbers):
                held.append(batch.slice(at, i - at))
                yield block(pa.Table.from_batches(held), number)
                number, rows, numbers, held, at = number + 1, 0, 0, [], i
            rows, numbers = rows + 1, numbers + size
        held.append(batch.slice(at))
    if rows:
        yield block(pa.Table.from_batches(held), number)


def anchor_blocks(anchors: DataFrame, block_rows: int = BLOCK_ROWS, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """Anchors in blocks, each a spanning tree in the order of its nodes.

    Rows of one label whose first components have equal signs lie beside each other, so that a block's edges are short.
    A block has at most ``block_rows`` anchors and about ``block_numbers`` numbers.
    """
    signs = F.transform(F.slice("v", 1, 16), lambda x: x >= 0)
    near = anchors.withColumn("signs", F.array_join(signs.cast("array<int>"), ""))
    # As few tasks as there are blocks; neighbouring ranges go together.
    tasks = 1 + 2 * anchors.count() // block_rows
    near = near.repartitionByRange(tasks, "label", "signs", "row").coalesce(tasks)
    near = near.sortWithinPartitions("label", "signs", "row").select("row", "vec_id", "label", "v")
    return cut(near.mapInArrow(partial(_trees, block_rows=block_rows, block_numbers=block_numbers), _NODE))


@dataclass
class Block:
    """One block of anchors in the order of its tree, and the windows each anchor asks for.

    ``want`` has, per anchor, ``(place, low, high)``: the best rows with scores from ``low`` to ``high`` are asked for.
    """

    v: np.ndarray
    up: np.ndarray
    edge: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    vec_id: list[int | None]
    label: np.ndarray
    want: list[list[tuple[int, float, float]]]

    @classmethod
    def of(cls, rows: list, want: Callable) -> Block:
        width = max(1, max(len(r["v"]) for r in rows))
        v = np.zeros((len(rows), width))
        for i, r in enumerate(rows):
            v[i, :len(r["v"])] = r["v"]
        up = np.array([r["parent"] for r in rows])
        last = np.arange(len(rows))
        for i, p in enumerate(up):
            if p >= 0:
                last[p] = i  # a node's scores are given up after its last child
        return cls(v, up, np.array([r["edge"] for r in rows]), last, np.array([r["anchor"] for r in rows]),
                   [r["vec_id"] for r in rows], np.array([r["label"] for r in rows]), [want(r) for r in rows])


# --- the walk over one block ----------------------------------------------------------------------------------

class Best:
    """The best ``count`` rows of each window of each anchor: score down, then id up, a missing id last."""

    def __init__(self, block: Block, count: int):
        self.block, self.count = block, count
        self.kept = [[(np.zeros(0, np.int64),) * 4] * len(w) for w in block.want]
        self.least = [np.array([low for _, low, _ in w]) for w in block.want]

    def add(self, node: int, score: np.ndarray, ids: np.ndarray, null: np.ndarray, rows: np.ndarray) -> None:
        for i, (_, low, high) in enumerate(self.block.want[node]):
            take = (score >= self.least[node][i]) & (score <= high)
            if not take.any():
                continue
            new = score[take].astype(np.int64), ids[take], null[take].astype(np.int64), rows[take]
            both = [np.concatenate(c) for c in zip(self.kept[node][i], new)]
            order = np.lexsort((both[3], both[1], both[2], -both[0]))[:self.count]
            self.kept[node][i] = tuple(c[order] for c in both)
            if len(order) == self.count:
                self.least[node][i] = max(low, float(both[0][order[-1]]))

    def batches(self) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in _HIT]
        for node, windows in enumerate(self.kept):
            for (place, _, _), (score, ids, null, rows) in zip(self.block.want[node], windows):
                for s, i, m, r in zip(score.tolist(), ids.tolist(), null.tolist(), rows.tolist()):
                    for c, x in zip(columns, (int(self.block.anchor[node]), self.block.vec_id[node], place, None if m else i, r, s)):
                        c.append(x)
        if columns[0]:
            yield pa.RecordBatch.from_pydict(dict(zip(_HIT.names, columns)), schema=_HIT)


def walk(block: Block, best: Best, v: np.ndarray, label: np.ndarray, ids: np.ndarray, null: np.ndarray, rows: np.ndarray,
         same: bool) -> int:
    """Meet one chunk of rows with all anchors of the block; returns how many scores were computed."""
    norm = np.sqrt((v * v).sum(axis=1))
    bound = float(np.abs(block.v).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, v.shape[1])
    if not bound < _EXACT:
        raise ValueError("scores of such large vectors aren't exact")
    live: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    computed = 0
    for node in range(len(block.up)):
        up = block.up[node]
        if up < 0:
            lo, hi = np.full(len(v), -np.inf), np.full(len(v), np.inf)
        else:
            # The margin is far above the rounding of lengths and norms.
            reach = norm * (block.edge[node] * (1 + 1e-9)) + 1e-3
            lo, hi = live[up][0] - reach, live[up][1] + reach
            if block.last[up] == node:
                del live[up]
        want = block.want[node]
        if want:
            floor = best.least[node].min()
            need = (hi >= floor) & (lo <= max(high for _, _, high in want))
            need &= (label == block.label[node]) if same else (label != block.label[node])
            if same:
                need &= rows != block.anchor[node]
            at = np.flatnonzero(need)
            if len(at):
                part = v[at] if 2 * len(at) < len(v) else v
                score = part @ block.v[node]
                if part is v:
                    lo = hi = score  # the product was cheaper than a choice of rows: all scores are known
                    score = score[at]
                else:
                    lo[at] = hi[at] = score
                computed += len(part)
                best.add(node, score, ids[at], null[at], rows[at])
        if block.last[node] != node:
            live[node] = (lo, hi)
    return computed


def _search(batches: Iterator[pa.RecordBatch], block, count: int, same: bool, chunk_rows: int) -> Iterator[pa.RecordBatch]:
    block = block.value
    best, width = Best(block, count), block.v.shape[1]
    chunk_rows = max(1, min(chunk_rows, BLOCK_NUMBERS // width))
    for batch in batches:
        for at in range(0, batch.num_rows, chunk_rows):
            part = batch.slice(at, chunk_rows)
            ids = part.column("vec_id")
            walk(block, best, _matrix(part.column("v"), width), part.column("label").to_numpy(), ids.fill_null(0).to_numpy(),
                 ids.is_null().to_numpy(zero_copy_only=False), part.column("row").to_numpy(), same)
    yield from best.batches()


def best_rows(
    rows: DataFrame, blocks: DataFrame, want: Callable, count: int, same: bool, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``(anchor, anchor_id, place, id, row, score)``: the best ``count`` rows of each window, best of all tasks.

    A block is read to the driver, which hands it to all tasks and forgets it; its size is bounded. Each task's rows
    are written to the shared folder before the next block.
    """
    spark = rows.sparkSession
    found = None
    for number in [r["block"] for r in blocks.select("block").distinct().orderBy("block").toLocalIterator()]:
        nodes = blocks.filter(F.col("block") == number).orderBy("node").collect()
        held = spark.sparkContext.broadcast(Block.of(nodes, want))
        part = rows.mapInArrow(partial(_search, block=held, count=count, same=same, chunk_rows=chunk_rows), HIT)
        order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
        part = cut(part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count))
        held.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], HIT + ", rank int")
    return found


# --- the operator -------------------------------------------------------------------------------------------

def mine(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
    anchors: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    block_rows: int = BLOCK_ROWS, block_numbers: int = BLOCK_NUMBERS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Scores are inner products of the vectors times ``SCALE``, rounded down. ``label`` is the column ``label`` if not given,
    ``anchors`` chooses the anchors by ``vec_id``, by default every id divisible by 50. An anchor's positives are its best
    ``positives`` other rows of its label; for each, the best ``negatives`` rows of other labels count whose score is
    ``low`` to ``high`` percent of the positive's. Higher scores come first, ties by smaller id, then NULL ids.

    Rows with a NULL label, a NULL vector or any NULL, NaN or infinite component take no part. A NULL id is never an anchor. Rows that
    share an id are rows of their own, as anchors too. A positive with a negative score has no negatives, as the
    window is empty. A vector that is shorter than an anchor counts as if it went on with zeros, of a longer one the rest
    meets zeros; an empty one scores 0. Scores must be below 2 ** 53, else the job fails. An empty table gives no rows.
    Other columns are not read.
    """
    label = F.col("label") if label is None else label
    rows = cut(usable(vectors, id_col, vector_col, label))
    chosen = (F.col("vec_id") % 50 == 0) if anchors is None else anchors
    blocks = anchor_blocks(rows.filter(chosen), block_rows, block_numbers)
    nearest = best_rows(rows, blocks, _all_scores, positives, True, chunk_rows)
    nearest = cut(nearest.select(
        "anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = nearest.groupBy("anchor").agg(F.collect_list(F.struct("place", "positive_score")).alias("found"))
    asked = cut(blocks.join(windows, "anchor", "left"))
    hard = best_rows(rows, asked, partial(_windows, low=low, high=high), negatives, False, chunk_rows)
    return nearest.join(hard.withColumnRenamed("id", "negative_id"), ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))


def _all_scores(_) -> list[tuple[int, float, float]]:
    return [(0, -np.inf, np.inf)]


def _windows(row, low: int, high: int) -> list[tuple[int, float, float]]:
    """Windows of whole scores: 100 times a score lies between ``low`` and ``high`` times the positive's."""
    out = []
    for found in row["found"] or []:
        score = found["positive_score"]
        first, last = -(-low * score // 100), high * score // 100
        if first <= last:
            out.append((found["place"], float(first), float(last)))
    return out
