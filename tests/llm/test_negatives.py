"""Hard negatives against a plain search over all pairs, and the bounds of the walk."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsluice.llm import negatives as N

ROWS = "vec_id long, embedding array<float>, label int"


def expected(rows, positives=5, negatives=3, low=50, high=95):
    good = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v], label))

    def rank(items):
        return sorted(items, key=lambda x: (-x[0], x[1] is None, x[1] or 0))

    out = []
    for i, (a, v, label) in enumerate(good):
        if a is None or a % 50:
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), b, other) for j, (b, w, other) in enumerate(good) if j != i]
        for ps, p, _ in rank(s for s in scores if s[2] == label)[:positives]:
            fit = rank(s for s in scores if s[2] != label and low * ps <= 100 * s[0] <= high * ps)
            for place, (ns, n, _) in enumerate(fit[:negatives], 1):
                out.append((a, p, place, n, ps, ns))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
                   for r in frame.collect()), key=str)


def table(n=400, width=12, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, width))
    out = []
    for i in range(n):
        label = int(rng.integers(4))
        v = centers[label if rng.random() < 0.8 else int(rng.integers(4))] + rng.normal(size=width) * 0.4
        out.append((5 * i, v.astype(np.float32).tolist(), label))
    return out


ODD = [
    (50, None, 1), (100, [1.0, None], 1), (150, [float("nan")] * 12, 2), (200, [float("inf")] * 12, 2), (250, [0.5] * 12, None),
    (None, [0.5] * 12, 1), (None, [0.5] * 12, 2), (300, [], 1), (350, [1.0, 2.0], 1), (400, [0.25] * 20, 0), (-50, [0.5] * 12, 1)]


@pytest.mark.parametrize("block,chunk", [(N.BLOCK_ROWS, N.CHUNK_ROWS), (7, 13)])
def test_against_all_pairs(spark, block, chunk):
    rows = table() + ODD
    frame = spark.createDataFrame(rows, ROWS).repartition(3)
    for name in ("row", "anchor", "place", "score", "v", "block", "found", "rank"):
        frame = frame.withColumn(name, F.lit("clash"))
    got = rows_of(N.mine(frame, block_rows=block, chunk_rows=chunk))
    assert got == expected(rows) and len(got) > 300


def test_ties_repeated_rows_and_one_common_vector(spark):
    rows = table(80, seed=2)
    rows += [(1000 + i, [0.5] * 12, i % 3) for i in range(300)] + rows[:30]
    assert rows_of(N.mine(spark.createDataFrame(rows, ROWS), block_rows=9, chunk_rows=50)) == expected(rows)


def test_other_windows(spark):
    rows = table(150, seed=3)
    frame = spark.createDataFrame(rows, ROWS)
    got = N.mine(frame, positives=2, negatives=4, low=10, high=100, anchors=F.col("vec_id") % 25 == 0, label=F.col("label"))
    every = {r[0] for r in rows_of(got)}
    assert every == {r[0] for r in rows if r[0] % 25 == 0}
    assert [r for r in rows_of(got) if r[0] % 50 == 0] == expected(rows, 2, 4, 10, 100)


def test_empty_tables(spark):
    frame = spark.createDataFrame([], ROWS)
    assert N.mine(frame).collect() == []
    lone = spark.createDataFrame([(50, [1.0], 1), (51, [1.0], None), (3, [1.0], 2)], ROWS)
    assert N.mine(lone).collect() == []


def test_scores_that_are_not_exact_fail(spark):
    frame = spark.createDataFrame([(50, [1e9] * 4, 1), (51, [1e9] * 4, 1)], ROWS)
    with pytest.raises(Exception, match="exact"):
        N.mine(frame).collect()


def test_spanning_tree():
    rng = np.random.default_rng(4)
    for n in (1, 2, 30):
        points = rng.integers(-50, 50, (n, 5)).astype(float)
        order, up, edge = N.spanning_tree(points)
        assert sorted(order.tolist()) == list(range(n)) and up[0] == -1 and all(up[i] < i for i in range(1, n))
        distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
        assert np.allclose(edge[1:], [distance[order[i], order[up[i]]] for i in range(1, n)])
        inside, total = {0}, 0.0
        while len(inside) < n:  # the plain way
            d, j = min((distance[i, j], j) for i in inside for j in range(n) if j not in inside)
            inside.add(j)
            total += d
        assert edge.sum() == pytest.approx(total)
    chain = np.arange(500.0)[:, None]
    order, up, _ = N.spanning_tree(chain)
    waiting = {i for i in range(500) if (up == i).sum() > 1}
    assert len(waiting) <= 1


def test_bounds_save_scores():
    """Anchors that lie close together: rows far from their windows are not scored again."""
    rng = np.random.default_rng(5)
    near = np.round(rng.normal(size=16) * 100)
    anchors = near + rng.integers(-2, 3, (50, 16))
    v = np.concatenate([near + rng.integers(-30, 31, (40, 16)), np.round(rng.normal(size=(2000, 16)) * 100)])
    order, up, edge = N.spanning_tree(anchors)
    rows = [dict(v=anchors[o], parent=int(u), edge=float(e), anchor=10 ** 6 + i, vec_id=i, label=0)
            for i, (o, u, e) in enumerate(zip(order, up, edge))]
    block = N.Block.of(rows, N._all_scores)
    best = N.Best(block, 5)
    ids, labels = np.arange(len(v)), np.zeros(len(v), np.int64)
    computed = sum(N.walk(block, best, v[at:at + 500], labels[at:at + 500], ids[at:at + 500], np.zeros(len(v[at:at + 500]), bool),
                          ids[at:at + 500], True) for at in range(0, len(v), 500))
    assert computed < 0.5 * len(v) * len(anchors)
    for node in range(len(anchors)):
        exact = v @ block.v[node]
        assert best.kept[node][0][0].tolist() == sorted(exact.astype(int).tolist(), reverse=True)[:5]
