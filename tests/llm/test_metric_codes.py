import hashlib
import math
import random

import numpy as np
import pytest

from chartloom.llm import metric_codes as op

SHAPE = "vec_id long, embedding array<float>, label int, trees int, code int, error int, ids int, of int"


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd rounds over Python integers."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    points = [[math.floor(4096 * float(np.float32(x))) for x in r[1]] for r in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, points[i]))[:entries]
    width = len(points[0]) // parts
    books = [[points[i][p * width : (p + 1) * width] for i in first] for p in range(parts)]

    def near(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            groups = [[] for _ in books[p]]
            for v in points:
                own = v[p * width : (p + 1) * width]
                groups[near(own, books[p])[0]].append(own)
            books[p] = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else e for g, e in zip(groups, books[p], strict=True)]
    out = []
    for r, v in zip(kept, points, strict=True):
        found = [near(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{i:02x}" for i, _ in found), sum(d for _, d in found), r[2]))
    by_label = {}
    for _, _, error, label in out:
        by_label[label] = by_label.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, c, e, by_label[label], sha) for i, c, e, label in out], key=str)


def answer(spark, rows, tmp_path):
    full = [(*r, 1, 2, 3, 4, 5) for r in rows]
    spark.createDataFrame(full, SHAPE).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(map(tuple, op.op13_metric_codes(spark, str(tmp_path)).collect()), key=str)


def made(count, dim, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(7)]
    return [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], rng.choice([1, 2, None])) for i in rng.sample(range(10 * count), count)]


def test_matches_plain_rounds(spark, tmp_path):
    rows = made(400, 16, 1)
    rows += [(None, rows[0][1], 1), (5000, rows[1][1], None), (rows[2][0], rows[3][1], 2), rows[4], rows[4]]
    rows += [(9000 + i, rows[5][1], 1) for i in range(300)]
    rows += [(-1, None, 1), (-2, [], 1), (-3, [float("nan")] * 16, 1), (-4, [None] * 16, 1), (-5, [float("inf")] * 16, None)]
    assert answer(spark, rows, tmp_path) == brute(rows)


def test_ties_go_to_the_lower_entry(spark, tmp_path):
    rng = random.Random(2)
    grid = [(i, [rng.choice([-1, 0, 1]) / 4096 for _ in range(8)], i % 2) for i in range(500)]
    assert answer(spark, grid, tmp_path) == brute(grid)


def test_fewer_rows_than_entries_and_none(spark, tmp_path):
    rows = made(5, 8, 3)
    assert answer(spark, rows, tmp_path) == brute(rows)
    assert answer(spark, [], tmp_path) == []
    assert answer(spark, [(1, None, 1)], tmp_path) == []


def test_a_tree_covers_every_point_once_and_caches_its_sums():
    rng = np.random.default_rng(4)
    for points in (rng.integers(-500, 500, (3000, 8)), np.repeat(rng.integers(-9, 9, (40, 8)), 60, axis=0), np.zeros((100, 8), np.int64)):
        tree = op.grow(points)
        assert sorted(tree.order.tolist()) == list(range(len(points)))
        for ball in range(len(tree.start)):
            own = points[tree.order[tree.start[ball] : tree.stop[ball]]]
            assert (own.sum(0) == tree.total[ball]).all()
            assert np.sqrt(((own - tree.centre[ball]) ** 2).sum(1)).max() <= tree.radius[ball] + 1e-9
            below = np.flatnonzero(tree.parent == ball)
            assert tree.leaf[ball] == (not len(below))
            if len(below):
                assert sum(tree.stop[below] - tree.start[below]) == tree.stop[ball] - tree.start[ball]


def test_balls_are_owned_before_their_points_are_read():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (16, 8))
    points = centres[rng.integers(0, 16, 2000)] + rng.integers(-40, 40, (2000, 8))
    tree = op.grow(points)
    (balls, _), (opened, _) = op.descend(tree, points, centres)
    far = ((points[:, None] - centres[None]) ** 2).sum(2)
    assert (op.nearest(tree, points, centres) == far.argmin(1)).all()
    assert len(opened) < 100 and len(balls) < 200


def test_unequal_lengths_are_refused(spark):
    for rows in ([(1, [0.5] * 12, 1)], [(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)]):
        with pytest.raises(Exception, match="length"):
            op.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), entries=1)
