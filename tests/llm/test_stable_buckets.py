import math
import random

import numpy as np
import pytest

from chartloom.llm import stable_buckets as op

SHAPE = "vec_id long, embedding array<double>, label int, bucket int, id int, a int, b int, vec int, ball int, root int, weight int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3, 4, 5, 6, 7, 8) for i, v in rows], SHAPE).repartition(3)


def brute(rows, cosine=op.COSINE):
    """Compare all rows with all rows."""
    good = [bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    root, count = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    pairs = set()
    for dim in {len(v) for (_, v), g in zip(rows, good, strict=True) if g}:
        at = [i for i, ((_, v), g) in enumerate(zip(rows, good, strict=True)) if g and len(v) == dim]
        x = np.array([rows[i][1] for i in at])
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= cosine
        for i, j in np.argwhere(near):
            if i != j:
                count[at[i]] += 1
                root[find(at[i])] = find(at[j])
                pairs.add((at[i], at[j]))
    names = {}
    for i, (v, _) in enumerate(rows):
        names.setdefault(find(i), []).append(v)
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in names.items()}
    return sorted([(v, count[i], smallest[find(i)], v == smallest[find(i)]) for i, (v, _) in enumerate(rows)], key=str)


def around(rng, centre, angle):
    """A unit vector at an angle to a unit vector."""
    side = rng.normal(size=len(centre))
    side -= side @ centre * centre
    return (math.cos(angle) * centre + math.sin(angle) * side / np.linalg.norm(side)).tolist()


def centre(rng, dim=32):
    v = rng.normal(size=dim)
    return v / np.linalg.norm(v)


def made(seed):
    rng, rows = np.random.default_rng(seed), []
    for size, angle in ((60, 0.1), (25, 0.12), (5, 0.1), (2, 0.05)):
        c = centre(rng)
        rows += [around(rng, c, rng.uniform(0, angle)) for _ in range(size)]
    rows += [(centre(rng) * 3).tolist() for _ in range(300)]
    rows += [rows[0]] * 40 + [rows[90]] * 3 + [[2 * x for x in rows[61]]]
    ids = random.Random(seed).sample(range(10_000), len(rows))
    rows = list(zip(ids, rows, strict=True))
    rows += [(None, rows[70][1]), (None, rows[200][1]), (20_000, None), (20_001, []), (20_002, [0.0] * 32), (20_003, [math.nan] * 32)]
    rows += [(20_004, [None] * 32), (20_005, [1e200] * 32), (20_006, [1e200] * 32), (20_007, [1e-200] * 8), (rows[3][0], rows[3][1])]
    return rows


@pytest.mark.parametrize("crowded, together", [(10**9, 4096), (8, 4096), (8, 16)])
def test_matches_brute_force(spark, crowded, together):
    rows = made(1)
    got = op.near_vectors(table(spark, rows), crowded=crowded, together=together)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_balls_and_vectors_that_link_in_part(spark):
    """Vectors at the rim of a ball link with some members only; two balls may, too."""
    rng = np.random.default_rng(3)
    c = centre(rng, 16)
    other = np.array(around(rng, c, 0.42))
    rows = [around(rng, c, rng.uniform(0, 0.15)) for _ in range(60)] + [around(rng, other, rng.uniform(0, 0.1)) for _ in range(40)]
    rows += [around(rng, c, 0.4) for _ in range(6)]
    rows = list(enumerate(rows, 10))
    exact = {r[0]: r for r in brute(rows)}
    counts = []
    for crowded in (10**9, 8):
        # Pairs at the threshold itself may be missed; the rate is checked below.
        got = {r.vec_id: r for r in op.near_vectors(table(spark, rows), crowded=crowded).collect()}
        assert all(got[i].n_links <= exact[i][1] for i in got)
        counts.append(sum(r.n_links for r in got.values()) / sum(r[1] for r in exact.values()))
    assert min(counts) > 0.99


def test_pairs_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(1500):
        c = centre(rng, 48)
        rows += [(2 * k, c.tolist()), (2 * k + 1, around(rng, c, math.acos(0.9) - 1e-6 if k % 2 else math.acos(0.9) + 1e-6))]
    got = {r.vec_id: r for r in op.near_vectors(table(spark, rows)).collect()}
    assert len(got) == 3000
    assert sum(got[2 * k].n_links for k in range(0, 1500, 2)) == 0
    assert sum(got[2 * k].n_links for k in range(1, 1500, 2)) >= 0.99 * 750


def test_empty_tables(spark):
    assert op.near_vectors(table(spark, [])).count() == 0
    assert list(map(tuple, op.near_vectors(table(spark, [(1, None)])).collect())) == [(1, 0, 1, True)]


def test_plan_follows_the_number_of_vectors():
    for count in (10, 10_000, 10**9):
        k, tables = op.plan_of(count)
        assert (1 - op.agreement(math.sqrt(0.2)) ** k) ** tables <= op.MISS
        assert count * op.agreement(math.sqrt(2)) ** k <= 2 * op.OCCUPANCY
    assert abs(op.agreement(math.sqrt(0.2)) - 0.8216) < 1e-3
