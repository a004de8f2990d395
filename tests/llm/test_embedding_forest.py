"""Operator 11 against all pairs, and its defined cases."""

import numpy as np
import pytest

from phylomill.llm import embedding_forest as ef


def brute(rows, threshold=ef.THRESHOLD):
    """(vec_id, n_links, component_id, kept) in the order of the rows; vec_ids are distinct or rows are copies."""
    ok = [i is not None and c is not None and v is not None and len(v) > 0 and None not in v and all(np.isfinite(v)) and any(v) for i, v, c in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    groups = {}
    for k, (i, v, c) in enumerate(rows):
        if ok[k]:
            groups.setdefault((c, len(v)), []).append(k)
    for at in groups.values():
        u = ef.unit(np.array([rows[k][1] for k in at], float))
        for x, y in zip(*np.nonzero(np.triu(u @ u.T >= threshold, 1))):
            a, b = at[x], at[y]
            links[a] += 1
            links[b] += 1
            p, q = sorted((find(a), find(b)), key=lambda k: rows[k][0])
            root[q] = p
    return [(r[0], links[k], rows[find(k)][0], r[0] == rows[find(k)][0]) for k, r in enumerate(rows)]


def near(rng, centre, n, noise):
    x = centre + noise * rng.standard_normal((n, len(centre))) / np.sqrt(len(centre))
    return x / np.linalg.norm(x, axis=1)[:, None]


def planted(seed, plain, groups, dim=32):
    rng = np.random.default_rng(seed)
    centre = lambda: rng.standard_normal(dim) / np.sqrt(dim)
    x = [rng.standard_normal((plain, dim))] + [near(rng, centre(), n, noise) for n, noise in groups]
    label = np.concatenate([rng.integers(0, 3, plain)] + [np.full(n, k % 3) for k, (n, _) in enumerate(groups)])
    x = np.concatenate(x).astype(np.float32).astype(float)
    order = rng.permutation(len(x))
    return [(int(i), x[k].tolist(), int(label[k])) for i, k in enumerate(order)]


def compared(spark, rows, **bounds):
    df = spark.createDataFrame([(*r, "n") for r in rows], "vec_id long, embedding array<double>, label int, node string").repartition(4)
    got = sorted(map(tuple, ef.components(df, **bounds).collect()), key=str)
    return got, sorted(brute(rows), key=str)


def test_equals_all_pairs_where_nothing_is_split(spark):
    rows = planted(1, 300, [(20, 0.2), (5, 0.3), (40, 0.25)])
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 32, 1), (1003, [float("nan")] * 32, 1), (1004, [None] + [1.0] * 31, 1), (1005, [float("inf")] + [1.0] * 31, 1)]
    rows += [(1006, rows[0][1], None), (None, rows[0][1], 1), (1007, rows[0][1][:5], 1), (1008, rows[0][1][:5], 1), (1009, (np.array(rows[0][1]) * 1e300).tolist(), rows[0][2])]
    rows += [(1010, (np.array(rows[0][1]) * 1e-300).tolist(), rows[0][2]), (1011, rows[0][1], (rows[0][2] + 1) % 3), rows[7], rows[7], (1012, rows[7][1], rows[7][2])]
    got, want = compared(spark, rows)
    assert got == want


@pytest.mark.parametrize("bounds", [{"leaf": 64, "most": 256, "sample_bytes": 400_000}, {"leaf": 40, "most": 80, "sample_bytes": 60_000}])
def test_recall_and_no_false_links_where_cells_are_small(spark, bounds):
    """A hot ball, shells, small groups and trees of cells' own, with leaves a tenth or less of a label."""
    rows = planted(2, 1500, [(600, 0.1), (300, 0.25)] + [(6, 0.2)] * 60)
    got, want = compared(spark, rows, **bounds)
    a, b = {r[0]: r for r in got}, {r[0]: r for r in want}
    assert a.keys() == b.keys() and all(a[i][1] <= b[i][1] for i in a)
    recall = sum(r[1] for r in got) / sum(r[1] for r in want)
    small = [i for i in b if 0 < b[i][1] < 100]
    assert recall >= 0.98 and sum(a[i][1] for i in small) >= 0.95 * sum(b[i][1] for i in small)
    assert sum(a[i][2] == b[i][2] for i in a) >= 0.99 * len(a)


def test_balls_hold_linked_vectors_only():
    rng = np.random.default_rng(3)
    x = ef.unit(np.concatenate([near(rng, rng.standard_normal(32) / 6, 300, 0.15), rng.standard_normal((300, 32))]))
    found = ef.balls(x, np.zeros(len(x), np.int64), 1.0, 100)
    assert len(found) == 1
    inside = x[x @ found[0][1] >= ef.half_angle(ef.THRESHOLD)]
    assert len(inside) > 200 and (inside @ inside.T).min() >= ef.THRESHOLD


def test_tight_cells_go_through_blocks(spark):
    """A group too small for a ball, in cells over ``most``: all of its links are found."""
    rows = planted(4, 200, [(90, 0.3), (90, 0.28)])
    got, want = compared(spark, rows, leaf=4000, most=50)
    assert got == want


def test_empty_table(spark):
    assert ef.components(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
