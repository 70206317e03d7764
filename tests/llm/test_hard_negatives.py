import numpy as np
import pytest

from larkspur.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x int"


def brute_force(rows):
    """The contract row by row: rows are (vec_id, vector, label)."""
    kept = []
    for i, v, y in rows:
        if v is not None and y is not None and i is not None and all(c is not None and np.isfinite(c) for c in v):
            kept.append((i, (y + 1) % 10 if i % 7 == 0 else y, [int(np.floor(256 * float(np.float32(c)))) for c in v]))
    out = []
    for i, y, x in kept:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, v)), j, z) for j, z, v in kept if j != i)
        for p, j, _ in [s for s in scored if s[2] == y][:5]:
            fit = [s for s in scored if s[2] != y and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k, _) in enumerate(fit[:3])]
    return sorted(out)


def made(spark, rows):
    df = spark.createDataFrame([(i, v, y, "clash", 1) for i, v, y in rows], SCHEMA)
    return sorted(map(tuple, H.digest(df).collect()))


def clustered(n, d=8, seed=0, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    return [(int(i), (centres[i % 12] + 0.3 * rng.normal(size=d)).tolist(), int(rng.integers(labels))) for i in range(n)]


def test_matches_brute_force(spark):
    rows = clustered(900)
    rows += [(1000 + i, rows[3][1], 2) for i in range(150)]  # ties beyond number
    rows += [(2000, None, 1), (2050, rows[1][1], None), (2051, [float("nan")] * 8, 1), (2100, [None] + [0.5] * 7, 1), (2101, [1.0], 1), (None, rows[2][1], 1), (2150, [0.0] * 8, 3), (2200, [-4.0] * 8, 9)]
    assert made(spark, rows) == brute_force([r for r in rows if r[0] != 2101])


def test_many_partitions_rounds_and_blocks(spark, monkeypatch):
    """Small partitions, leaves, blocks and rounds give the same rows."""
    rows = clustered(700, seed=5)
    for name, v in (("TREE", 60), ("LEAF", 5), ("ANCHORS", 6), ("FIRST", 3)):
        monkeypatch.setattr(H, name, v)
    assert made(spark, rows) == brute_force(rows)


def test_no_rows(spark):
    assert made(spark, []) == []
    assert made(spark, [(1, [1.0], 1)]) == []
    assert made(spark, [(50, [1.0], 1)]) == []
    assert made(spark, [(50, [1.0], 1), (51, [1.0], 1), (52, [-1.0], 2)]) == []


def test_repeated_keys_count_once(spark):
    rows = clustered(120, seed=7)
    assert made(spark, rows + rows + [(5, rows[5][1], 9)]) == brute_force(rows)


def test_walk_prunes_and_keeps_all():
    """Balls are left out, yet nothing that belongs to the first k."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(40, 6))[rng.integers(40, size=5000)] * 300 + rng.normal(size=(5000, 6)) * 5).astype(np.int64)
    labels = rng.integers(3, size=5000)
    forest = H.Forest(np.arange(5000), labels, x)
    seen = []
    plain = forest.scores
    forest.scores = lambda q, longest, ball: seen.append(len(q) * (ball.hi - ball.lo)) or plain(q, longest, ball)
    ids = np.arange(0, 5000, 50)
    slots = lambda v: np.full((len(ids), 1), v, np.int64)
    got = H.walk(forest, H.Asked(ids, labels[ids], x[ids], True, 5, slots(H.NOTHING + 1), slots(-H.NOTHING - 1), slots(H.NOTHING)))
    assert sum(seen) < 0.5 * 100 * 5000 / 3
    for i in ids:
        s = x @ x[i]
        want = sorted(((-s[j], j) for j in range(5000) if j != i and labels[j] == labels[i]))[:5]
        assert sorted(zip(-got[3][got[0] == i], got[2][got[0] == i])) == want


@pytest.mark.parametrize("scale", [1e6, 1e10])
def test_large_components(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) * scale).tolist(), i % 3) for i in range(120)]
    if scale > 1e9:
        with pytest.raises(Exception, match="fit into a long"):
            made(spark, rows)
    else:
        assert made(spark, rows) == brute_force(rows)
