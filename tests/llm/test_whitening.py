import numpy as np
import pytest

from larkspur.llm import whitening as W

NAN, INF = float("nan"), float("inf")


def brute_force(rows, components=16):
    """The contract with numpy, one row after another."""
    kept = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), object)
    n, sums = len(fit), fit.sum(axis=0)
    a = (fit * n - sums).astype(float) / n
    cov = a.T @ a / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    x = np.array([x for _, x in kept], object)
    off = x * n - sums
    return n, [i for i, _ in kept], [int((r**2).sum()) for r in off], (off.astype(float) / n) @ q / np.sqrt(e), e / np.trace(cov), q


def check(spark, rows, components=16):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, whitened string")
    got = W.digest(df).orderBy("vec_id", "component").toPandas()
    n, ids, dev, w, share, _ = brute_force([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows])
    order = np.argsort(ids, kind="stable")
    k = w.shape[1]
    assert got.vec_id.tolist() == [ids[j] for j in order for _ in range(k)]
    assert got.component.tolist() == list(range(1, k + 1)) * len(ids)
    assert (got.n == n).all()
    assert got.deviation.tolist() == [dev[j] for j in order for _ in range(k)]
    made = got.whitened.to_numpy().reshape(-1, k)
    for c in range(k):
        want = w[order, c]
        assert np.allclose(made[:, c], want, atol=1e-7) or np.allclose(made[:, c], -want, atol=1e-7)
    assert np.allclose(got.explained.to_numpy().reshape(-1, k)[0], share, rtol=1e-9)
    assert (got.identity_error < 1e-9).all() and got.identity_error.nunique() == 1


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(20, 20))
    rows = [(i, (rng.normal(size=20) @ mix * 0.3).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(200)]  # one vector in a large share of the rows counts once
    rows += [(900, None), (901, [NAN] * 20), (902, [INF] + [0.0] * 19), (903, [None] + [0.0] * 19), (904, [0.0] * 20)]
    check(spark, rows)


def test_few_dimensions(spark):
    rng = np.random.default_rng(2)
    check(spark, [(i, rng.normal(size=3).tolist()) for i in range(50)])


def test_planes_and_single_points(spark):
    """Axes without variance don't come out; one vector alone has none."""
    rng = np.random.default_rng(3)
    flat = [(i, [float(a), float(b), 2.0]) for i, (a, b) in enumerate(rng.normal(size=(40, 2)))]
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.component for r in W.digest(df(flat)).collect()} == {1, 2}
    assert W.digest(df([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert W.digest(df([])).count() == 0
    assert W.digest(df([(1, None)])).count() == 0


def test_other_lengths_null_ids_and_columns(spark):
    rows = [(1, [1.0, 2.0], "a"), (None, [2.0, 5.0], "b"), (3, [4.0, 1.0], "c"), (3, [4.0, 1.0], "c"), (4, [1.0], "d"), (5, [], "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, deviation string")
    model = W.fit(df)
    assert (model.d, model.n) == (2, 3)
    got = W.whiten(df, model).collect()
    assert sorted(r.deviation_in for r in got) == ["a", "b", "c", "c"]
    assert all(len(r.whitened) == 2 for r in got)


def test_large_numbers_stay_exact(spark):
    """Sums beyond a long are kept as decimals; the query's long is null there."""
    big = 2.0**50
    rows = [(i, [big * i, -big * i * i, 1.0 + i]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    n, ids, dev, *_ = brute_force(rows)
    got = {r.vec_id: int(r.deviation) for r in W.whiten(df, W.fit(df)).collect()}
    assert got == dict(zip(ids, dev))
    assert {r.deviation for r in W.digest(df).collect()} == {None}


@pytest.mark.parametrize("kind", ["array<int>", "array<double>"])
def test_other_types(spark, kind):
    whole = [(i, [i % 7, i % 5, i * i % 11]) for i in range(60)]
    df = spark.createDataFrame(whole, "vec_id long, embedding array<int>").selectExpr("vec_id", f"cast(embedding as {kind}) as embedding")
    assert W.digest(df).count() == 180
