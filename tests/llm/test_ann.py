import numpy as np
import pyarrow as pa

from larkspur.llm import ann


def brute(ids, x, qids, k):
    out = {}
    for q in qids:
        s = (x * x[ids.index(q)]).sum(1)
        out[q] = [(ids[j], s[j]) for j in sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-s[j], ids[j]))[:k]]
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 16)).astype(np.float32).astype(float)
    x[:2600] = x[0]  # a large group of equal vectors
    ids = list(range(4000))
    rows = [(i, v.tolist(), 0) for i, v in zip(ids, x)] + [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0), (5060, [None] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    want = brute(ids, x, ids[::20], 20)
    got = {}
    for r in ann.digest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    assert all(len(v) == 20 for v in got.values())
    assert got[0] == want[0] and got[20] == want[20]
    same = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert same >= 0.95 * 20 * len(want)
    assert all(v == sorted(v, key=lambda p: (-p[1], p[0])) for v in got.values())


def test_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.digest(df).orderBy("rank").collect()] == [(0, 1, 2, 1.0), (0, 2, 1, 0.0)]
    assert ann.digest(df.limit(0)).count() == 0


def test_recall_with_many_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 20)  # 200 lists, of which a few don't hold the neighbours of such vectors
    x = np.random.default_rng(2).standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    s = x[::20] @ x.T
    s[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    want = np.argsort(-s, axis=1)[:, :20]
    got = {}
    for r in ann.digest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[20 * j] & set(w.tolist())) for j, w in enumerate(want)) >= 0.98 * want.size


def frame(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")


def test_vectors_of_any_size_and_length(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [1e200, 3e200]), (2, [1.0, 1.0]), (3, [1.0, 2.0, 3.0]), (4, []), (20, [-1.0, 2.0])]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.digest(frame(spark, rows)).collect()}
    assert set(q for q, _ in got) == {0, 20}  # a vector of another length than most takes no part
    assert [got[0, k][0] for k in (1, 2, 3)] == [1, 2, 20] and got[0, 1][1] == 1e-200 * 1e200 + 2e-200 * 3e200
    assert [got[20, k][0] for k in (1, 2, 3)] == [1, 2, 0]
    huge = ann.search(frame(spark, [(0, [1e200, -1e200])]), frame(spark, [(1, [1e200, 1e200]), (2, [1.0, 0.0]), (3, [1e200, 0.0])])).collect()
    assert [r.vec_id for r in sorted(huge, key=lambda r: r["rank"])] == [3, 2, 1] and huge[0].score == float("inf")


def test_equal_vectors_in_great_number(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 50)
    df = spark.range(3000).selectExpr("id as vec_id", "array(1.0D, 2.0D) as embedding")
    got = ann.digest(df).where("query_id = 40").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20)) and {r.score for r in got} == {5.0}


def test_short_lists_and_few_centroids(spark, monkeypatch):
    """Clustered vectors of mixed norms under a cap of lists; and lists far smaller than the answer."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32))
    x = (centres[rng.integers(0, 40, 50_000)] + 0.4 * rng.standard_normal((50_000, 32))) * rng.lognormal(0, 0.3, (50_000, 1))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(50_000), "embedding": list(x)}))
    ask = df.where("vec_id % 250 = 0")
    s = x[::250] @ x.T
    s[np.arange(200), np.arange(0, 50_000, 250)] = -np.inf
    want = [set(w) for w in np.argsort(-s, axis=1)[:, :20].tolist()]
    for cap in (4096, 30):
        monkeypatch.setattr(ann, "CENTROIDS", cap)
        got = {}
        for r in ann.search(ask, df).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert sum(len(got[250 * j] & w) for j, w in enumerate(want)) >= 0.9 * 20 * len(want)
    monkeypatch.setattr(ann, "LIST", 1)
    monkeypatch.setattr(ann, "PROBES", 1)
    monkeypatch.setattr(ann, "PROBES_LEAST", 1)
    monkeypatch.setattr(ann, "HELD", 0.01)
    monkeypatch.setattr(ann, "ASKING", 7)
    few = df.where("vec_id < 400")
    out = ann.search(few.where("vec_id % 20 = 0"), few)
    assert out.count() == 20 * 20 and out.groupBy("query_id").count().where("count <> 20").isEmpty()
