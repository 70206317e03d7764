import random
import zlib

import numpy as np

from larkspur.llm import language as L

SOUNDS = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "über", "ein"], "cc": ["eau", "oux", "é", "le"]}


def said(lang, rng, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, Score double")


def naive(net, ids):
    """One window, one step, one state after another."""
    k, live = net.u.shape[2], ids[ids != L.PAD]
    soft = lambda v: v / (1 + np.abs(v))
    both = []
    for d, read in enumerate((live, live[::-1])):
        h, out = np.zeros(k), []
        for b in read:
            x, g = net.x[d][:, b].astype(float), net.u[d].astype(float) @ h
            r, z = (0.5 + 0.5 * soft(x[i * k : (i + 1) * k] + g[i * k : (i + 1) * k]) for i in (0, 1))
            n = soft(x[2 * k :] + r * (g[2 * k :] + net.b[d][:, 0]))
            h = n + z * (h - n)
            out.append(h)
        both.append(out if d == 0 else out[::-1])
    s = np.array([net.v @ np.concatenate(p) + net.c[:, 0] for p in zip(*both)])
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def some_windows(rng, rows=5, length=9):
    ids = rng.integers(97, 103, (rows, length)).astype(np.int16)
    ids[1, 4:], ids[3, 1:] = L.PAD, L.PAD
    return ids


def test_states_as_step_by_step():
    rng = np.random.default_rng(1)
    net, ids = L.Network.new(["a", "b", "c"], hidden=4), some_windows(rng)
    got = net.probabilities(net.states(ids))
    for row, w in enumerate(ids):
        want = naive(net, w)
        assert np.allclose(got[:, : len(want), row].T, want, atol=1e-5)


def test_gradients_as_differences():
    rng = np.random.default_rng(2)
    net, ids, y = L.Network.new(["a", "b", "c"], hidden=3), some_windows(rng), np.array([0, 1, 2, 0, 1])
    for name in ("x", "u", "b", "v", "c"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    _, grads = net.gradients(ids, y)
    for p, g in zip(net.parameters(), grads):
        for at in [tuple(rng.integers(s) for s in p.shape) for _ in range(6)] + ([(0, 1, 97), (1, 5, 98)] if p is net.x else []):
            old, eps = p[at], 1e-3
            p[at] = old + eps
            up = net.gradients(ids, y)[0]
            p[at] = old - eps
            down = net.gradients(ids, y)[0]
            p[at] = old
            assert abs((up - down) / (2 * eps) - g[at]) < 2e-4, at


def test_held_out_accuracy_and_rough_rows(spark):
    rng = random.Random(4)
    rows = [(i, said(lang := rng.choice(list(SOUNDS)), rng, rng.randint(3, 60)), lang, 0.0) for i in range(600)]
    rows += [(1000, None, "aa", 0.0), (1001, "", "bb", 0.0), (1002, "12 34 !! ½ ² _", "cc", 0.0), (1003, rows[0][1], None, 0.0), (None, said("bb", rng, 20), "bb", 0.0)]
    rows += [(1004, said("cc", rng, 30_000), "cc", 0.0), rows[5], rows[5]]
    got = L.digest(table(spark, rows)).toPandas()
    assert len(got) == len(rows) and set(got.columns) == {"doc_id", "held_out", "lang_pred", "score"}
    assert got.score.between(0, 1).all()
    truth = {r[0]: r[2] for r in rows}
    plain = got[got.doc_id < 1000]
    assert [zlib.crc32(str(int(i)).encode()) % 3 == 1 for i in plain.doc_id] == plain.held_out.tolist()
    held = plain[plain.held_out]
    assert (held.lang_pred == [truth[i] for i in held.doc_id]).mean() > 0.97
    by = dict(zip(got.doc_id, got.lang_pred))
    assert [by[i] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by[1003] == rows[0][2] and by[1004] == "cc"
    assert not got[got.doc_id.isna()].held_out.any()


def test_learns_nothing_from_held_out_rows(spark):
    """A language that only held-out rows have is never predicted."""
    rng = random.Random(6)
    rows = [(i, said("aa", rng, 20), "aa", 0.0) for i in range(60)]
    rows += [(i, said("bb", rng, 20), "bb", 0.0) for i in range(100, 400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {r.lang_pred for r in L.digest(table(spark, rows)).collect()} == {"aa"}


def test_runs_cover_every_position(spark):
    rng = random.Random(5)
    rows = [(i, said(lang := rng.choice(["bb", "cc"]), rng, 30), lang, 0.0) for i in range(200)]
    docs = table(spark, rows)
    mixed = said("bb", rng, 40) + " " + said("cc", rng, 40)
    two = table(spark, [(1, mixed, None, 0.5), (2, None, None, 0.5)])
    got = {r.doc_id: r for r in L.identify(two, L.fit(docs), runs=True).collect()}
    runs = got[1].lang_runs
    assert got[1].Score_in == 0.5 and got[2].lang_runs == []
    assert [r.begin for r in runs] == [0, *(r.end for r in runs[:-1])] and runs[-1].end == len(mixed)
    half = mixed.index(". ") + 1
    right = sum(max(0, min(r.end, half) - r.begin) for r in runs if r.lang == "bb") + sum(max(0, r.end - max(r.begin, half)) for r in runs if r.lang == "cc")
    assert right > 0.9 * len(mixed)


def test_no_rows_and_no_labels(spark):
    assert L.digest(table(spark, [])).count() == 0
    got = L.digest(table(spark, [(1, "word", None, 0.0)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
