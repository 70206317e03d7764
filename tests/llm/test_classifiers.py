import random

import numpy as np

from larkspur.llm import quality, toxicity

WORDS = ["thing", "ander", "other", "with", "them", "ration", "eding", "onder", "hasten", "lybe", "enti", "re", "of", "the", "a"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) if rng.random() < 0.5 else rng.choice(WORDS) for _ in range(n))


def corpus(spark, toxic):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        t, bad = prose(rng, rng.randint(20, 80)), i % 4 == 0
        if bad and toxic:
            ws = t.split()
            for w in rng.sample(["stupid", "moron", "pathetic", "loweich", "loweien"], 2):
                ws.insert(rng.randrange(len(ws)), w)
            t = " ".join(ws)
        elif bad:
            t = rng.choice([t.upper().replace(" ", "!! "), " ".join(w for w in t.split()[:6] for _ in range(12)), t.replace(" ", " | ")])
        rows.append((i, t, 0.5))
        labels.append((i, int(not bad), int(bad)))
    rows += [(600, None, 0.0), (601, "", 0.0), (602, "you are so st.u-pid today", 0.0), (603, "you s t u p i d thing", 0.0), (604, "stuupid of them", 0.0), (605, rows[1][1], 0.0), (606, prose(rng, 60000), 0.0)]
    labels += [(1, None, None), (None, 1, 1), (2, 7, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def scores(df):
    return {r.doc_id: r for r in df.collect()}


def test_toxicity(spark):
    docs, labels = corpus(spark, toxic=True)
    got = scores(toxicity.digest(docs, labels))
    assert len(got) == 607 and all(0 <= r.score <= 1 for r in got.values())
    held = [r for i, r in got.items() if i < 600 and r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert [got[i].predicted for i in (600, 601, 602, 603, 604, 606)] == [0, 0, 1, 1, 1, 0]
    assert got[605].score == got[1].score
    none = scores(toxicity.digest(docs, labels.limit(0)))
    assert len({r.score for r in none.values()}) == 1
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels)).count() == 0


def brute_kernel(a, b):
    """Sum over common subsequences of three characters, word for word."""

    def vector(w):
        out = {}
        w = w.ljust(toxicity.WIDTH + toxicity.SPAN - 1, "\0")
        for i in range(toxicity.WIDTH):
            for x in range(i + 1, i + toxicity.SPAN - 1):
                for y in range(x + 1, i + toxicity.SPAN):
                    if w[i] != "\0":
                        k = (w[i], w[x], w[y])
                        out[k] = out.get(k, 0) + toxicity.DECAY ** (y - i - 2)
        return out

    va, vb = vector(a), vector(b)
    return sum(v * vb.get(k, 0) for k, v in va.items()) / toxicity.NORM


def test_kernel_folds(monkeypatch):
    a, b = [" stupid of th", " a lowei", " x ", "worthless and th"], [" stuupid of the", "tupi", " thing in it", " s tupid man", ""]
    k = toxicity.kernel(b, a)
    with monkeypatch.context() as m:
        m.setattr(toxicity, "TABLE_BITS", 32)  # without the table's rare collisions
        assert np.allclose(toxicity.kernel(b, a), [[brute_kernel(x, y) for y in a] for x in b], atol=1e-4)
    for j, w in enumerate(a):
        table = toxicity.folded([w], np.ones(1))
        for i, x in enumerate(b):
            m = toxicity.margins(toxicity.codes(x.ljust(toxicity.WIDTH + toxicity.SPAN - 1, "\0")), table)
            assert abs((m[0] if len(m) else 0) - k[i, j]) < 1e-4
    assert k[0, 0] > 2 * k[2, 0] and k[3, 0] > 1.2 * k[2, 0]  # a gap inside a word costs little, across a border too


def test_worst_window_of_long_and_short_texts(monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE", 64)
    model = toxicity.Model(toxicity.folded([" stupid of th"], np.ones(1)), 0.5)
    clean = "thing and other. " * 40
    got = model.worst([None, "", "...", clean, clean + "you stupid of them. " + clean, "stupid"])
    assert [m for m, _ in got[:3]] == [toxicity.LEAST] * 3
    assert got[4][0] > got[3][0] and "stupid" in got[4][1] and got[5][0] > got[3][0]


def test_fit_looks_at_the_whole_sample_whatever_the_labels_are(spark):
    docs, labels = corpus(spark, toxic=True)
    more = labels.unionByName(spark.range(10_000, 610_000).selectExpr("id as doc_id", "1 as quality", "cast(id % 4 = 0 as int) as toxic"))
    got, want = toxicity.fit(docs, more, per_class=10**7), toxicity.fit(docs, labels)
    assert np.array_equal(got.table, want.table) and (got.bias, got.slope, got.offset) == (want.bias, want.slope, want.offset)


def test_quality(spark):
    docs, labels = corpus(spark, toxic=False)
    got = scores(quality.digest(docs, labels))
    held = [r for i, r in got.items() if i < 600 and r.held_out]
    assert held and np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.95
    assert len(got) == 607 and all(0 <= r.score <= 1 for r in got.values())
    assert got[605].score == got[1].score
    assert len({r.score for r in scores(quality.digest(docs, labels.limit(0))).values()}) == 1
    assert quality.digest(docs.limit(0), labels).count() == 0


def test_cosines_are_exact(spark):
    docs, labels = corpus(spark, toxic=False)
    m = quality.fit(docs, labels)
    rows = np.stack([quality.counts(r.text) for r in docs.limit(20).collect()])
    x = m.latent(rows)
    for i, s in enumerate(m.score(rows)):
        sims = m.vectors.astype(np.float64) @ x[i].astype(np.float64)
        near = np.argsort(-sims)[: m.k]
        vote = np.maximum(sims[near], 0) ** 4 * m.weights[near]
        assert abs(s - (vote * m.labels[near]).sum() / vote.sum()) < 0.02
