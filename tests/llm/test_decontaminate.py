import random

from larkspur.llm import decontaminate as D

DOCS = "doc_id long, text string, n_words string"


def made(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], DOCS)
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    rows = D.digest(d, b).orderBy("doc_id").collect()
    return [tuple(r)[1:] for r in rows]


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = ["a", "B", "c9", "É", "of", "the"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [text(rng.choice([1, 4, 13, 20, 40])) for _ in range(12)] + [None, "", "!!"]
    docs = [text(rng.randint(0, 80)) for _ in range(60)] + [text(5) + " " + items[k] + " " + text(30) for k in range(12)] + [None, "", " ", text(5000)]
    docs += docs[:3]
    want = D.brute_force(docs, [(str(i), t) for i, t in enumerate(items) if t is not None])
    assert made(spark, docs, items) == want


def test_passes_agree(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    items = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(9)]
    docs = [" ".join([items[k], items[k - 1], "x", items[k - 2]]) for k in range(9)]
    whole = made(spark, docs, items)
    monkeypatch.setattr(D, "PASS_WINDOWS", 30)
    monkeypatch.setattr(D, "PIECE", 15)
    assert made(spark, docs, items) == whole


def test_empty_tables(spark):
    assert made(spark, ["a b", None], []) == [(2, 0, 0, D.brute_force(["a"], [])[0][3], False), (0, 0, 0, D.brute_force(["a"], [])[0][3], False)]
    assert made(spark, [], ["a"]) == []


def test_many_benchmarks_in_one_session(spark):
    """Workers are reused; each call searches its own benchmark and no earlier one's."""
    for k in range(20):
        docs = [f"only{k} one two three", f"other{k} four five"]
        items = [docs[k % 2]]
        assert made(spark, docs, items) == D.brute_force(docs, [("0", items[0])])
