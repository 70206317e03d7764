import random

import numpy as np
import xxhash

from larkspur.llm import simhash as S
from larkspur.llm.graph import components


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain(text):
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    sh = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint():
    for t in ["", None, " \t", "One", "one Two", "a b c", "A\x0bb\x0cÉ d e f a b c a b c", "x " * 500]:
        assert S.fingerprint(t) == plain(t)


def test_forest_links_what_all_pairs_link():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for b in base for _ in range(60)}
    fp = np.array(sorted(fps), np.uint64)
    a, b = S.forest(fp, np.zeros(len(fp), np.int64))
    pairs = [(int(x), int(y)) for i, x in enumerate(fp) for y in fp[i + 1 :] if (int(x) ^ int(y)).bit_count() <= 3]
    assert union(zip(a.tolist(), b.tolist()), fps) == union(pairs, fps)


def test_classes(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 50)
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(25):
        long = [rng.choice(words) for _ in range(120)]
        for _ in range(8):
            t = list(long)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(120)] = rng.choice(words)
            texts.append(" ".join(t))
    texts += [None, "", " ", "a", "a", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in S.digest(df.withColumn("fp", df.doc_id)).collect()}
    fps = [plain(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = union(pairs, range(len(texts)))
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(got[k].fingerprint == f"{f:016x}" for k, f in enumerate(fps))
    assert S.digest(df.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(7)
    pairs = [(k, k + 1) for k in range(0, 60) if k % 20] + [(1000, rng.randrange(1001, 1100)) for _ in range(60)] + [(5, 5)]
    nodes = {x for p in pairs for x in p}
    got = {r.node: r.comp for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: c for n, c in union(pairs, nodes).items() if n != c}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_thousands_of_fingerprints_that_share_forty_bits(spark, monkeypatch):
    monkeypatch.setattr(S, "FRONT", 3000)
    rng = np.random.default_rng(8)
    fp = np.unique(np.concatenate([np.uint64(0xABCDEF0123000000) | rng.integers(0, 1 << 24, 12_000, np.uint64), rng.integers(0, 1 << 63, 500, np.uint64)]))
    a, b = np.triu_indices(0)
    pairs = []
    for lo in range(0, len(fp), 500):
        a, b = np.nonzero(np.bitwise_count(fp[lo : lo + 500, None] ^ fp[None]) <= 3)
        pairs += [(x, y) for x, y in zip((a + lo).tolist(), b.tolist()) if x < y]
    key = fp.view(np.int64).tolist()
    want = union([(key[x], key[y]) for x, y in pairs], key)
    got = {r.fp: r.comp for r in S.rooted(spark.createDataFrame([(k,) for k in key], "fp long")).collect()}
    assert got == want and len(set(got.values())) < len(key) - 1000
