import random
import re
from collections import defaultdict

from larkspur.llm import span_dedup as S


M = 2**64 - 1
K1, K2, K3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def mixed(x):
    x = (x ^ x >> 32) * K2 & M
    x = (x ^ x >> 29) * K3 & M
    return x ^ x >> 32


def word_hash(w):
    low = [c.lower() if len(c.lower()) == 1 else c for c in w]
    return mixed(sum(mixed((ord(c) * K1 + i * K3) & M) for i, c in enumerate(low)) + len(w) & M)


def sentences(text):
    """(start, end, normal form) of the parts of a text, word by word."""
    found, sents, last = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\S+", text or "")], [], None
    for w in found:
        if last is None or last[2][-1] in ".!?" or "\n" in text[last[1] : w[0]]:
            sents.append([])
        sents[-1].append(w)
        last = w
    out = []
    for ws in sents:
        cuts = [0]
        if len(ws) > S.LONGEST:
            pair = [mixed((word_hash(a[2]) * K1 + word_hash(b[2])) & M) >> 1 for a, b in zip(ws, ws[1:])]
            for i, p in enumerate(pair):
                if all(p < q for q in pair[max(0, i - S.AROUND) : i]) and all(p <= q for q in pair[i + 1 : i + 1 + S.AROUND]):
                    cuts.append(i + 1)
        for a, b in zip(cuts, [*cuts[1:], len(ws)]):
            for k in range(a, b, S.LONGEST):
                out.append((ws[k][0], " ".join(w[2].lower() for w in ws[k : min(b, k + S.LONGEST)])))
    ends = [a for a, _ in out[1:]] + [len(text or "")]
    return [(0 if i == 0 else a, e, form) for i, ((a, form), e) in enumerate(zip(out, ends))]


def brute(rows, run=S.RUN):
    """Kept texts, by looking at every run of every text in order."""
    seen, bad, cut = defaultdict(list), defaultdict(set), {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0)):
        ss = sentences(rows[i][1])
        for a in range(len(ss) - run + 1):
            seen["\n".join(s[2] for s in ss[a : a + run])].append((i, a))
    for places in seen.values():
        for i, a in places[1:]:
            bad[i].update(range(a, a + run))
    for i, (_, t) in enumerate(rows):
        ss = sentences(t)
        cut[i] = "".join(t[s[0] : s[1]] for k, s in enumerate(ss) if k not in bad[i]) if ss else t
    return cut


EDGE = ["", "  ", "A b. C d! E", " lead\n\nline two. x.y z ", "w " * 100, "a.\n", "\n\n a", "İSTANBUL Ä ß \U0001f600 \u2003x\x1cy", "word " * 30 + "\n" + "x" * 300, "a\u00a0b. c"]


def test_parts_as_word_by_word(monkeypatch):
    for size in (S.SLICE, 50):
        monkeypatch.setattr(S, "SLICE", size)
        for texts in ([t] for t in EDGE):
            got = list(zip(*(x.tolist() for x in S.parts(texts)[1:3])))
            assert got == [s[:2] for s in sentences(texts[0])], texts
        of, begin, end, *_ = S.parts(EDGE)
        assert list(zip(of.tolist(), begin.tolist(), end.tolist())) == [(i, a, b) for i, t in enumerate(EDGE) for a, b, _ in sentences(t)]


def test_same_as_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    sent = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(2, 40))) + rng.choice([".", "!", "\n"])
    shared = [" ".join(sent() for _ in range(5)) for _ in range(4)]
    texts = [" ".join([sent(), rng.choice(shared), sent(), rng.choice(shared), sent()]) for _ in range(40)] + [None, "", "a. b. c.", "a. b. c.", "a. b. c. d. e. f. g.", "x. a. b. c. d. e. f.", "x"]
    texts += [texts[0]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, removed int")
    got = {r.doc_id: r for r in S.dedup(df).collect()}
    want = brute(rows)
    assert {i: r.kept_text for i, r in got.items()} == want
    assert all(r.removed_in == 1 for r in got.values())
    for r in S.digest(df).collect():
        spans = [tuple(map(int, p.split(":"))) for p in r.removed.split(",") if p]
        assert len(spans) == r.n_removed
        t = texts[r.doc_id] or ""
        assert len(t) - sum(b - a for a, b in spans) == r.n_chars_kept
    assert S.digest(df.limit(0)).count() == 0


def test_passages_inside_long_sentences_at_any_offset(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    rows, passages = [], [some(51) for _ in range(60)]
    for n, p in enumerate(passages):
        for copy in range(2):
            rows.append((2 * n + copy, " ".join(some(rng.randint(17, 90)) + p + some(rng.randint(17, 90)))))
    rows += [(i, "Read this. Then that. Go on. And on. Stop. Go home.") for i in (1000, 1001)]
    got = {r.doc_id: r for r in S.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = [n for n in range(60) if got[2 * n + 1].n_removed]
    assert len(lost) >= 58 and not any(got[2 * n].n_removed for n in range(60))
    for n in lost:
        kept = set(got[2 * n + 1].text.split())
        assert sum(w not in kept for w in passages[n]) >= 9
    assert got[1000].n_removed == 0 and got[1001].text == ""  # runs of few words count as well
