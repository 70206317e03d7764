import hashlib
import re

import pytest

import corpus_pipeline as P
from larkspur.llm import decontaminate, quality, simhash
from larkspur.llm.common import table
from larkspur.llm.queries import piece_model

SF = "/root/testdata/sf0.001"
sp = pytest.importorskip("sentencepiece")


def groups(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents").persist()
    columns = docs.columns
    step = dict(P.STAGES)

    good = step["quality_classifier"](spark, docs, SF).persist()
    scored = {r.doc_id: r.predicted for r in quality.digest(docs, table(spark, SF, "labels")).collect()}
    assert good.columns == columns
    assert {r.doc_id for r in good.collect()} == {d for d, p in scored.items() if p}

    once = step["simhash_near_dedup"](spark, good, SF).persist()
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    root = groups([simhash.fingerprint(t) for _, t in rows])
    assert sorted(r.doc_id for r in once.collect()) == [rows[i][0] for i in sorted(set(root))]
    assert once.columns == columns

    clean = step["benchmark_decontamination"](spark, once, SF).persist()
    rows = sorted((r.doc_id, r.text) for r in once.collect())
    items = [(str(r.item_id), r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = [b[-1] for b in decontaminate.brute_force([t for _, t in rows], items)]
    assert sorted(r.doc_id for r in clean.collect()) == [d for (d, _), b in zip(rows, bad) if not b]

    safe = step["secret_scan"](spark, clean, SF).persist()
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in safe.collect():
        assert r.text == re.sub(r'(?<=token = ")[0-9a-f]{40}', "<secret>", before[r.doc_id])
        assert r.n_chars == len(r.text)
    assert safe.count() == len(before) and safe.columns == columns

    lib = sp.SentencePieceProcessor(model_file=piece_model())
    texts = {r.doc_id: r.text for r in safe.collect()}
    last = step["sentencepiece"](spark, safe, SF).collect()
    assert len(last) == len(texts)
    for r in last:
        ids = lib.encode(texts[r.doc_id])
        assert r.ids == ",".join(map(str, ids)) and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()

    whole = {r.doc_id: r.ids_sha256 for r in P.run(spark, SF).collect()}
    assert whole == {r.doc_id: r.ids_sha256 for r in last}


def test_dedup_stage_without_ids_and_with_repeats(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "a b c d e f g h"), (None, "q r s t u v"), (None, "q r s t u v"), (3, None), (4, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id or 0) for r in P.keep_first_copies(spark, df, SF).collect()) == [0, 1, 3]
    assert P.keep_first_copies(spark, df.limit(0), SF).count() == 0


def test_dedup_stage_keeps_one_row_of_each_group(spark):
    a, b, c, d = ("alpha beta gamma delta eps zeta", "one two three four five six", "red green blue black white", "sun moon star sky sea land")
    rows = [(1, a), (5, a), (5, b), (None, c), (None, d), (None, a), (7, d), (None, "up down left right"), (None, "up down left right"), (None, None), (None, " ")]
    df = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0, (r.text or "").strip()) for r in P.keep_first_copies(spark, df, SF).collect()))
    assert got == sorted([(1, a), (5, b), (0, c), (7, d), (0, "up down left right"), (0, "")])


def test_columns_that_clash_stay_as_they_are(spark):
    rows = [(n, f"alpha beta {'gamma ' * n} token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "en", "s", 5, "mine", n, "own") for n in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, first_ long, score string")
    df = df.selectExpr("*", "'a' as quality_score", "'b' as hit_words", "'c' as secrets", "'d' as sure_", "'e' as fp", "'f' as h1_", "'g' as Score_In", "'h' as rest_", "'i' as seen_")
    for step in (P.keep_good, P.keep_first_copies, P.drop_contaminated, P.redact_secrets):
        out = step(spark, df, SF)
        assert out.columns == df.columns
        for r in out.collect():
            assert (r.n_words, r.first_, r.score, r.quality_score, r.hit_words, r.secrets, r.sure_, r.fp, r.h1_, r.Score_In, r.rest_, r.seen_) == ("mine", r.doc_id, "own", *"abcdefghi")
    assert P.redact_secrets(spark, df, SF).where("text like '%<secret>%' and n_chars = length(text)").count() == 30


def test_dedup_stage_where_too_many_rows_go_to_name_them(spark, monkeypatch):
    monkeypatch.setattr(P, "NAMED", 0)
    test_dedup_stage_keeps_one_row_of_each_group(spark)
    rows = [(1, "a b c", None, "x", 1), (1, "a b c", "x", None, 1), (1, "a b c", None, "x", 1), (2, "q r s t", None, "x", 1), (2, "q r s t", None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.keep_first_copies(spark, df, SF).collect()) == [1, 2]
