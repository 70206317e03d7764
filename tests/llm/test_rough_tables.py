"""Null ids and texts, repeated rows and clashing columns through every document operator."""

import pytest

from larkspur.llm import chat, decontaminate, pieces, pii, quality, secret_scan, simhash, span_dedup, toxicity
from larkspur.llm.queries import piece_model

ROWS = [(1, "a b c", "en", "x"), (1, "a b c", "en", "x"), (None, "q r s t", None, None), (None, None, None, None), (7, None, "fr", "y"), (2**60 + 1, "", "de", "z"), (2**60 + 3, "a b. c", "de", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").coalesce(1).selectExpr("*", "1 as score", "2 as fp", "3 as ids", "4 as n_words", "5 as removed", "6 as secrets", "7 as kind", "8 as margin_")


def ids(df):
    return sorted((r.doc_id is not None, r.doc_id or 0) for r in df.select("doc_id").collect())


WANT = sorted((r[0] is not None, r[0] or 0) for r in ROWS)


def test_every_row_comes_out_once(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, "a b"), (3, None), (4, "a b")], "item_id long, text string")
    assert ids(decontaminate.digest(docs, bench)) == WANT
    assert ids(pieces.digest(docs, piece_model())) == WANT
    assert ids(quality.digest(docs, labels)) == WANT
    assert ids(toxicity.digest(docs, labels)) == WANT
    assert ids(simhash.digest(docs)) == WANT
    assert ids(span_dedup.digest(docs)) == WANT
    assert ids(pii.digest(docs)) == WANT
    assert ids(secret_scan.digest(docs)) == WANT


def test_clashing_columns_stay(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.fit(docs, labels)).where("score_in = 1").count() == len(ROWS)
    assert "removed_in" in span_dedup.dedup(docs).columns
    assert "n_words_in" in decontaminate.find(docs, spark.createDataFrame([], "item_id long, text string")).columns
    assert chat.digest(spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")).count() == 2


def test_parts_are_bounded_and_whole():
    import pyarrow as pa

    from larkspur.llm import common

    texts = ["a" * common.PART, None, "", *["b" * 1000] * 9000, "c" * (2 * common.PART)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])
    made = list(common._parts(whole, [1]))
    assert pa.Table.from_batches(made) == pa.Table.from_batches([whole])
    assert all(b.num_rows == 1 or b.column(1).nbytes <= common.PART for b in made)
    assert [b.num_rows for b in common._parts(whole.slice(0, 0), [1])] == [0]
