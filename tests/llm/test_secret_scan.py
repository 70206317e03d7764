import hashlib

import pytest
from pyspark.sql import functions as F

from larkspur.llm import secret_scan as S


@pytest.fixture(scope="module")
def model(spark):
    return S.train(S.labelled_findings(spark))


def seen(spark, n=6000, held_out=False):
    f = S.features(*(F.col(c) for c in ("value", "before", "after", "path")))
    return S.labelled_findings(spark, n, held_out).select("label", *(c.cast("double").alias(k) for k, c in f.items()))


def test_templates_that_training_never_saw(spark, model):
    got = seen(spark, held_out=True).select("label", (F.expr(S.as_sql(model)) >= 0.5).alias("yes")).groupBy("label", "yes").count().collect()
    n = {(r.label, r.yes): r["count"] for r in got}
    assert n[1.0, True] / (n[1.0, True] + n[1.0, False]) > 0.8  # recall
    assert n[1.0, True] / (n[1.0, True] + n.get((0.0, True), 0)) > 0.85  # precision


def test_no_feature_alone_tells_secrets(spark):
    rows = seen(spark).toPandas()
    for k in rows.columns.drop("label"):
        cuts = rows[k].quantile([0.1 * q for q in range(10)]).unique()
        best = max(max(((rows[k] > c) == (rows.label == 1)).mean(), ((rows[k] <= c) == (rows.label == 1)).mean()) for c in cuts)
        assert best < 0.85, k


def test_expression_equals_model(spark, model):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = seen(spark, 400)
    x = model.transform(VectorAssembler(inputCols=rows.columns[1:], outputCol="x").transform(rows))
    both = x.select(vector_to_array("probability")[1].alias("p"), F.expr(S.as_sql(model)).alias("q"))
    assert both.where("abs(p - q) > 1e-9").count() == 0


def test_planted_in_prose(spark, model):
    import random

    rng = random.Random(5)
    word = lambda: rng.choice(["thing", "ander", "other", "with", "them", "ration"])
    upper, mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    bad = [lambda: "AKIA" + some(upper, 16), lambda: "ghp_" + some(mixed, 36), lambda: "sk-" + some(mixed, 40), lambda: f'token = "{some("0123456789abcdef", 40)}"', lambda: "password=" + some("0123456789abcdef", 18)]
    fine = [lambda: some("0123456789", 16), lambda: 'token = "aaaaaaaaaaaaaaaaaaaa1"', lambda: 'password="report-2024-draft"', lambda: "commit " + some("0123456789abcdef", 40), lambda: "THING2024_OTHER_000123", lambda: "https://example.com/2024/05/other-thing-with-42.html", lambda: "mail12345678@example.org"]
    rows = [(n, f"{word()} {word()} {(bad if n % 2 else fine)[n // 2 % len(bad if n % 2 else fine)]()} {word()}", "src1") for n in range(1000)]
    got = {r.doc_id: r.n_secrets for r in S.digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    found, wrong = sum(got[n] > 0 for n in range(1, 1000, 2)), sum(got[n] > 0 for n in range(0, 1000, 2))
    assert found >= 475 and wrong <= 15


def test_scan(spark, model):
    key = hashlib.sha1(b"x").hexdigest()
    texts = [f'thor token = "{key}" the of', f"commit {key} in the", "card 4111111111111111 of it", None, "", "é☃ " + f'secret: "{key}" b' * 2, "word " * 30000 + f'api_key = "{key}"']
    df = spark.createDataFrame([(i, t, None, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string, secrets string")
    rows = {r.doc_id: r for r in S.scan(df, model).withColumn("sure", S.secrets_only()).withColumn("clean", S.redact(F.col("text"), F.col("sure"))).collect()}
    assert [len(rows[i].sure) for i in range(7)] == [1, 0, 0, 0, 0, 2, 1]
    for i, t in enumerate(texts):
        assert all(t[m.start : m.end] == m.value == key for m in rows[i].sure)
        assert rows[i].clean == (t.replace(key, "<secret>") if rows[i].sure else t)
        assert rows[i].secrets_in == "s"
    assert S.scan(df.limit(0), model).count() == 0
