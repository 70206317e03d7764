"""The corpus pipeline: quality, near-duplicates, benchmark passages, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All
but the last return the columns of documents; run() writes each stage as Parquet in the
shared checkpoint folder and rereads it for the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, pieces, quality, secret_scan, simhash
from larkspur.llm.common import durable, staged, star_join, table
from larkspur.llm.queries import piece_model

#: Rows to drop that are named to every task, at most, at 24 bytes each; more are joined by shuffling.
NAMED = 2_000_000


def aside(docs: DataFrame, *needed: str) -> DataFrame:
    """docs as an operator gets them: the needed columns, and all others out of its names' way in one struct."""
    rest = [c for c in docs.columns if c not in needed]
    return docs.select(*needed, *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest_")] if rest else []))


def back(made: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs out of what an operator made of aside(docs), those in new replaced."""
    kept = {"doc_id", "text", "source"} & set(made.columns)
    own = {c: F.col(c) if c in kept else F.col(f"rest_.`{c}`") for c in docs.columns}
    return made.select(*((new.get(c, v)).alias(c) for c, v in own.items()))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier scores below 0.3."""
    scored = quality.score(aside(docs, "doc_id", "text"), quality.fit(docs, table(spark, sf_dir, "labels")), out="score")
    return back(scored.where("score >= 0.3").drop("score"), docs)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the first by id (null ids last), then by hashes of the row.

    Groups are those of the texts' fingerprints, whatever the rows' ids: unrelated rows without an
    id or with the same one all stay, and no group stays twice. Which rows go is decided on ids, hashes
    and fingerprints alone; texts are only moved where too many rows go to name them to every task.
    """
    rows = aside(docs, "doc_id", "text")
    each = [F.col(c) if c in ("doc_id", "text") else F.col(f"rest_.`{c}`") for c in docs.columns]
    whole = [x for c in each for x in (c, c.isNull())]  # a null alone would leave no trace in a hash
    rows = rows.withColumns({"h1_": F.xxhash64(*whole), "h2_": F.xxhash64(F.lit(2), *whole)})
    fps = durable(simhash.fingerprints(rows.select("doc_id", "text", "h1_", "h2_"), extra=("h1_", "h2_")))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1_", "h2_")
    named = simhash.rooted(fps.groupBy("fp").agg(F.min(row).alias("first"), F.count("*").alias("n")))
    kept = named.groupBy("comp").agg(F.min("first").alias("kept"))
    of_fp = durable(named.join(kept, "comp").select("fp", "kept", "n"))
    judged = star_join(fps, of_fp, "fp", fps.count(), "n").withColumn("stays", (F.col("h1_") == F.col("kept.h1_")) & (F.col("h2_") == F.col("kept.h2_")))
    # Rows alike in every column have the same hashes: all of them stay here, and one of them below.
    fate = durable(judged.groupBy("h1_", "h2_").agg(F.first("stays").alias("stays"), F.count("*").alias("n")))
    gone, again = fate.where("not stays").select("h1_", "h2_"), fate.where("stays and n > 1").select("h1_", "h2_", F.lit(True).alias("again_"))
    named_to_all = fate.where("not stays or n > 1").count() <= NAMED
    few = F.broadcast if named_to_all else (lambda df: df)
    left = rows.join(few(gone), ["h1_", "h2_"], "left_anti").join(few(again), ["h1_", "h2_"], "left")
    once = left.where("again_ is null").drop("again_").unionByName(left.where("again_").drop("again_").dropDuplicates(["h1_", "h2_"]))
    return back(once, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of which a twentieth or more are benchmark passages."""
    found = decontaminate.find(aside(docs, "text"), table(spark, sf_dir, "benchmark"))
    return back(found.where(~decontaminate.contaminated()).drop("hit_words", "hit_items", "n_words"), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; n_chars follows the new text."""
    found = secret_scan.scan(aside(docs, "text", "source"), secret_scan.train(secret_scan.labelled_findings(spark)))
    sure = found.withColumn("sure_", secret_scan.secrets_only()).withColumn("clean_", secret_scan.redact(F.col("text"), F.col("sure_")))
    n = F.when(F.size("sure_") > 0, F.length("clean_").cast("long")).otherwise(F.col("rest_.n_chars"))
    return back(sure, docs, text=F.col("clean_"), n_chars=n)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (decimal, comma-joined) and the digests of ids and decoded text."""
    return pieces.digest(docs, piece_model(), extra=["lang", "source"], ids=True)


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", keep_first_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("sentencepiece", to_ids),
]
#: The classifier, the forest and the tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with staged(spark) as stage:
        for name, step in STAGES[:-1]:
            docs = stage(name, step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
