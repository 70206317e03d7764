"""Kept tables: snapshots in versions, exports, logs, purges, the live feed."""

import os
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators.purge import Link, purge_tenant
from larkspur.operators.snapshot import Conflict, Snapshot
from larkspur.sources import logs
from larkspur.streaming import feed

ROW = "k long, v string, at long, expires_at timestamp_ntz"


def test_snapshot_versions(spark, tmp_path):
    s = Snapshot(spark, f"file:{tmp_path}/s", ROW, ["k"], buckets=4)
    df = lambda rows: spark.createDataFrame(rows, "k long, v string, at long, e string").select("k", "v", "at", F.col("e").cast("timestamp_ntz").alias("expires_at"))
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    assert s.read().count() == 0
    assert s.change(df([(i, "a", 1, None) for i in range(20)] + [(3, "late", 2, None), (None, "x", 1, None)]), [F.desc("at")]) == 1
    before = s.read()
    written = set(os.listdir(f"{tmp_path}/s/data"))
    assert s.change(df([(3, None, 5, "2024-01-01 00:00:00")]), [F.desc("at")], patch=True) == 2
    change = (set(os.listdir(f"{tmp_path}/s/data")) - written).pop()
    assert len([f for f in os.listdir(f"{tmp_path}/s/data/{change}") if f.startswith("bucket_")]) == 1  # the other buckets stay as they are
    assert {r.k: r.v for r in before.collect()}[3] == "late"  # a reader keeps its version
    got = {r.k: (r.v, r.at) for r in s.read().collect()}
    assert len(got) == 20 and got[3] == ("late", 5) and got[4] == ("a", 1)
    assert 3 not in {r.k for r in s.read(now).collect()} and s.read(now).count() == 19
    assert s.read(version=1).where("at = 5").count() == 0
    assert s.drop_expired(now) == 3 and s.read().count() == 19
    s.vacuum(1)
    assert s.read().count() == 19


def test_snapshot_two_writers_and_a_dead_one(spark, tmp_path, monkeypatch):
    a, b = (Snapshot(spark, str(tmp_path / "s"), "k long, v string", ["k"], buckets=2) for _ in "ab")
    rows = lambda v: spark.createDataFrame([(1, v), (2, v)], "k long, v string")
    a.change(rows("0"), ["v"])
    seen = b.version()
    a.change(rows("a"), ["v"])
    monkeypatch.setattr(Snapshot, "version", lambda self: seen)  # b began before a's change was there
    with pytest.raises(Conflict):
        b.change(rows("b"), ["v"])
    monkeypatch.undo()
    assert {r.v for r in b.read().collect()} == {"a"}
    with open(tmp_path / "s/versions/000000000003.json", "w") as f:
        f.write('{"0": "half')  # a writer that died
    assert {r.v for r in b.read().collect()} == {"a"}
    assert b.change(rows("c"), ["v"]) == 4 and {r.v for r in a.read().collect()} == {"c"}


def test_logs_page_by_page(spark, tmp_path):
    path, rng = str(tmp_path / "log"), random.Random(1)
    lines = [("x" * rng.randint(0, 30)) + rng.choice(["", "é", "\t;"]) for _ in range(60)]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\nhalf a li")
    for page in (61, 64, 1 << 20):
        got = logs.read_log(spark, path, page).orderBy("offset").collect()
        assert [r.line for r in got] == lines
    assert logs.read_log(spark, str(tmp_path / "none")).count() == 0
    seen = []
    for more in ("", "ne\nlast\n"):
        with open(path, "a", encoding="utf-8") as f:
            f.write(more)
        q = logs.stream_log(spark, path, 500).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda b, n: seen.append(sorted((r.offset, r.line) for r in b.collect()))).start()
        q.awaitTermination()
    assert [x for _, x in seen[0]] == lines and [x for b in seen[1:] for _, x in b] == ["half a line", "last"]


def test_export_is_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(i, f'a "{i}", b\nc' if i % 2 else None, {"k": str(i)}) for i in range(50)], "i int, t string, m map<string,string>").repartition(4)
    back = lambda: spark.read.csv(path, header=True, multiLine=True, escape='"', schema="i int, t string, m string")
    broken = df.withColumn("t", F.when(F.col("i") == 33, F.raise_error(F.lit("killed"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="killed"):
        logs.export_csv(broken, path)
    assert os.listdir(tmp_path) == []
    logs.export_csv(df, path)
    got = {r.i: (r.t, r.m) for r in back().collect()}
    assert len(got) == 50 and got[3] == ('a "3", b\nc', "k: 3") and got[2][0] is None
    with pytest.raises(Exception, match="killed"):
        logs.export_csv(broken, path)
    assert os.listdir(tmp_path) == ["out"] and back().count() == 50
    logs.export_csv(df.limit(5), path)
    assert back().count() == 5 and os.listdir(tmp_path) == ["out"]


def test_purge_reaches_down(spark):
    df = spark.createDataFrame
    tables = {
        "steps": df([(1, 10), (2, 11), (3, None)], "step int, sequence int"),
        "sequences": df([(10, "a"), (11, "b")], "id int, workspace string"),
        "leads": df([(1, "a"), (2, "b"), (3, None)], "id int, workspace string"),
        "events": df([(1, 1, "b"), (2, 2, "b"), (3, None, "b"), (4, 2, "a")], "id int, lead int, workspace string"),
        "notes": df([(1, 1), (2, 2), (3, 4)], "id int, event int"),
    }
    links = [Link("steps", "sequence", "sequences", "id"), Link("events", "lead", "leads", "id"), Link("notes", "event", "events", "id")]
    own = {n: F.col("workspace") == "a" for n in ("sequences", "leads", "events")}
    stays, goes = purge_tenant(tables, links, own)
    ids = {n: sorted(r[0] for r in f.collect()) for n, f in stays.items()}
    assert ids == {"steps": [2, 3], "sequences": [11], "leads": [2, 3], "events": [2, 3], "notes": [2]}
    assert sum(f.count() for f in goes.values()) + sum(map(len, ids.values())) == sum(f.count() for f in tables.values())
    with pytest.raises(ValueError, match="circle"):
        purge_tenant(tables, [*links, Link("leads", "id", "notes", "id")], own)


def test_live_feed_over_batches(spark, tmp_path):
    rng, every = random.Random(3), []
    for n in range(3):
        batch = [(rng.choice([1, 1, 1, 2]), rng.randint(0, 60), rng.choice("st"), rng.random() < 0.5, None) for _ in range(80)]
        batch = [(w, at, s, live, f"{w}{at}{s}{live}") for w, at, s, live, _ in batch] + [(None, 1, "s", True, "x"), (2, 99, "s", None, "null")]
        every += batch
        spark.createDataFrame(batch, feed.ACTIVITY).repartition(3).write.parquet(f"{tmp_path}/in/b={n}")
        rows = feed.live_feed(spark.readStream.schema(feed.ACTIVITY).parquet(f"{tmp_path}/in/b=*"), str(tmp_path / "top"))
    got = {}
    for r in feed.current(rows).orderBy("place").collect():
        got.setdefault(r.workspace_id, []).append((r.at_us, r.stage, r.live))
    for w in (1, 2):
        best = {}
        for k, at, s, live, _ in every:
            if k == w:
                best[at, s] = best.get((at, s), False) or bool(live)
        assert got[w] == [(at, s, live) for (at, s), live in sorted(best.items(), key=lambda x: (-x[0][0], x[0][1]))][:40]
