"""Rules that go step by step, against plain loops over the same rows."""

import random

from pyspark.sql import functions as F

from larkspur.operators import imports, ordered
from larkspur.streaming import health


def test_running_sum_in_parts(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.randint(0, 4)) for i in range(500)]
    rng.shuffle(rows)
    got = {r.i: r.before for r in ordered.running(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], ["i"], F.col("v"), "before").collect()}
    sums = {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        assert got[i] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v


def test_spaced_events(spark):
    """A rejected event delays nothing: at 0, 20 and 40 seconds the first and the last count."""
    rng = random.Random(2)
    rows = [("x", 0, 1), ("x", 20, 2), ("x", 40, 3), (None, 5, 4), ("x", None, 5)]
    rows += [(rng.choice(["hot"] * 8 + ["y", "z"]), rng.randint(0, 4000), 10 + i) for i in range(600)]
    df = spark.createDataFrame(rows, "account string, s long, id int").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(r.id for r in ordered.spaced(df, "account", "ts", "id", 25_000_000).collect())
    want, last = [], {}
    for account, s, i in sorted((r for r in rows if None not in r), key=lambda r: (r[1], r[2])):
        if account not in last or s - last[account] >= 25:
            last[account] = s
            want.append(i)
    assert got == sorted(want) and {1, 3} <= set(got) and 2 not in got
    assert ordered.spaced(df.limit(0), "account", "ts", "id", 1).count() == 0


def test_successors_in_one_pass(spark):
    """A frame that ends at the last row is worked out anew for each row: the square of a group."""
    rng = random.Random(6)
    rows = {(rng.choice(["hot"] * 8 + ["y", "z"]), rng.randint(0, 4000)) for _ in range(900)}
    got = ordered.successors(spark.createDataFrame(sorted(rows), "g string, t long"), "g", "t", 25)
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()
    want = {(g, x): min((y for h, y in rows if h == g and y >= x + 25), default=None) for g, x in rows}
    assert {(r.g, r.t): r.next for r in got.collect()} == want


def one_by_one(rows, held, rooms):
    seen = {}
    for w, _, e, p in held:
        seen.setdefault((w, "email"), set()).add((e or "").lower())
        seen.setdefault((w, "phone"), set()).add((p or "").replace(" ", ""))
    count, ended, out = {}, set(), {}
    for w, i, e, p in sorted(rows, key=lambda r: r[1]):
        day, quota = rooms.get(w, (None, None))
        n, dup = count.get(w, 0), None
        e, p = (e or "").lower(), (p or "").replace(" ", "")
        for kind, v in (("email", e), ("phone", p)):
            if v and v in seen.get((w, kind), ()) and not dup:
                dup = kind
        if w in ended:
            said = "not_reached"
        elif day is not None and n >= day:
            said = "daily_limit_reached"
        elif quota is not None and n >= quota:
            said = "quota_exceeded"
            ended.add(w)
        elif dup:
            said = "duplicate"
        else:
            said = "imported"
            count[w] = n + 1
            seen.setdefault((w, "email"), set()).add(e)
            seen.setdefault((w, "phone"), set()).add(p)
        out[i] = (said, dup if said == "duplicate" else None)
    return out


LEAD = "workspace_id int, ordinal int, email string, phone string"


def test_imports_one_by_one(spark):
    rng = random.Random(3)
    some = lambda n, k: [(rng.randint(0, 3), 0, rng.choice([None, "", f"A{rng.randint(0, k)}@x.org", f"a{rng.randint(0, k)}@X.org"]), rng.choice([None, "", f"5 {rng.randint(0, k)}", f"5{rng.randint(0, k)}"])) for _ in range(n)]
    held = some(12, 40)
    rows = [(w, i, e, p) for i, (w, _, e, p) in enumerate(some(260, 60))]
    rows += [(9, 1000 + i, f"m{i // 2}@x.org", f"7{(i + 1) // 2}") for i in range(24)]  # each shares a key with the row before
    rows += [(8, 2000 + i, "same@x.org", None) for i in range(40)]
    for rooms in ({}, {0: (5, 100), 1: (100, 5), 2: (0, 3), 3: (None, 0), 8: (1, 1), 9: (4, 4)}):
        table = spark.createDataFrame([(w, *r) for w, r in rooms.items()], "workspace_id int, day_room int, quota_room int")
        got = imports.import_rows(spark.createDataFrame(rows, LEAD), spark.createDataFrame(held, LEAD), table).collect()
        assert {r.ordinal: (r.outcome, r.duplicate) for r in got} == one_by_one(rows, held, rooms)
        assert len(got) == len(rows)


def test_update_conflicts(spark):
    leads = spark.createDataFrame([(1, 1, "A@x.org", "5 1"), (1, 2, "b@x.org", "52"), (2, 3, "a@x.org", None)], "workspace_id int, lead_id int, email string, phone string")
    asked = spark.createDataFrame([(1, 1, "a@X.org", "51"), (1, 2, "a@x.org", "51"), (2, 3, "b@x.org", "5 1"), (1, 4, None, "5 2")], leads.schema)
    assert {r.lead_id: r.duplicate for r in imports.update_conflicts(leads, asked).collect()} == {1: None, 2: "email", 3: None, 4: "phone"}


def walked(outcomes):
    """A source's outcomes one after another: newest 100, failures in a row, end of the cooldown."""
    state = {}
    for source, us, i, ok in sorted(outcomes, key=lambda o: o[1:3]):
        n, until, kept = state.get(source, (0, 0, []))
        threshold, cooldown = health.SETTINGS.get(source, (health.FAILURES, health.COOLDOWN))
        n = 0 if ok else n + 1
        if n >= threshold:
            until = us + cooldown * 1_000_000
        state[source] = (n, until, [*kept, (us, i, ok)][-100:])
    return {s: (len(k), round(sum(x[2] for x in k) / len(k), 3), n, until / 1e6, k[-1][0] < until) for s, (n, until, k) in state.items()}


def fed(spark, folder, batches, top):
    """State after all batches, each a file of its own that the stream sees after the ones before."""
    schema, rows = "source string, ts_us long, event_id long, ok boolean", None
    for n, b in enumerate(batches):
        spark.createDataFrame(b, schema).repartition(3).write.parquet(f"{folder}/in/b={n}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in/b=*")
        rows = health.source_health(stream, path=top)
    return rows.collect()


def test_breakers_over_many_batches(spark, tmp_path):
    rng = random.Random(4)
    every = [(rng.choice(["google_maps", "bizdata", "other", "other", "other"]), t * 1_000_000 + rng.randint(0, 3) * 250_000, t, rng.random() < 0.55) for t in range(600)]
    every += [("steady", t * 1_000_000, t, True) for t in (1, 300)]
    every.sort(key=lambda o: o[1:3])
    cut = [0, 40, 41, 300, len(every)]
    batches = [random.Random(n).sample(every[a:b], b - a) for n, (a, b) in enumerate(zip(cut, cut[1:]))]
    rows = fed(spark, str(tmp_path), batches, str(tmp_path / "top"))
    last = {}
    for r in sorted(rows, key=lambda r: (r.batch, -r.batch_)):
        last[r.source] = (r.samples, r.rate, r.failures, r.open_until_s, r.open)
    assert last == walked(every)


def test_breaker_opens_stays_and_closes(spark, tmp_path):
    """Two failures before a success open it, the success leaves it open, time closes it."""
    s = 1_000_000
    rows = fed(spark, str(tmp_path), [[("a", 10 * s, 1, False), ("a", 12 * s, 2, True), ("a", 11 * s, 3, False)], [("b", 2000 * s, 4, True)], [("b", 3000 * s, 5, True)]], str(tmp_path / "top"))
    a = sorted((r for r in rows if r.source == "a"), key=lambda r: r.batch_)
    assert (a[0].failures, a[0].open_until_s, a[0].open) == (0, 311.0, True)
    assert [r.open for r in a[1:]] == [False]


def test_job_progress(spark, tmp_path):
    schema = "job long, item long, ts_us long, seq long, status string"
    for n, rows in enumerate([[(1, 0, 1, 1, "running"), (1, 1, 1, 2, "done"), (2, 0, 5, 3, "failed")], [(1, 0, 9, 4, "done"), (2, 0, 4, 5, "running"), (2, 1, 1, 6, "queued")]]):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in/b={n}")
        got = health.job_progress(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/b=*"), str(tmp_path / "top"))
    said = {(r.batch_, r.job): (r.items, r.done, r.status) for r in got.collect()}
    first, second = sorted({b for b, _ in said})
    assert said[first, 1] == (2, 1, "in_progress") and said[first, 2] == (1, 1, "done")
    assert said[second, 1] == (2, 2, "done") and said[second, 2] == (2, 1, "in_progress")


def test_job_state_gets_one_row_an_item(spark, tmp_path):
    """Of 600 patches of two items the state's Python sees two rows; later batches leave what is newer, and batches read at once are told apart."""
    schema = "job long, item long, ts_us long, seq long, status string"
    spark.createDataFrame([(1, i % 2, i, i, "done" if i > 590 else "running") for i in range(600)], schema).repartition(3).write.parquet(f"{tmp_path}/in/b=0")
    got = health.job_progress(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/b=*"), str(tmp_path / "top"))
    assert [(r.items, r.done, r.status) for r in got.collect()] == [(2, 2, "done")]
    assert spark.read.parquet(f"{tmp_path}/top/sums/out").count() == 2
    spark.createDataFrame([(1, 0, 5, 5, "running"), (1, 1, 700, 700, "queued"), (1, 2, 1, 1, "failed")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b=1")
    got = health.job_progress(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/b=*"), str(tmp_path / "top"))
    assert [(r.items, r.done, r.status) for r in got.orderBy("batch_").collect()] == [(2, 2, "done"), (3, 2, "in_progress")]
