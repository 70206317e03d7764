"""Approximate nearest neighbours by inner product, over balanced posting lists.

Centroids are fitted on a bounded sample. Every vector goes to its nearest centroid's
list and, at a cluster boundary, to further lists whose centroids are about as near.
Centroids are searched by walking a neighbourhood graph held in memory; a query opens
the lists whose centroid distance is within a ratio of the nearest one's. How many lists
and what ratio is measured: some queries are answered exactly, and as many lists are
opened as hold nearly all of those answers, so that recall holds as lists grow in number. Long lists
are split by a hash, so that no task holds a group that grows with the data; each
part returns its best candidates and one grouping keeps the best of all.

Inner product becomes distance by one more component, sqrt(M^2 - |x|^2), M the
largest norm; a query has 0 there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import durable

#: Vectors that centroids are fitted on, at most; centroids, at most; vectors a list should hold.
SAMPLE, CENTROIDS, LIST = 20_000, 4096, 800
#: Lists a boundary vector is in, at most, and how much further their centroids may be (squared-distance ratio).
COPIES, BOUNDARY = 4, 1.10
#: Lists a query opens whatever their distance; lists within the squared-distance ratio that it opens. The last two grow as measured.
PROBES_LEAST, PROBES, PRUNE = 8, 24, 1.6
#: Queries answered exactly to measure that, and the share of their neighbours whose lists have to be opened.
TRIED, HELD = 256, 0.995
DEGREE, BEAM = 16, 32
#: Vectors of one part of a list, and queries that meet a part at once.
PART, ASKING = 2000, 2000


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, peak) of vectors that take part: not null or empty, all components finite, not all zero; peak is the largest magnitude.

    The test looks at components and not at a norm, which underflows or overflows where components are tiny or huge.
    """
    v = F.col(vector).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False)))
    return out.withColumn("peak", F.array_max(F.transform("v", F.abs))).where("peak > 0")


class Centroids:
    """Centroids and the graph over them."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float32)
        self.norm = (self.points**2).sum(1)
        d = self.norm[:, None] - 2 * self.points @ self.points.T + self.norm[None]
        near = np.argsort(d, axis=1, kind="stable")[:, : DEGREE + 1]
        # Some far neighbours keep the graph connected and the walks short.
        far = np.random.default_rng(5).integers(0, len(points), (len(points), 4))
        self.graph = np.hstack([near, far])
        self.entry = np.linspace(0, len(points) - 1, min(16, len(points))).astype(int)

    def _distances(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return (x**2).sum(1)[:, None] + self.norm[ids] - 2 * np.matmul(self.points[ids], x[:, :, None])[:, :, 0]

    def exact(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """What search() looks for, over all centroids; cheaper than walks where many are wanted."""
        x = x.astype(np.float32)
        d = np.maximum((x**2).sum(1)[:, None] + self.norm - 2 * x @ self.points.T, 0)
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        return order, np.take_along_axis(d, order, 1)

    def search(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest centroids of each row, nearest first, by best-first walks side by side."""
        x = x.astype(np.float32)
        n, k = len(x), min(k, len(self.points))
        beam = min(max(BEAM, k), len(self.points))
        ids = np.tile(self.entry, (n, 1))
        dist = self._distances(x, ids)
        opened = np.zeros((n, len(self.points)), bool)
        rows = np.arange(n)
        while len(rows):
            todo = np.where(opened[rows[:, None], ids[rows]], np.inf, dist[rows])
            pick = np.argsort(todo, axis=1)[:, :4]  # several steps at once
            live = np.isfinite(np.take_along_axis(todo, pick, 1))
            rows, pick, live = rows[live.any(1)], pick[live.any(1)], live[live.any(1)]
            if not len(rows):
                break
            nodes = np.take_along_axis(ids[rows], pick, 1)
            nodes = np.where(live, nodes, nodes[:, :1])
            opened[np.repeat(rows, nodes.shape[1]), nodes.ravel()] = True
            new = self.graph[nodes].reshape(len(rows), -1)
            all_ids = np.hstack([ids[rows], new])
            all_d = np.hstack([dist[rows], self._distances(x[rows], new)])
            order = np.argsort(all_ids, axis=1, kind="stable")
            sorted_ids = np.take_along_axis(all_ids, order, 1)
            again = np.zeros_like(sorted_ids, bool)
            again[:, 1:] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
            sorted_d = np.where(again, np.inf, np.take_along_axis(all_d, order, 1))
            best = np.argsort(sorted_d, axis=1)[:, :beam]
            got_ids, got_d = np.take_along_axis(sorted_ids, best, 1), np.take_along_axis(sorted_d, best, 1)
            if ids.shape[1] < got_ids.shape[1]:
                pad = got_ids.shape[1] - ids.shape[1]
                ids = np.hstack([ids, np.repeat(ids[:, :1], pad, 1)])
                dist = np.hstack([dist, np.full((n, pad), np.inf)])
            ids[rows, : got_ids.shape[1]], dist[rows, : got_ids.shape[1]] = got_ids, got_d
        order = np.argsort(dist, axis=1)[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def balanced_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centroids by k-means whose distances carry a penalty for full clusters."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    extra = np.zeros(k)
    for _ in range(rounds):
        label = np.concatenate([np.argmin((c**2).sum(1) - 2 * b @ c.T + extra, axis=1) for b in np.array_split(x, max(1, len(x) // 2000))])
        size = np.bincount(label, minlength=k)
        extra = 0.5 * extra + 0.05 * (size / (len(x) / k) - 1)
        total = np.zeros_like(c)
        np.add.at(total, label, x)
        full = size > 0
        c[full] = total[full] / size[full, None]
        c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


def fit(vectors: DataFrame, n: int, scale: float, most: float) -> Centroids:
    """Centroids on a bounded sample, drawn by a hash of id and vector; identical vectors count once."""
    share = min(1.0, 4 * SAMPLE / max(n, 1))
    some = vectors.where(F.pmod(F.xxhash64("id", "v"), F.lit(1_000_000)) < int(1e6 * share) + 1).dropDuplicates(["v"]).orderBy(F.xxhash64("v", F.lit(2)), "id").limit(SAMPLE)
    x = lifted(np.array([r.v for r in some.select("v").collect()], np.float64), scale, most)
    k = int(min(CENTROIDS, max(1, n // LIST), len(x)))
    return Centroids(balanced_kmeans(x, max(k, 1)))


def lifted(x: np.ndarray, scale: float | None, most: float = 1.0) -> np.ndarray:
    """Rows in units of scale * most, the largest norm, with the component that makes them equally long (queries: scale None, it is 0)."""
    if scale is None:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.hstack([x, np.zeros((len(x), 1))])
    x = x / scale / most
    return np.hstack([x, np.sqrt(np.maximum(1 - (x**2).sum(1, keepdims=True), 0))])


def _posted(c: Centroids, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of each (lifted) vector, and which of them it is in."""
    ids, d = c.search(x, COPIES)
    keep = d <= d[:, :1] * BOUNDARY + 1e-9
    keep[:, 0] = True
    return ids, keep


def _best(tried, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, q = tried.value
        for whole in batches:
            for lo in range(0, len(whole), 4096):
                pdf = whole.iloc[lo : lo + 4096]
                x = np.stack(pdf["v"].to_list())
                got = top((qid, q), (pdf["id"].to_numpy(), x), k)
                at = pd.Series(np.arange(len(pdf)), pdf["id"].to_numpy())
                yield pd.DataFrame({"query_id": got[0], "vec_id": got[1], "score": got[2], "v": list(x[at[got[1]].to_numpy()])})

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; a score that is not a number (infinite parts of both signs) comes last."""
    order = [F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score")).desc(), "vec_id"]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def probes(asked: DataFrame, base: DataFrame, c: Centroids, scale: float, most: float, k: int) -> tuple[int, float]:
    """(lists, squared-distance ratio) that a query has to open for HELD of the exact neighbours.

    Measured on at most TRIED queries (by a hash of their vectors), each against all vectors.
    """
    some = asked.orderBy(F.xxhash64("v", F.lit(3)), "id").limit(TRIED).select("id", "v").collect()
    if not some or len(c.points) <= PROBES:
        return len(c.points), PRUNE
    qid, q = np.array([r.id for r in some]), np.array([r.v for r in some], np.float64)
    tried = base.sparkSession.sparkContext.broadcast((qid, q))
    near = _ranked(base.select("id", "v").mapInPandas(_best(tried, k), "query_id long, vec_id long, score double, v array<double>"), k).select("query_id", "v").collect()
    if not near:
        return len(c.points), PRUNE
    lists, keep = _posted(c, lifted(np.array([r.v for r in near], np.float64), scale, most))
    order, d = c.exact(lifted(q, None), len(c.points))
    place = np.argsort(order, axis=1)
    at = {int(i): j for j, i in enumerate(qid)}
    row = np.array([at[r.query_id] for r in near])
    need = np.where(keep, place[row[:, None], lists], len(c.points)).min(1)
    lists_needed = np.quantile(need, HELD, method="higher") + 1
    ratio = np.quantile(d[row, need] / np.maximum(d[row, 0], 1e-9), HELD, method="higher")
    return int(max(PROBES, lists_needed)), float(max(PRUNE, ratio * (1 + 1e-6)))


def _lists(shared, scale: float, most: float, opened: tuple[int, float] | None = None):
    """The lists of each vector, or where opened (as of probes()) is given, those each query opens; place 0 is the nearest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Centroids = shared.value
        for whole in batches:
            for lo in range(0, len(whole), 512):
                pdf = whole.iloc[lo : lo + 512]
                x = np.stack(pdf["v"].to_list())
                if opened:
                    x = lifted(x, None)
                    ids, d = c.exact(x, opened[0]) if opened[0] > BEAM else c.search(x, opened[0])
                    keep = d <= d[:, :1] * opened[1] + 1e-9
                    keep[:, :PROBES_LEAST] = True
                else:
                    ids, keep = _posted(c, lifted(x, scale, most))
                row, col = np.nonzero(keep)
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[row], "v": [pdf["v"].iloc[i] for i in row], "list": ids[row, col].astype(np.int32), "place": col.astype(np.int32)})

    return run


def top(queries: tuple[np.ndarray, ...], candidates: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores) of each query's k best candidates other than itself, ties to smaller ids.

    queries are ids, vectors and, optionally, a least score for each. A block product finds what can be
    among the best; the scores are then summed row by row in one fixed order, so that equal vectors get
    equal scores wherever they lie.
    """
    out: list[tuple] = []
    (qid, q, *floor), (cid, c) = queries, candidates
    with np.errstate(over="ignore", invalid="ignore"):
        for lo in range(0, len(qid), 256):
            qi = qid[lo : lo + 256]
            s = q[lo : lo + 256] @ c.T
            s[np.isnan(s)] = -np.inf
            other = qi[:, None] != cid[None]
            s[~other] = -np.inf
            kth = np.partition(s, max(len(cid) - k, 0), axis=1)[:, max(len(cid) - k, 0)]
            if floor:
                kth = np.maximum(kth, floor[0][lo : lo + 256])
            slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0)))
            row, col = np.nonzero((s >= (kth - slack)[:, None]) & other)
            exact = np.concatenate([(q[lo + row[a : a + 20_000]] * c[col[a : a + 20_000]]).sum(1) for a in range(0, len(row), 20_000)] or [np.zeros(0)])
            order = np.lexsort((cid[col], -np.where(np.isnan(exact), -np.inf, exact), row))
            row, col, exact = row[order], col[order], exact[order]
            first = np.searchsorted(row, row)
            keep = np.arange(len(row)) - first < k
            out.append((qi[row[keep]], cid[col[keep]], exact[keep]))
    return tuple(np.concatenate([o[j] for o in out]) for j in range(3)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _part(k: int):
    schema = ("query_id", "vec_id", "score")

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({n: np.zeros(0, t) for n, t in zip(schema, (np.int64, np.int64, float))})
        asked = (left["id"].to_numpy(), np.stack(left["v"].to_list()), left["floor"].to_numpy(float))
        got = top(asked, (right["id"].to_numpy(), np.stack(right["v"].to_list())), k)
        return pd.DataFrame(dict(zip(schema, got)))

    return run


def _met(sent: DataFrame, dealt: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): each part's best for the queries (id, v, floor, list) sent to its list.

    Long lists lie in parts; many queries of one list are dealt out as well and meet copies of the
    parts, so that neither side of a group grows with the data.
    """
    crowds = sent.groupBy("list").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("crowds"))
    to = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    asking = sent.join(parts, "list").join(crowds, "list").select("id", "v", "floor", "list", F.pmod(F.xxhash64("id", F.lit(5)), F.col("crowds")).cast("int").alias("crowd"), to)
    there = dealt.join(crowds, "list").select("id", "v", "list", "part", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("crowd"))
    keys = ["list", "part", "crowd"]
    found = asking.groupBy(keys).cogroup(there.groupBy(keys)).applyInPandas(_part(k), "query_id long, vec_id long, score double")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def search(queries: DataFrame, vectors: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, itself left out, ties to smaller ids.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null
    ids, nor vectors of another length than most (of equally common lengths: the smaller). An id is expected
    once; repeated rows of an id count as one (the one whose vector sorts first). No vectors or no
    queries give no rows. A query whose lists hold too few candidates is compared with all vectors.

    The nearest list is opened first; its k-th score is the least that other lists have to offer.
    """
    one = lambda df: usable(df, key, vector).groupBy("id").agg(F.min_by("v", F.struct("peak", "v")).alias("v"), F.min("peak").alias("peak"))
    lengths = usable(vectors, key, vector).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    spark = vectors.sparkSession
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    alike = F.size("v") == lengths.n
    base = durable(one(vectors.where(F.size(vector) == lengths.n)))
    n, scale = base.agg(F.count("*"), F.max("peak")).first()
    most = base.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / scale) * (x / scale))))).first()[0]
    centroids = fit(base, n, scale, most)
    shared = spark.sparkContext.broadcast(centroids)
    asked = durable(one(queries).where(alike))
    opened = probes(asked, base, centroids, scale, most, k)
    width = "id long, v array<double>, list int, place int"
    posted = durable(base.select("id", "v").mapInPandas(_lists(shared, scale, most), width))
    # Lists beyond a part's size are dealt out by id; queries go to every part of theirs.
    parts = durable(posted.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    dealt = posted.join(parts, "list").select("id", "v", "list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    sent = durable(asked.select("id", "v").mapInPandas(_lists(shared, scale, most, opened), width))
    lowest = F.lit(float("-inf"))
    near = durable(_ranked(_met(sent.where("place = 0").withColumn("floor", lowest), dealt, parts, k), k))
    floors = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.when(F.isnan("score"), lowest).otherwise(F.col("score")).alias("low"))
    rest = sent.where("place > 0").join(floors, "id", "left").withColumn("floor", F.coalesce("low", lowest))
    more = _met(rest, dealt, parts, k)
    best = durable(_ranked(near.select("query_id", "vec_id", "score").unionByName(more).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k))
    # Vectors in no opened list: only for queries whose lists hold fewer than there are to find.
    held = best.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("held"))
    mine = asked.join(base.select("id", F.lit(1).alias("own")), "id", "left").join(held, "id", "left")
    short = durable(mine.where(F.coalesce("held", F.lit(0)) < F.least(F.lit(k), F.lit(n) - F.coalesce("own", F.lit(0)))).select("id", "v"))
    if not short.isEmpty():
        all_ = F.lit(-1).alias("list")
        pieces = max(1, -(-n // PART))
        dealt = base.select("id", "v", all_, F.pmod(F.xxhash64("id"), F.lit(pieces)).cast("int").alias("part"))
        whole = _met(short.select("id", "v", lowest.alias("floor"), all_), dealt, spark.range(1).select(all_, F.lit(pieces).alias("parts")), k)
        best = best.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(_ranked(whole, k))
    return best.select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 20; all rows are candidates."""
    return search(embeddings.where("vec_id % 20 = 0"), embeddings)
