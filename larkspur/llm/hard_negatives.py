"""Hard-negative mining by branch and bound over ball trees.

Rows are dealt by a hash into partitions of bounded size. A task builds ball trees over its
partition, one for each label in it; a ball gives a least and a largest inner product with
an anchor. Anchors, in blocks of bounded size, walk the trees together: a ball is left out
for an anchor if its largest product lies strictly beneath the anchor's current k-th, or if
all its products lie outside the window of scores asked for. Partitions are visited in
rounds that grow fourfold, each starting from the k-th scores of the rounds before it, so
that a row hands on a few candidates a round whatever the number of partitions.

All scores are inner products of whole numbers, floor(SCALE * component), and exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import durable, shared_folder
from larkspur.llm.vectors import common_length, packed, unpack

SCALE = 256
#: Rows of one partition and of one leaf, anchors of one block, partitions of the first round.
TREE, LEAF, ANCHORS, FIRST = 16_384, 128, 4096, 64
#: A negative's score has to be from 50/100 to 95/100 of the positive's.
LOW, HIGH = (50, 100), (95, 100)
NOTHING = np.iinfo(np.int64).min


@dataclass
class Ball:
    """Rows lo to hi of a label's tree; centre and radius in doubles, the radius rounded up."""

    lo: int
    hi: int
    label: int
    centre: np.ndarray
    radius: float
    parts: list[Ball] = field(default_factory=list)


class Forest:
    """The ball trees of one partition's rows, one for each label, over one reordered matrix."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.x = ids[order], labels[order], x[order].astype(np.float64)
        self.longest = float(np.sqrt((self.x**2).sum(axis=1).max(initial=0)))
        edges = np.flatnonzero(np.diff(self.labels, prepend=self.labels[:1] - 1)) if len(ids) else []
        self.roots = [self._ball(int(lo), int(hi)) for lo, hi in zip(edges, [*edges[1:], len(ids)])]

    def _ball(self, lo: int, hi: int) -> Ball:
        x = self.x[lo:hi]
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-9 * (1 + self.longest)
        ball = Ball(lo, hi, int(self.labels[lo]), centre, radius)
        if hi - lo > LEAF and radius > 2e-9 * (1 + self.longest):
            # Two halves along the line from a far point to the point farthest from it.
            one = x[((x - centre) ** 2).sum(axis=1).argmax()]
            other = x[((x - one) ** 2).sum(axis=1).argmax()]
            order = np.argsort(x @ (other - one), kind="stable")
            for a in (self.ids, self.x):
                a[lo:hi] = a[lo:hi][order]
            mid = (lo + hi) // 2
            ball.parts = [self._ball(lo, mid), self._ball(mid, hi)]
        return ball

    def scores(self, q: np.ndarray, longest: float, ball: Ball) -> np.ndarray:
        """Exact inner products: in doubles where no partial sum can reach 2^53, else in longs, else an error."""
        if longest * self.longest < 2.0**53:
            return (q.astype(np.float64) @ self.x[ball.lo : ball.hi].T).astype(np.int64)
        if longest * self.longest >= 2.0**62 or np.abs(self.x[ball.lo : ball.hi]).max() >= 2.0**53:
            raise OverflowError("inner products of these vectors don't fit into a long")
        return q @ self.x[ball.lo : ball.hi].astype(np.int64).T


@dataclass
class Asked:
    """A block of anchors; for each, slots of (least, most) scores, the label it wants or shuns, and the k-th score so far."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    same: bool
    k: int
    least: np.ndarray
    most: np.ndarray
    kth: np.ndarray


def walk(forest: Forest, a: Asked) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, slot, id, score): the k first rows of each slot in this forest that may be among the k first of all."""
    n, slots = a.least.shape
    q, floor = a.x.astype(np.float64), np.maximum(a.least, a.kth)
    size = np.sqrt((q**2).sum(axis=1))
    longest = float(size.max(initial=0))
    best, who = np.full((n, slots, a.k), NOTHING), np.full((n, slots, a.k), np.iinfo(np.int64).max)

    def visit(ball: Ball, rows: np.ndarray) -> None:
        mid, reach = q[rows] @ ball.centre, size[rows] * ball.radius
        slack = 1e-9 * (1 + np.abs(mid) + reach)
        high, low = (mid + reach + slack)[:, None], (mid - reach - slack)[:, None]
        rows = rows[((high >= floor[rows]) & (low <= a.most[rows])).any(axis=1)]
        if not len(rows):
            return
        if ball.parts:
            # The half whose centre is nearer to most anchors comes first and raises their k-th scores.
            near = float((q[rows] @ (ball.parts[1].centre - ball.parts[0].centre)).mean())
            for part in ball.parts[:: 1 if near <= 0 else -1]:
                visit(part, rows)
            return
        s, ids = forest.scores(a.x[rows], longest, ball), forest.ids[ball.lo : ball.hi]
        s[a.ids[rows][:, None] == ids] = NOTHING
        for slot in range(slots):
            fits = (s >= floor[rows, slot][:, None]) & (s <= a.most[rows, slot][:, None]) & (s > NOTHING)
            some = np.flatnonzero(fits.any(axis=1))
            if not len(some):
                continue
            at = rows[some]
            score = np.hstack([best[at, slot], np.where(fits[some], s[some], NOTHING)])
            name = np.hstack([who[at, slot], np.broadcast_to(ids, (len(some), len(ids)))])
            first = np.lexsort((name, ~score), axis=1)[:, : a.k]
            best[at, slot], who[at, slot] = np.take_along_axis(score, first, 1), np.take_along_axis(name, first, 1)
            floor[at, slot] = np.maximum(floor[at, slot], best[at, slot, -1])

    every = np.arange(n)
    for root in forest.roots:
        meant = a.labels == root.label if a.same else a.labels != root.label
        visit(root, every[meant])
    at, slot, place = np.nonzero(best > NOTHING)
    return a.ids[at], slot, who[at, slot, place], best[at, slot, place]


def _search(asked: Broadcast, d: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), unpack(b.column(2), d)) for b in batches if b.num_rows]
        if parts:
            found = walk(Forest(*(np.concatenate(c) for c in zip(*parts))), asked.value)
            yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)) for f in found], names=["anchor", "slot", "id", "score"])

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _rounds(forests: list[DataFrame], asked: Asked, d: int) -> DataFrame:
    """(anchor, slot, id, score, place): the k first of each slot over all partitions, round by round."""
    spark, best = forests[0].sparkSession, None
    at = {int(i): j for j, i in enumerate(asked.ids)}
    for last, forest in enumerate(forests, 1 - len(forests)):
        shared = spark.sparkContext.broadcast(asked)
        found = forest.mapInArrow(_search(shared, d), "anchor long, slot long, id long, score long")
        best = durable(_first(found if best is None else best.drop("place").unionByName(found), asked.k))
        if last:  # the k-th scores of at most ANCHORS anchors
            for r in best.where(F.col("place") == asked.k).collect():
                asked.kth[at[r.anchor], r.slot] = r.score
    return best


def mine(df: DataFrame, anchors: str, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 3, low: tuple[int, int] = LOW, high: tuple[int, int] = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of df for which the SQL condition ``anchors`` holds.

    An anchor's positives are its first other rows of the same label; a positive's negatives the first rows of
    another label whose score is from low to high of the positive's. Higher scores come first, ties by smaller
    ids. Rows take part whose key and label aren't null and whose vector has the most common length and only
    finite components. A key is expected once: of repeated rows the one of the least (label, vector) counts.
    Without anchors, positives or fitting negatives there are no rows; other columns of df are of no effect.
    Scores that a long can't hold raise an OverflowError.
    """
    spark = df.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    d = common_length(df, vector)
    if not d:
        return spark.createDataFrame([], schema)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"), F.expr(anchors).alias("asked")).where("id is not null and label is not null")

    def once(some: DataFrame) -> DataFrame:
        got = packed(some, "v", d, SCALE, ["id", "label"])
        return got.groupBy("id").agg(F.min(F.struct("label", "x")).alias("m")).select("id", "m.label", "m.x")

    asking = durable(once(rows.where("asked")))
    n, m = rows.count(), asking.count()
    if not m:
        return spark.createDataFrame([], schema)
    trees, forests, share = -(-n // TREE), [], 0
    while share < trees:  # rounds of FIRST, 4 * FIRST, ... partitions, told apart by the id's hash before any vector is read
        size = min(FIRST * 4 ** len(forests), trees - share)
        place = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(trees))
        forests.append(durable(once(rows.where((place >= share) & (place < share + size))).repartition(size, "id")))
        share += size
    blocks, out = -(-m // ANCHORS), f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    for block in range(blocks):
        b = asking.where(F.pmod(F.xxhash64("id", F.lit(13)), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not b.num_rows:
            continue
        ids, labels = b["id"].to_numpy(), b["label"].to_numpy()
        x = unpack(b["x"].combine_chunks(), d)
        free = lambda slots, v: np.full((len(ids), slots), v, np.int64)
        near = _rounds(forests, Asked(ids, labels, x, True, positives, free(1, NOTHING + 1), free(1, -NOTHING - 1), free(1, NOTHING)), d)
        # A window of scores for each positive, in whole numbers: low * score <= s <= high * score.
        at = {int(i): j for j, i in enumerate(ids)}
        least, most = free(positives, -NOTHING - 1), free(positives, NOTHING)
        for r in near.select("anchor", "place", "score").collect():
            least[at[r.anchor], r.place - 1] = -(-low[0] * r.score // low[1])
            most[at[r.anchor], r.place - 1] = high[0] * r.score // high[1]
        far = _rounds(forests, Asked(ids, labels, x, False, negatives, least, most, free(positives, NOTHING)), d)
        pairs = near.select("anchor", F.col("id").alias("positive_id"), (F.col("place") - 1).cast("long").alias("slot"), F.col("score").alias("positive_score"))
        got = far.join(pairs, ["anchor", "slot"])
        got.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{out}/block={block}")
    return spark.read.schema(schema).parquet(f"{out}/*")


def digest(embeddings: DataFrame) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 50; where it is divisible by 7, the label is the next one of ten."""
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings.select("vec_id", "embedding", changed.alias("label")), "vec_id % 50 = 0")


#: digest() in SQL.
SQL = """with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c: floor(256 * cast(c as double))) as x
from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select a.vec_id as anchor, a.label as own, b.vec_id as id, b.label, cast(list_inner_product(a.x, b.x) as bigint) as score from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select *, row_number() over (partition by anchor order by score desc, id) as place from s where label = own),
n as (select p.anchor as anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score, cast(row_number() over (partition by p.anchor, p.id order by s.score desc, s.id) as int) as rank
from p join s on s.anchor = p.anchor and s.label <> s.own and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score where p.place <= 5)
select * from n where rank <= 3"""
