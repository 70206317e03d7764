"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within three bits agree in one of four 16-bit fields, so the index's
upper nodes are masked bit patterns: one field's mask and its value. Under such a
node fingerprints are sorted by Gray rank, and consecutive ones form nodes that
hold the bits their members share. A search walks down from the pattern, adds the
differences against each node's remaining shared bits, and drops the whole group
once they exceed three. Each node's groups of linked fingerprints leave as a
spanning forest, never as all pairs; the forests meet in connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import durable, mapped, star_join
from larkspur.llm.graph import components

BITS = 3
FANOUT = 16
#: Members of a field pattern beyond which it is divided by a further mask.
HOT = 4096
#: Rows, and open (fingerprint, node) pairs, of a search at once, which bounds its memory.
FRONT = 400_000


def fingerprint(text: str | None, words: int = 3) -> int:
    import xxhash

    ws = (text or "").encode("utf-8", "replace").lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(ws))
    of = xxhash.xxh64_intdigest
    h = np.array([of(joined[a:b], 42) for a, b in zip(starts[: len(ws) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, extra columns, fp), fp as a signed long; null, empty and wordless texts have fingerprint 0."""

    def make(texts: list[str | None]) -> list:
        return [np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)]

    # Names that no column of docs can clash with; the text itself goes no further.
    own = docs.select(F.col(key).alias("k"), *(F.col(c).alias(f"x{i}") for i, c in enumerate(extra)), F.col(text).alias("t"))
    made = mapped(own, ["t"], "fp long", make, keep=False)
    return made.select(F.col("k").alias(key), *(F.col(f"x{i}").alias(c) for i, c in enumerate(extra)), "fp")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code word in Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _links(fp: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions i < j in one group within BITS bits; fp is sorted by group, then Gray rank."""
    n = len(fp)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    root = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    local = np.arange(n) - first[root]
    # Levels from the leaves' parents up to one node a group; each is (first member, shared bits, their mask, first child).
    levels, starts, step = [], np.arange(n), FANOUT
    while True:
        node = np.concatenate([[True], (root[1:] != root[:-1]) | (local[1:] // step != local[:-1] // step)])
        at = np.flatnonzero(node)
        mask = ~(np.bitwise_or.reduceat(fp, at) ^ np.bitwise_and.reduceat(fp, at))
        levels.append((at, fp[at] & mask, mask, np.searchsorted(starts, at)))
        starts = at
        if len(at) == len(first):
            break
        step *= FANOUT
    sizes = [n, *(len(x[0]) for x in levels)]
    bounds = [np.append(x[3], sizes[k]) for k, x in enumerate(levels)]
    # A node keeps only the shared bits its parent lacks, so that differences add up on the way down.
    rest = []
    for k, (at, bits, mask, _) in enumerate(levels):
        up = np.zeros(len(at), np.uint64) if k + 1 == len(levels) else np.repeat(levels[k + 1][2], np.diff(bounds[k + 1]))
        rest.append(mask & ~up)
    leaf_rest = ~np.repeat(levels[0][2], np.diff(bounds[0]))
    last = [np.append(x[0][1:], n) for x in levels]
    alone = np.diff(np.append(first, n)) < 2
    q = np.flatnonzero(~alone[root])
    todo = [(len(levels) - 1, q, root[q], np.zeros(len(q), np.int64))]
    while todo:
        k, q, node, acc = todo.pop()
        if not len(q):
            continue
        if len(q) > 1 and k >= 0:
            room = np.diff(bounds[k])[node].sum()
            if room > FRONT:
                half = len(q) // 2
                todo += [(k, q[half:], node[half:], acc[half:]), (k, q[:half], node[:half], acc[:half])]
                continue
        c = np.diff(bounds[k])[node]
        child = np.repeat(bounds[k][node], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        q2, acc2 = np.repeat(q, c), np.repeat(acc, c)
        if k == 0:
            keep = child > q2
            q2, child, acc2 = q2[keep], child[keep], acc2[keep]
            near = acc2 + np.bitwise_count((fp[q2] ^ fp[child]) & leaf_rest[child]) <= BITS
            yield q2[near], child[near]
        else:
            acc2 = acc2 + np.bitwise_count((fp[q2] ^ levels[k - 1][1][child]) & rest[k - 1][child])
            keep = (acc2 <= BITS) & (last[k - 1][child] > q2 + 1)
            todo.append((k - 1, q2[keep], child[keep], acc2[keep]))


def forest(fp: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what _links connects, one less than the members of each linked set."""
    order = np.lexsort((gray_rank(fp), group))
    fp, group = fp[order], group[order]
    parent = np.arange(len(fp))
    for a, b in _links(fp, group):
        while len(a):
            ra, rb = parent[a], parent[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := parent[parent] != parent).any():
                parent[up] = parent[parent[up]]
    leaf = np.flatnonzero(parent != np.arange(len(fp)))
    return fp[leaf], fp[parent[leaf]]


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forests of the buckets in rows sorted by bucket, a bounded number of whole buckets at a time."""
    held: list[pd.DataFrame] = []

    def forests(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["bucket"].to_numpy(np.int64))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= FRONT:
            pdf = pd.concat(held)
            last = pdf["bucket"].to_numpy() == pdf["bucket"].iloc[-1]  # the last bucket may go on
            if not last.all():
                yield forests(pdf[~last])
            held = [pdf[last]]
    if sum(map(len, held)):
        yield forests(pd.concat(held))


#: Bits in which fingerprints of one bucket may still differ, from level to level; four fields divide them.
LEVELS = (64, 48, 36, 27)


def _split(rest: str, bucket: str | None, width: int):
    """For each of four fields of the width bits in rest: a bucket of (bucket, field, its value), and the bits left."""
    base, more = divmod(width, 4)
    out, shift = [], 0
    for f in range(4):
        w = base + (f < more)
        value = F.shiftrightunsigned(rest, shift).bitwiseAND((1 << w) - 1)
        high = F.shiftleft(F.shiftrightunsigned(rest, shift + w), shift) if shift + w < 64 else F.lit(0).cast("long")
        left = F.col(rest).bitwiseAND((1 << shift) - 1).bitwiseOR(high)
        out.append(F.struct(F.xxhash64(F.lit(width), F.lit(f), value, *([bucket] if bucket else [])).alias("bucket"), left.alias("rest")))
        shift += w
    return F.explode(F.array(*out)).alias("x")


def links(fps: DataFrame) -> DataFrame:
    """(a, b) edges over distinct fingerprints in ``fp`` whose components are those of all links.

    Members of a bucket agree in the fields that name it; linked ones also agree in one of four further
    fields, since they differ in three bits at most. So a bucket of over HOT members is divided by one
    more masked pattern, up to len(LEVELS) times: what shares three quarters of all fields, 43 bits and
    more, is searched as it is.
    """
    keys = fps.select("fp", F.col("fp").alias("rest")).select("fp", _split("rest", None, LEVELS[0])).select("fp", "x.bucket", "x.rest")
    done = []
    for width in LEVELS[1:]:
        keys = durable(keys)
        hot = durable(keys.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("bucket"))
        if hot.isEmpty():
            break
        # One bucket in HOT is hot at most, and holds many rows: the few names are joined without moving those.
        marked = keys.join(hot.withColumn("hot", F.lit(True)), "bucket", "left")
        done.append(marked.where("hot is null").select("fp", "bucket"))
        keys = marked.where("hot").select("fp", _split("rest", "bucket", width)).select("fp", "x.bucket", "x.rest")
    done.append(keys.select("fp", "bucket"))
    return reduce(DataFrame.unionAll, done).repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_search, "a long, b long")


def rooted(reps: DataFrame) -> DataFrame:
    """reps, one row for each distinct fp, with comp: the root of all fingerprints reachable over links."""
    comp = durable(components(links(reps.select("fp"))))
    return reps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key of the documents reachable over links.

    Null, empty and wordless texts share fingerprint 0 and link like any other. Repeated
    rows come out repeatedly; rows with a null key belong to no class of their own but
    take the smallest non-null key reachable (null if none). An empty table gives no rows.
    """
    fps = durable(fingerprints(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "k", "t"))
    named = rooted(fps.groupBy("fp").agg(F.min("k").alias("least"), F.count("*").alias("n")))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_fp = durable(named.join(least, "comp").select("fp", "component_id", "n"))
    return star_join(fps, of_fp, "fp", fps.count(), "n").select(F.col("k").alias(key), "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of each document."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
