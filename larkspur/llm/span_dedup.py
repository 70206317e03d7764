"""Substring dedup by sliding sentence spans.

Texts are cut into sentences (at line ends and after . ! ?), overlong ones into parts of
at most ``LONGEST`` words, so that a passage without full stops has parts to share. Where
they are cut is decided by the words around the place, so that a passage is cut alike
wherever in a long sentence it stands. Every run of ``RUN`` consecutive sentences is
hashed to 128 bits; all runs are sorted by hash once, and the sentences that a non-first
occurrence covers are removed.

Runs that a sample of the texts shows to be very frequent are dealt out by text, and
their first occurrences, at most ``1 / SHARE`` rows, meet in a broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import durable, mapped

#: A run is some 30 words: enough that a phrase doesn't count, few enough that a passage of over 50 words holds one wherever it is cut.
RUN, LONGEST = 6, 8
#: An overlong sentence is cut after a word whose pair hash is the least among those of so many words on both sides.
AROUND = 3
#: Characters of texts that are cut side by side, which bounds a task's memory; a longer text is read piece by piece.
SLICE = 2_000_000
#: One text of so many shows which runs are frequent; those with over this share of its runs are split, into so many salts.
SAMPLE, SHARE, SALTS = 64, 1 / 2000, 64
#: Characters beyond this code point have no case and are no white space.
CASED = 0x20000
K1, K2, K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
MOST = np.iinfo(np.uint64).max
_blank = re.compile(r"\s")


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point (itself where that isn't one character), and whether it is white space."""
    lower = [ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(CASED)]
    return np.array(lower, np.uint32), np.array([chr(c).isspace() for c in range(CASED)])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * K2
    x = (x ^ x >> np.uint64(29)) * K3
    return x ^ x >> np.uint64(32)


def _words(text: str) -> tuple[np.ndarray, ...]:
    """(start, end, hash of the lower-cased word, ends a sentence, line end before it) of each word."""
    lower, blank = _characters()
    found, lo, broken = [], 0, True
    while lo < len(text):
        piece = _blank.search(text, lo + SLICE)  # pieces end at white space
        hi = piece.start() if piece else len(text)
        chars = np.frombuffer(text[lo:hi].encode("utf-32-le", "surrogatepass"), "<u4")
        low = np.minimum(chars, CASED - 1)
        space = blank[low]
        chars = np.where(chars < CASED, lower[low], chars)
        gap = np.concatenate([[True], space, [True]])
        start, end = np.flatnonzero(~space & gap[:-2]), np.flatnonzero(~space & gap[2:]) + 1
        lines = np.concatenate([[0], np.cumsum(chars == 10)])
        if len(start):
            size = np.diff(np.append(start, len(chars)))
            size[0] += start[0]
            place = np.arange(len(chars)) - np.repeat(start, size)
            each = mix(chars.astype(np.uint64) * K1 + place.astype(np.uint64) * K3)
            each[space] = 0
            h = mix(np.add.reduceat(each, start) + (end - start).astype(np.uint64))
            last = chars[end - 1]
            before = np.concatenate([[0], end[:-1]])
            fresh = lines[start] > lines[before]
            fresh[0] |= broken
            found.append((start + lo, end + lo, h, (last == 46) | (last == 33) | (last == 63), fresh))
            broken = bool(lines[-1] > lines[end[-1]])
        else:
            broken = broken or bool(lines[-1])
        lo = hi
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, bool, bool))
    return tuple(np.concatenate(x) for x in zip(*found))


def _cuts(h: np.ndarray, first: np.ndarray, longest: int) -> np.ndarray:
    """Whether each word starts a part: sentence starts, and content-defined places in overlong sentences."""
    sentence = np.cumsum(first) - 1
    overlong = (np.bincount(sentence) > longest)[sentence]
    pair = np.full(len(h), MOST, np.uint64)  # of a word and the next one of its sentence
    inner = overlong[:-1] & ~first[1:]
    pair[:-1][inner] = mix(h[:-1][inner] * K1 + h[1:][inner]) >> np.uint64(1)
    cut = pair < MOST
    for d in range(1, min(AROUND, len(h) - 1) + 1):
        same = sentence[d:] == sentence[:-d]
        cut[d:] &= ~same | (pair[d:] < pair[:-d])
        cut[:-d] &= ~same | (pair[:-d] <= pair[d:])
    starts = first.copy()
    starts[1:] |= cut[:-1]
    at = np.flatnonzero(starts)
    place = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
    return starts | (place % longest == 0)


def parts(texts: list[str], longest: int = LONGEST) -> tuple[np.ndarray, ...]:
    """(text, start, end, two hashes) of the parts of all texts, in order; a text's parts together are the whole text.

    White space belongs to the part before it, at the start of a text to the first one. Empty and blank texts have none.
    """
    lens = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(lens + 1)])
    start, _, h, stop, fresh = _words("\n".join(texts))
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    of = np.searchsorted(base, start, "right") - 1
    first = fresh | np.concatenate([[True], stop[:-1] | (of[1:] != of[:-1])])
    at = np.flatnonzero(_cuts(h, first, longest))
    size = np.diff(np.append(at, len(h)))
    place = (np.arange(len(h)) - np.repeat(at, size)).astype(np.uint64)
    ha, hb = (mix(np.add.reduceat(mix(h + (place + np.uint64(1)) * k), at) + size.astype(np.uint64)) for k in (K1, K3))
    of, begin = of[at], start[at] - base[of[at]]
    new = np.concatenate([[True], of[1:] != of[:-1]])
    begin[new] = 0
    last = np.append(new[1:], True)
    end = np.append(begin[1:], 0)
    end[last] = lens[of[last]]
    return of, begin, end, ha, hb


def _sliced(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about SLICE characters together, and where they start."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= SLICE):
            size += len(texts[hi] or "")
            hi += 1
        yield lo, [t or "" for t in texts[lo:hi]]
        lo = hi


def _runs(run: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in _sliced(b.column(2).to_pylist()):
                text, _, _, *hashes = parts(texts)
                n = max(len(text) - run + 1, 0)
                whole = np.flatnonzero(text[:n] == text[run - 1 :])
                first = np.searchsorted(text, text[whole])
                high, low = (mix(sum(mix(h[whole + j] + np.uint64((j + 1) * int(K1) & int(MOST))) for j in range(run))) for h in hashes)
                rows = pa.array(text[whole] + lo)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array((whole - first).astype(np.int32)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64))], names=["k", "h", "at", "high", "low"])

    return of


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """(k, h, runs): first sentences of each text's runs that occur earlier; k is the key, h a hash of the text.

    Earlier means a smaller key (nulls first), then a smaller hash, then nearer the text's start.
    """
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.col(text).alias("t"))
    found = lambda df: df.mapInArrow(_runs(run), f"k {kind}, h long, at int, high long, low long")
    some = durable(found(own.where(F.pmod(F.xxhash64("k", "h"), F.lit(SAMPLE)) == 0)).groupBy("high", "low").agg(F.count("*").alias("n")))
    total = some.agg(F.sum("n")).first()[0] or 0
    hot = some.where(F.col("n") > max(20, total * SHARE)).select("high", "low", F.lit(True).alias("hot"))
    runs = found(own).join(F.broadcast(hot), ["high", "low"], "left")
    runs = runs.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("k", "h", F.spark_partition_id()), F.lit(SALTS))).otherwise(0))
    place = F.rank().over(Window.partitionBy("high", "low", "salt").orderBy(F.col("k").asc_nulls_first(), "h", "at"))
    later = durable(runs.withColumn("place", place).where("place > 1 or hot"))
    # The first ones of a frequent run's salts are later ones as well, but for one.
    firsts = later.where("hot and place = 1").groupBy("high", "low").agg(F.min(F.struct("k", "h", "at")).alias("first"))
    is_first = F.col("k").eqNullSafe(F.col("first.k")) & (F.col("h") == F.col("first.h")) & (F.col("at") == F.col("first.at"))
    again = later.where("place > 1").select("k", "h", "at").unionAll(later.where("place = 1").join(F.broadcast(firsts), ["high", "low"]).where(~is_first).select("k", "h", "at"))
    return again.groupBy("k", "h").agg(F.sort_array(F.collect_set("at")).alias("runs"))


def _cut(run: int):
    def make(texts: list[str | None], runs: list[list[int] | None]) -> list:
        kept, gone = list(texts), [[] for _ in texts]
        todo = [i for i, r in enumerate(runs) if r]
        for lo, some in _sliced([texts[i] for i in todo]):
            of, begin, end, *_ = parts(some)
            edges = np.searchsorted(of, np.arange(len(some) + 1))
            for j, t in enumerate(some):
                i, a, b = todo[lo + j], begin[edges[j] : edges[j + 1]], end[edges[j] : edges[j + 1]]
                bad = np.zeros(len(a) + 2, bool)
                for k in range(run):
                    bad[np.asarray(runs[i]) + k + 1] = True
                at = np.flatnonzero(np.diff(bad.astype(np.int8)))
                flat = np.stack([a[at[::2]], b[at[1::2] - 1]], 1).ravel().tolist()
                cuts = [0, *flat, len(t)]
                kept[i], gone[i] = "".join(t[x:y] for x, y in zip(cuts[::2], cuts[1::2])), flat
        return [kept, gone]

    return make


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """docs with ``kept_text`` and ``removed`` (flat [start, end) pairs of code points of the removed spans).

    Rows stay one for one. A text of fewer than run sentences, null or empty, keeps what it
    has (null stays null). Rows alike in key and text count as one text: they keep or lose
    the same spans. Columns of docs with the result's names come out with ``_in`` appended.
    """
    names = ("kept_text", "removed", "runs_", "h_", "k_")
    docs = docs.withColumnsRenamed({c: f"{c}_in" for c in docs.columns if c.lower() in names})
    found = repeats(docs, key, text, run).select(F.col("k").alias("k_"), F.col("h").alias("h_"), F.col("runs").alias("runs_"))
    joined = docs.join(found, F.col(key).eqNullSafe(F.col("k_")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("h_")), "left").drop("k_", "h_")
    return mapped(joined, [text, "runs_"], "kept_text string, removed array<int>", _cut(run)).drop("runs_")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed, removed (start:end pairs, comma-joined), n_chars_kept, text (what is kept) of each document."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("removed") - 2, F.lit(2)), lambda i: F.concat_ws(":", F.get("removed", i), F.get("removed", i + 1)))
    said = F.when(F.size("removed") > 0, F.array_join(pairs, ",")).otherwise("")
    kept = dedup(docs.select("doc_id", "text"))
    return kept.select("doc_id", (F.size("removed") / 2).cast("long").alias("n_removed"), said.alias("removed"), F.length(F.coalesce("kept_text", F.lit(""))).cast("long").alias("n_chars_kept"), F.col("kept_text").alias("text"))
