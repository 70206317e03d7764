"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 13 consecutive words of the benchmark items (an item
of fewer words is one shorter pattern). A block is the last two words under the
search window: the shift table says how far the window may jump, a zero shift
opens the bucket of patterns with that suffix hash, and direct comparison of the
words confirms an occurrence. Many windows advance side by side in numpy.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import durable, mapped

WINDOW = 13
TABLE_BITS = 18
#: Windows of the benchmark searched for in one pass, which bounds the broadcast; more items take more passes.
PASS_WINDOWS = 200_000
LANE, SLICE = 1024, 1_000_000
words_of = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of ASCII digits, letters and all characters beyond ASCII."""
    return words_of((text or "").encode("utf-8", "replace").lower())


class Patterns:
    """Shift tables and suffix buckets for the windows of some items, by window length."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, ws in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in ws]
            m = min(window, len(w))
            for i in range(len(w) - m + 1) if m else ():
                found[m][tuple(w[i : i + m])].add(item)
        self.groups = [self._tables(m, group) for m, group in sorted(found.items())]

    @staticmethod
    def hashed(last: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        h = last.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if before is not None:
            h ^= (before.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            h *= np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _tables(self, m: int, group: dict[tuple[int, ...], set[str]]) -> dict:
        pats = np.array(list(group), np.int32).reshape(-1, m)
        items = [sorted(x) for x in group.values()]
        block = min(2, m)
        shift = np.full(1 << TABLE_BITS, m - block + 1, np.int16)
        for end in range(block, m + 1):  # blocks nearer the end allow less of a jump
            np.minimum.at(shift, self.hashed(pats[:, end - 1], pats[:, end - 2] if block == 2 else None), m - end)
        suffix = self.hashed(pats[:, -1], pats[:, -2] if block == 2 else None)
        order = np.argsort(suffix, kind="stable")
        starts = np.searchsorted(suffix[order], np.arange((1 << TABLE_BITS) + 1)).astype(np.int32)
        return {"m": m, "block": block, "shift": shift, "pats": pats[order], "items": [items[i] for i in order], "starts": starts}

    def search(self, ids: np.ndarray, g: dict) -> tuple[np.ndarray, np.ndarray]:
        """Last positions of all occurrences in ids, and the patterns that occur there."""
        m, block, n = g["m"], g["block"], len(ids)
        lanes = np.arange(m - 1, n, LANE)
        ends, hits = np.minimum(lanes + LANE, n), []
        while len(lanes):
            h = self.hashed(ids[lanes], ids[lanes - 1] if block == 2 else None)
            jump = g["shift"][h].astype(np.int64)
            if (zero := jump == 0).any():
                hits.append((lanes[zero], h[zero]))
                jump[zero] = 1
            lanes = lanes + jump
            go = lanes < ends
            lanes, ends = lanes[go], ends[go]
        if not hits:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, h = (np.concatenate(x) for x in zip(*hits))
        out_at, out_pat = [], []
        counts = g["starts"][h + 1] - g["starts"][h]
        edges = np.concatenate([[0], np.cumsum(counts)])
        lo = 0
        while lo < len(at):  # compare directly, at most about a slice of candidates at once
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + SLICE // m, "right")) - 1)
            c = counts[lo:hi]
            pos = np.repeat(at[lo:hi], c)
            pat = np.repeat(g["starts"][h[lo:hi]], c) + np.arange(c.sum()) - np.repeat(edges[lo:hi] - edges[lo], c)
            same = np.ones(len(pos), bool)
            for k in range(m):
                keep = np.flatnonzero(same)
                same[keep] = ids[pos[keep] - k] == g["pats"][pat[keep], m - 1 - k]
            out_at.append(pos[same])
            out_pat.append(pat[same])
            lo = hi
        return np.concatenate(out_at), np.concatenate(out_pat)


def _runs(starts: np.ndarray, ends: np.ndarray, n: int) -> list[int]:
    """Word positions covered by any of the spans, as flat [from, to) pairs in order."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    cover = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    return np.flatnonzero(np.diff(cover)).tolist()


def _tables(shared, window: int, known: dict = {}) -> Patterns:  # noqa: B006 - the worker's memory of its last part
    """The tables of a part of the benchmark, built once per worker; a token tells the parts apart, as memory addresses come back."""
    token, items = shared.value
    if (key := (token, window)) not in known:
        known.clear()
        known[key] = Patterns([(i, words(t)) for i, t in items], window)
    return known[key]


def _search(shared, window: int):
    def make(texts: list[str | None], *earlier: list) -> list:
        patterns = _tables(shared, window)
        get = patterns.ids.get
        hits, items, counts = [], [], []
        lo = 0
        while lo < len(texts):  # documents side by side, a zero word between them
            parts, lens, total, hi = [], [], 0, lo
            while hi < len(texts) and total < SLICE:
                ws = words(texts[hi])
                parts.append(np.fromiter((get(w, 0) for w in ws), np.int32, len(ws)))
                lens.append(len(ws))
                total += len(ws) + 1
                hi += 1
            ids = np.concatenate([x for p in parts for x in (p, np.zeros(1, np.int32))])
            base = np.concatenate([[0], np.cumsum(np.array(lens) + 1)])
            got: dict[int, list] = defaultdict(list)
            for g in patterns.groups:
                at, pat = patterns.search(ids, g)
                doc = np.searchsorted(base, at, "right") - 1
                order = np.argsort(doc, kind="stable")
                for d, a, p in zip(*(np.split(x[order], np.flatnonzero(np.diff(doc[order])) + 1) for x in (doc, at, pat))) if len(at) else ():
                    got[int(d[0])].append((a - base[d[0]], np.unique(p), g))
            for k, n in enumerate(lens):
                here = got.get(k, [])
                hits.append(_runs(np.concatenate([a - g["m"] + 1 for a, _, g in here]), np.concatenate([a + 1 for a, _, g in here]), n) if here else [])
                items.append(sorted({i for _, ps, g in here for p in ps for i in g["items"][p]}))
                counts.append(n)
            lo = hi
        if earlier:  # a later pass adds to what earlier ones found
            for k, (old, o) in enumerate(zip(*earlier)):
                if old:
                    both = np.array([*old, *hits[k]], np.int64)
                    hits[k] = _runs(both[::2], both[1::2], counts[k])
                items[k] = sorted({*o, *items[k]})
        return [hits, items, counts]

    return make


#: Words of a benchmark text that are handled as one piece; longer texts are cut into overlapping pieces.
PIECE = 20_000


def _pieces(window: int):
    """Items as pieces of a bounded number of words, alike windows as in the whole text; short items as they are."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(*(c.to_pylist() for c in b.columns)):
                ws = words(t)
                step = max(PIECE - window + 1, 1)
                for n, lo in enumerate(range(0, max(len(ws) - window + 1, 1), step)) if ws else ():
                    part = ws[lo : lo + PIECE]
                    rows.append((i, n, len(part), b" ".join(part).decode("utf-8", "replace")))
            yield pa.RecordBatch.from_pylist([dict(zip(("i", "n", "size", "t"), r)) for r in rows], pa.schema([("i", pa.string()), ("n", pa.int32()), ("size", pa.int32()), ("t", pa.string())]))

    return of


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with ``hit_words`` (flat [from, to) pairs of word positions inside an occurring
    window), ``hit_items`` (ids as strings, sorted as strings) and ``n_words``.

    Rows stay one for one, repeats included. A null or wordless text has no words and no
    hits; items of null id, null text or no words never occur; an empty benchmark hits
    nothing. Columns of docs with one of the three names come out with ``_in`` appended.

    Tasks cut the benchmark's texts into words and pieces, which a hash deals to as many passes as keep a
    pass below about PASS_WINDOWS words. Workers build a pass's tables from its broadcast words. Passes but
    the last are written to the shared folder, so that a task holds the tables of one pass only.
    """
    names = ["hit_words", "hit_items", "n_words"]
    clash = {c: f"{c}_in" for c in docs.columns if c.lower() in names}
    docs, text = docs.withColumnsRenamed(clash), clash.get(text, text)
    given = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    pieces = durable(given.mapInArrow(_pieces(window), "i string, n int, size int, t string"))
    passes = max(1, -(-(pieces.agg(F.sum("size")).first()[0] or 0) // PASS_WINDOWS))
    own = docs.columns
    for k in range(passes):
        part = pieces.where(F.pmod(F.xxhash64("i", "n", "t"), F.lit(passes)) == k).select("i", "t").distinct().collect()
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in part]))
        if k:
            held = durable(docs.withColumnsRenamed({n: f"{n}_before" for n in names}))
            docs = mapped(held, [text, "hit_words_before", "hit_items_before"], "hit_words array<int>, hit_items array<string>, n_words long", _search(shared, window)).select(*own, *names)
        else:
            docs = mapped(docs, [text], "hit_words array<int>, hit_items array<string>, n_words long", _search(shared, window))
    return docs


def _n_hit():
    pairs = F.col("hit_words")
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(pairs), F.lit(2)) - 2, F.lit(2)), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.try_element_at(pairs, i + 2) - F.try_element_at(pairs, i + 1), F.lit(0)))


def contaminated():
    """At least a twentieth of the words lies in benchmark windows."""
    return (_n_hit() > 0) & (20 * _n_hit() >= F.col("n_words"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    found = find(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", "n_words", _n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def brute_force(texts: list[str | None], items: list[tuple[str, str | None]], window: int = WINDOW) -> list[tuple]:
    """The contract word by word, for tests: (n_words, n_hit, n_items, items_sha256, contaminated)."""
    out = []
    for t in texts:
        ws, hit, found = words(t), set(), set()
        for item, it in items:
            iw = words(it)
            m = min(window, len(iw))
            for i in range(len(iw) - m + 1) if m else ():
                for j in range(len(ws) - m + 1):
                    if ws[j : j + m] == iw[i : i + m]:
                        hit.update(range(j, j + m))
                        found.add(item)
        out.append((len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)))
    return out
