"""Toxicity by a support vector machine with a gapped-subsequence string kernel over sentences.

A sentence is compared through its subsequences of three characters, across word borders
too, gaps damped by ``DECAY`` for each character skipped, so that inserted, missing or
spaced-out characters cost a little instead of all. As an insult is a small part of its
sentence, a sentence is seen through all its windows of ``WIDTH`` starting characters; it
is as toxic as its worst window, and a text as its worst sentence. Landmark windows give
the Nyström map in which the machine is trained.

Training sentences are labelled by their texts; which window of a toxic text's sentences
teaches is first decided by words whose contexts are toxic far more often than others,
then by the machine itself. Clean texts' sentences teach by their worst windows.

The machine is linear over landmarks and the kernel linear over subsequences, so that a
trained machine folds into one weight per (hashed) subsequence, and a text's windows are
running sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import durable, held_out, labelled, mapped

DECAY, SPAN = 0.5, 6
TABLE_BITS = 20
#: Characters at which a window's subsequences start; they end up to SPAN - 1 characters later.
WIDTH = 12
LANDMARKS = 512
#: Windows the machine is fitted on, at most, per class and source; characters that are scored side by side.
WINDOWS, SLICE = 3000, 1 << 16
#: Labelled rows learnt from, at most, per class.
PER_CLASS = 8000
LEAST = -9.0
PATTERNS = [(d1, d2, DECAY ** (d2 - 2)) for d2 in range(2, SPAN) for d1 in range(1, d2)]
NORM = (WIDTH * sum(w * w for *_, w in PATTERNS)) ** 0.5
#: Between sentences, so that no window reaches into the next one.
END = "\0" * WIDTH
_ends = re.compile(r"[.!?]+\s+|\n+|[.!?]+$")
_marks = re.compile(r"[^\w\s\0]|_")
_spaced = re.compile(r"(?<!\S)(?:\S[^\S\0]){2,}\S(?!\S)")


def plain(text: str | None) -> str:
    """The sentences of a text, ends padded: lower-cased, marks inside words removed, letters set apart by spaces joined, single spaces."""
    flat = _marks.sub("", _ends.sub("\0", (text or "").replace("\0", " ").lower()))
    flat = _spaced.sub(lambda m: "".join(m.group().split()), flat)
    return "".join(f" {' '.join(s.split())} {END}" for s in flat.split("\0") if s.strip())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def hashed(chars: np.ndarray, d1: int, d2: int) -> np.ndarray:
    """Hashes of the subsequences at offsets 0, d1, d2 of each place (last axis) but the last SPAN - 1."""
    n = chars.shape[-1] - SPAN + 1
    h = (chars[..., :n] * np.uint32(0x9E3779B1) ^ chars[..., d1 : n + d1]) * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(15)
    h = (h ^ chars[..., d2 : n + d2]) * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(13)
    return (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - TABLE_BITS)


def margins(chars: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of each window's subsequence weights; a window is named by its first character."""
    out = np.empty(max(len(chars) - SPAN + 1, 0))
    for lo in range(0, len(out), SLICE):
        part = chars[lo : lo + SLICE + WIDTH + SPAN - 2]
        v = np.zeros(len(part) - SPAN + 1, np.float32)
        for d1, d2, w in PATTERNS:
            v += table[hashed(part, d1, d2)] * np.float32(w)
        v[part[: len(v)] == 0] = 0
        total = np.concatenate([[0.0], np.cumsum(v, dtype=np.float64)])
        n = min(SLICE, len(out) - lo)
        out[lo : lo + n] = total[np.minimum(np.arange(n) + WIDTH, len(v))] - total[:n]
    return out / NORM


def kernel(some: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel of windows (strings of at most WIDTH + SPAN - 1 characters) with landmark windows."""

    def entries(ws: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chars = codes("".join(w.ljust(WIDTH + SPAN - 1, "\0") for w in ws)).reshape(len(ws), -1)
        row, col = np.nonzero(chars[:, :WIDTH])
        hs = np.concatenate([hashed(chars, d1, d2)[row, col] for d1, d2, _ in PATTERNS])
        weight = np.repeat(np.array([w / NORM**0.5 for *_, w in PATTERNS], np.float32), len(row))
        row = np.tile(row, len(PATTERNS))
        order = np.argsort(row, kind="stable")
        return row[order], hs[order], weight[order]

    row, h, w = entries(landmarks)
    known, col = np.unique(h, return_inverse=True)
    table = np.zeros((len(known) + 1, len(landmarks)), np.float32)  # the last row stands for subsequences of no landmark
    np.add.at(table, (col, row), w)
    out = np.zeros((len(some), len(landmarks)))
    for lo in range(0, len(some), 200):
        row, h, w = entries(some[lo : lo + 200])
        if len(row):
            at = np.searchsorted(known, h)
            at[known[np.minimum(at, len(known) - 1)] != h] = len(known)
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            out[lo + row[first]] = np.add.reduceat(table[at] * w[:, None], first)
    return out


def folded(landmarks: list[str], weights: np.ndarray) -> np.ndarray:
    """One table of subsequence weights for a weighted sum of landmarks."""
    table = np.zeros(1 << TABLE_BITS)
    chars = codes("".join(w.ljust(WIDTH + SPAN - 1, "\0") for w in landmarks)).reshape(len(landmarks), -1)
    row, col = np.nonzero(chars[:, :WIDTH])
    for d1, d2, w in PATTERNS:
        np.add.at(table, hashed(chars, d1, d2)[row, col], w * weights[row])
    return table.astype(np.float32)


@dataclass
class Model:
    table: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def worst(self, texts: list[str | None]) -> list[tuple[float, str]]:
        """The largest margin of each text's windows and that window (the first of equal ones); without words LEAST and none."""
        flat = [plain(t) for t in texts]
        out, lo = [(LEAST, "")] * len(flat), 0
        while lo < len(flat):
            hi, size = lo, 0
            while hi < len(flat) and (hi == lo or size + len(flat[hi]) <= 32 * SLICE):
                size += len(flat[hi])
                hi += 1
            chars = codes("".join(flat[lo:hi]))
            m = margins(np.concatenate([chars, np.zeros(SPAN - 1, np.uint32)]), self.table)
            m[chars == 0] = -np.inf  # a window starts in its own sentence
            ends = np.cumsum([len(t) for t in flat[lo:hi]])
            for k, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
                if b > a:
                    top = int(np.argmax(m[a:b]))
                    out[lo + k] = (float(m[a + top] + self.bias), flat[lo + k][top : top + WIDTH + SPAN - 1])
            lo = hi
        return out


def _worst(docs: DataFrame, model: Model, text: str, fields: str) -> DataFrame:
    """docs with the margin, and the window if fields has two, of each text's worst window."""
    shared, n = docs.sparkSession.sparkContext.broadcast(model), fields.count(",") + 1

    def make(texts: list[str | None]) -> list:
        return [list(x) for x in zip(*shared.value.worst(texts))][:n] if texts else [[]] * n

    return mapped(docs, [text], fields, make)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights (last one the bias) of a squared-hinge machine, by Newton steps on its active examples."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    loss = lambda v: v @ ridge @ v + (cost * np.maximum(1 - y * (x @ v), 0) ** 2).sum()
    for _ in range(steps):
        on = y * (x @ w) < 1
        xo, co = x[on], cost[on][:, None]
        full = np.linalg.solve(ridge + xo.T @ (co * xo), xo.T @ (co[:, 0] * y[on]))
        rate, old = 1.0, loss(w)
        while rate > 1e-3 and loss(w + rate * (full - w)) > old:
            rate /= 2
        w, done = w + rate * (full - w), old - loss(w + rate * (full - w)) < 1e-6 * old
        if done:
            break
    return w


def _train(landmarks: list[str], some: list[str], y: np.ndarray, cost: float = 8.0) -> Model:
    k_ll = kernel(landmarks, landmarks)
    values, vectors = np.linalg.eigh((k_ll + k_ll.T) / 2)
    good = values > 1e-6 * values.max()
    to_map = vectors[:, good] / np.sqrt(values[good])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
    w = _svm(kernel(some, landmarks) @ to_map, y, cost * share)
    return Model(folded(landmarks, to_map @ w[:-1]), float(w[-1]))


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 2.0, 0.0
    margin = np.clip(margin, LEAST, -LEAST)
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        g, h = p - t, np.maximum(p * (1 - p), 1e-6)
        x = np.stack([margin, np.ones_like(margin)])
        step = np.linalg.solve((x * h) @ x.T + 1e-3 * np.eye(2), x @ g)
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.0)), float(b)


def _telling(train: DataFrame) -> list[str]:
    """Words that stand in toxic texts far more often than others do, at most WINDOWS of them.

    A word counts once for each different word before it, so that copies of a text count like one text.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {(w, before, y) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for ws in [plain(t).replace("\0", "").split()] for before, w in zip(["", *ws], ws)}
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32()))], names=["w", "b", "y"])

    seen = train.select("t", "y").mapInArrow(pairs, "w string, b string, y int").distinct().groupBy("w").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    seen = durable(seen.where("p > 0"))
    rates = train.agg(F.avg("y")).first()[0] or 0.0
    rate = min(0.5, max(1e-3, rates))
    z = (F.col("p") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate) + 1)
    scored = seen.withColumn("z", z)
    bad = [r.w for r in scored.where("z > 3 and p >= 4 and 10 * p >= 9 * n").orderBy(F.desc("z"), "w").limit(WINDOWS).collect()]
    return bad or [r.w for r in scored.orderBy(F.desc("z"), "w").limit(1).collect()]


def _labelled_windows(train: DataFrame, bad: list[str]) -> tuple[list[str], list[str]]:
    """Windows around telling words in toxic texts' sentences, and one window of each clean text, each at most WINDOWS, by hash."""
    shared = train.sparkSession.sparkContext.broadcast(frozenset(bad))

    def make(texts: list[str], ys: list[int]) -> list:
        out = []
        for t, y in zip(texts, ys):
            flat = plain(t)
            if y:
                at = {w: m.start() for m in re.finditer(r"[^\s\0]+", flat) if (w := m.group()) in shared.value}
                out.append([flat[max(i - 1, 0) : max(i - 1, 0) + WIDTH + SPAN - 1] for i in at.values()])
            else:
                starts = [m.start() for m in re.finditer(" (?! |\0)", flat)]
                out.append([flat[i : i + WIDTH + SPAN - 1] for i in starts[len(starts) // 2 :][:1]])
        return [out]

    rows = mapped(train, ["t", "y"], "w array<string>", make).select("y", F.explode("w").alias("w")).distinct()
    pick = lambda y: [r.w for r in rows.where(F.col("y") == y).orderBy(F.xxhash64("w"), "w").limit(WINDOWS).collect()]
    return pick(1), pick(0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", rounds: int = 3, per_class: int = PER_CLASS) -> Model:
    """Learn from at most per_class labelled rows of each class (see labelled()), all of which every round looks at.

    The driver gets a bounded number of words and windows. Without labels of both classes every text gets the prior.
    """
    sample, sizes = labelled(docs, labels, label, per_class, key, text)
    prior = lambda: (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    train = durable(sample) if len(sizes) > 1 else None
    if train is None or train.select("y").distinct().count() < 2:
        return Model(np.zeros(1 << TABLE_BITS, np.float32), 0.0, 0.0, float(np.log(prior() / (1 - prior()))))
    bad = _telling(train)
    telling = frozenset(bad)
    pos, neg = (set(x) for x in _labelled_windows(train, bad))
    hard: list[str] = []
    half = LANDMARKS // 2
    for k in range(rounds + 1):
        some = sorted(pos) + sorted(neg - pos)
        clean = [*hard[: half // 2], *sorted(neg)[:: max(1, len(neg) // half)]][:half]
        landmarks = list(dict.fromkeys([*sorted(pos)[:: max(1, len(pos) // half)][:half], *clean])) or [" "]
        model = _train(landmarks, some, np.array([1.0] * len(pos) + [-1.0] * len(neg - pos))) if some else Model(np.zeros(1 << TABLE_BITS, np.float32), 0.0)
        rows = _worst(train.select("y", "t"), model, "t", "margin double, w string").select("y", "margin", "w").collect()
        if k == rounds:
            break
        # A clean text's worst window teaches unless it holds a telling word, which speaks of a wrong label.
        near = {r.w: r.margin for r in rows if not r.y and r.margin > -1 and not telling.intersection(r.w.replace("\0", "").split())}
        hard = sorted(near, key=lambda w: (-near[w], w))[:WINDOWS]
        neg |= set(hard)
        pos -= neg
    model.slope, model.offset = _platt(np.array([r.margin for r in rows]), np.array([r.y for r in rows], float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with ``score``, 0 to 1, higher where label 1 is likelier.

    Null, empty and wordless texts get the least score; rows stay one for one. A column of
    docs that is named as the score comes out with ``_in`` appended.
    """
    clash = {c: f"{c}_in" for c in docs.columns if c.lower() in (out.lower(), "margin_")}
    docs, text = docs.withColumnsRenamed(clash), clash.get(text, text)
    z = F.lit(model.slope) * F.least(F.greatest("margin_", F.lit(LEAST)), F.lit(-LEAST)) + F.lit(model.offset)
    return _worst(docs, model, text, "margin_ double").withColumn(out, 1 / (1 + F.exp(-z))).drop("margin_")


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
