"""Language of texts by a bidirectional gated recurrent network over bytes.

Windows of a text's bytes are read from both ends; at every position the two states give
probabilities of the learned languages, and a document gets the mean of those at its
letters. The network is trained in numpy by backpropagation through time over whole
windows, on a bounded sample of labelled documents, and broadcast for scoring.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import mapped

#: Bytes of a window, states a direction, windows that advance side by side.
WINDOW, HIDDEN, BATCH = 96, 16, 1024
#: What the network is fitted on, at most: languages (the most frequent ones), documents of all languages together, windows of a document.
LANGUAGES, SAMPLE, WINDOWS = 256, 2400, 3
EPOCHS, RATE = 4, 0.02
PAD = 256
UNKNOWN = "und"
latin_letter = re.compile("[A-Za-z]").search
UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def some_letter(text: str) -> bool:
    return bool(latin_letter(text)) or any(map(str.isalpha, text))


def folded(text: str) -> np.ndarray:
    """The UTF-8 bytes of a text, letters A-Z and Latin-1 capitals as small ones; as many bytes as the text has."""
    b = np.frombuffer(text.encode("utf-8", "replace").translate(UPPER), np.uint8).copy()
    if len(b) > 1:
        b[1:][(b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)] += 32
    return b


def windows(b: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """The bytes cut into rows of equal length; the last one ends with PAD."""
    out = np.full((-(-len(b) // size), size), PAD, np.int16)
    out.ravel()[: len(b)] = b
    return out


def lettered(ids: np.ndarray) -> np.ndarray:
    return ((ids >= 97) & (ids <= 122) | (ids >= 128) & (ids < PAD)).astype(np.float32)


def bent(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: between -1 and 1 as tanh, at a fifth of its cost; its slope is (1 - |y|)^2."""
    size = np.abs(x)
    size += 1
    x /= size
    return x


@dataclass
class Network:
    """Gates r and z, (1 + bent) / 2, and the new state n of each direction: n = bent(x + r * (U h + b)), h' = n + z * (h - n).

    Arrays hold windows side by side in their last axis.
    """

    names: list[str]
    x: np.ndarray  # 2 x 3H x 257: what a byte adds to r, z and n
    u: np.ndarray  # 2 x 3H x H
    b: np.ndarray  # 2 x H x 1
    v: np.ndarray  # languages x 2H
    c: np.ndarray  # languages x 1

    @staticmethod
    def new(names: list[str], hidden: int = HIDDEN, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        some = lambda *shape, by=1.0: (rng.standard_normal(shape) * by).astype(np.float32)
        x = some(2, 3 * hidden, PAD + 1, by=0.3)
        x[:, hidden : 2 * hidden] += 1  # states are kept rather than replaced at first
        return Network(names, x, some(2, 3 * hidden, hidden, by=hidden**-0.5), np.zeros((2, hidden, 1), np.float32), some(len(names), 2 * hidden, by=0.3), np.zeros((len(names), 1), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.x, self.u, self.b, self.v, self.c]

    def states(self, ids: np.ndarray, trace: list | None = None) -> np.ndarray:
        """(2, H, length, rows): the state after each position, read forwards and backwards; no state outlives PAD."""
        rows, length = ids.shape
        k = self.u.shape[2]
        out, h = np.empty((2, k, length, rows), np.float32), np.zeros((2, k, rows), np.float32)
        x, g, read = np.empty((2, 3 * k, rows), np.float32), np.empty((2, 3 * k, rows), np.float32), np.ascontiguousarray(ids.T)
        live = (read != PAD).astype(np.float32)
        full = live.all(axis=1)
        for t in range(length):
            for d, at in enumerate((t, length - 1 - t)):
                np.take(self.x[d], read[at], axis=1, out=x[d], mode="clip")
            np.matmul(self.u, h, out=g)
            rz = g[:, : 2 * k] + x[:, : 2 * k]
            bent(rz)
            rz *= 0.5
            rz += 0.5
            hn = g[:, 2 * k :] + self.b
            n = hn * rz[:, :k]
            n += x[:, 2 * k :]
            bent(n)
            if trace is not None:
                trace.append((h, rz, hn, n))
            h = h - n
            h *= rz[:, k:]
            h += n
            for d, at in enumerate((t, length - 1 - t)):
                if not full[at]:
                    h[d] *= live[at]
                out[d, :, at] = h[d]
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(languages, length, rows)"""
        s = self.v @ states.reshape(self.v.shape[1], -1)
        s += self.c
        s -= s.max(axis=0)
        np.exp(s, out=s)
        s /= s.sum(axis=0)
        return s.reshape(-1, *states.shape[2:])

    def gradients(self, ids: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions that aren't PAD, and its gradients, back through the whole window."""
        rows, length = ids.shape
        k, trace = self.u.shape[2], []
        states = self.states(ids, trace)
        p = self.probabilities(states)
        live = (ids != PAD).T.astype(np.float32)
        weight, own = live / max(live.sum(), 1), np.arange(rows)
        loss = float(-(np.log(np.maximum(p[y, :, own], 1e-12)).T * weight).sum())
        p[y, :, own] -= 1
        p *= weight
        flat = p.reshape(len(p), -1)
        dv = flat @ states.reshape(2 * k, -1).T
        into = (self.v.T @ flat).reshape(2, k, length, rows)
        du, db, dx = np.zeros_like(self.u), np.zeros_like(self.b), np.empty((2, 3 * k, length, rows), np.float32)
        back = np.zeros((2, k, rows), np.float32)
        for t in range(length - 1, -1, -1):
            h, rz, hn, n = trace[t]
            r, z, at = rz[:, :k], rz[:, k:], (t, length - 1 - t)
            dh = np.stack([(back[d] + into[d, :, at[d]]) * live[at[d]] for d in (0, 1)])
            dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
            dg = np.concatenate([dn * hn, dh * (h - n), dn], axis=1)
            dg[:, : 2 * k] *= 0.5 * (1 - np.abs(2 * rz - 1)) ** 2
            for d in (0, 1):
                dx[d, :, at[d]] = dg[d]
            dg[:, 2 * k :] *= r
            du += dg @ h.transpose(0, 2, 1)
            db += dg[:, 2 * k :].sum(axis=2, keepdims=True)
            back = dh * z + self.u.transpose(0, 2, 1) @ dg
        one = np.zeros((length * rows, PAD + 1), np.float32)
        one[np.arange(length * rows), ids.T.ravel()] = 1
        return loss, [dx.reshape(2, 3 * k, -1) @ one, du, db, dv, flat.sum(axis=1, keepdims=True)]

    def train(self, ids: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, rows: int = 192, seed: int = 5) -> list[float]:
        """Adam with a falling rate over shuffled batches; the losses."""
        rng, losses, steps = np.random.default_rng(seed), [], max(1, epochs * -(-len(y) // rows))
        one, two = ([np.zeros_like(p) for p in self.parameters()] for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), rows):
                loss, grads = self.gradients(ids[order[lo : lo + rows]], y[order[lo : lo + rows]])
                losses.append(loss)
                i = len(losses)
                size = np.sqrt(sum(float((g * g).sum()) for g in grads))
                for p, g, m, v in zip(self.parameters(), grads, one, two):
                    g *= min(1.0, 1.0 / max(size, 1e-12))
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (1 - 0.9 * i / steps) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        return losses

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        """Mean probabilities over the letters of each text's bytes; a text without letters gets zeros."""
        sums, letters = np.zeros((len(texts), len(self.names))), np.zeros(len(texts))
        cut = [windows(b) for b in texts]
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in cut])
        every = np.concatenate(cut) if cut else np.zeros((0, WINDOW), np.int16)
        for lo in range(0, len(every), BATCH):
            ids, own = every[lo : lo + BATCH], owner[lo : lo + BATCH]
            weight = lettered(ids).T
            p = self.probabilities(self.states(ids))
            p *= weight
            np.add.at(sums, own, p.sum(axis=1).T)
            np.add.at(letters, own, weight.sum(axis=0))
        return sums / np.maximum(letters, 1)[:, None]

    def labels(self, b: np.ndarray) -> np.ndarray:
        """The likeliest language at each byte."""
        ids = windows(b)
        parts = [self.probabilities(self.states(ids[lo : lo + BATCH])).argmax(axis=0).T.ravel() for lo in range(0, len(ids), BATCH)]
        return np.concatenate(parts)[: len(b)] if parts else np.zeros(0, np.int64)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose language the network may not learn from; a null id is never held out (nor learned from)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _cuts(most: int) -> Callable[[list], list]:
    """Up to so many windows of a text, evenly spread over all it has."""

    def make(texts: list[str]) -> list:
        out = []
        for t in texts:
            w = windows(folded(t))
            out.append([row[row != PAD].astype(np.uint8).tobytes() for row in w[np.unique(np.linspace(0, len(w) - 1, min(most, len(w))).round().astype(int))]])
        return [out]

    return make


def fit(docs: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text", sample: int = SAMPLE, epochs: int = EPOCHS) -> Network | None:
    """A network for the LANGUAGES most frequent values of lang, learned from at most ``sample`` documents, as many of each as there are.

    Only rows with key, lang and a text with a letter, which aren't held out, are learned from; which ones, a hash of
    the key and text decides. The driver gets their windows, at most WINDOWS of WINDOW bytes each. None without any.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & ~held_out(key) & F.col(text).rlike(r"\p{L}")).select(F.col(key).alias("k"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        return None
    names, each = sorted(sizes), max(1, sample // len(sizes))
    # Rows are first thinned by a hash to about four times what is wanted, so that no group grows with the table.
    share = F.create_map(*(F.lit(v) for n in names for v in (n, int(min(1.0, 4 * each / sizes[n]) * 1e6) + 50)))
    some = known.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < F.try_element_at(share, F.col("lang")))
    cut = mapped(some, ["t"], "w array<binary>", _cuts(WINDOWS), keep=False)
    first = cut.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("k", F.lit(1)), "k", "w"))).where(F.col("place") <= each)
    rows = first.select("lang", "k", F.posexplode("w").alias("i", "w")).toArrow().sort_by([("k", "ascending"), ("i", "ascending"), ("w", "ascending")])
    ids = np.concatenate([windows(np.frombuffer(w, np.uint8)) for w in rows["w"].to_pylist()])
    at = {n: i for i, n in enumerate(names)}
    net = Network.new(names)
    if len(names) > 1:
        net.train(ids, np.array([at[x] for x in rows["lang"].to_pylist()]), epochs)
    return net


def identify(docs: DataFrame, net: Network | None, text: str = "text", runs: bool = False) -> DataFrame:
    """docs with ``lang_pred`` and ``score``, its mean probability over the text's letters; runs: also ``lang_runs``.

    lang_runs labels every position: (begin, end, lang) of each run of characters of one likeliest language. A null text,
    one without a letter, and all texts without a network get "und", score 0 and no runs. Rows stay one for one;
    columns of docs with one of the names come out with ``_in`` appended.
    """
    fields = "lang_pred string, score double" + ", lang_runs array<struct<begin:int,end:int,lang:string>>" * runs
    names = [f.split()[0] for f in fields.split(", ")]
    clash = {c: f"{c}_in" for c in docs.columns if c.lower() in names}
    docs, text = docs.withColumnsRenamed(clash), clash.get(text, text)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def runs_of(net: Network, t: str, b: np.ndarray) -> list[dict]:
        own = net.labels(b)[(b & 0xC0) != 0x80]  # a character has the label of its first byte
        edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        return [{"begin": lo, "end": hi, "lang": net.names[own[lo]]} for lo, hi in zip(edges, edges[1:])]

    def make(texts: list[str | None]) -> list:
        net: Network | None = shared.value
        said = [bool(net and t and some_letter(t)) for t in texts]
        bytes_of = [folded(t) for t, ok in zip(texts, said) if ok]
        p = net.pooled(bytes_of) if bytes_of else np.zeros((0, 1))
        best = iter(zip(p.argmax(axis=1).tolist(), np.clip(p.max(axis=1, initial=0), 0, 1).tolist()))
        made = [(net.names[(x := next(best))[0]], x[1]) if ok else (UNKNOWN, 0.0) for ok in said]
        out = [[m[0] for m in made], [m[1] for m in made]]
        if runs:
            left = iter(bytes_of)
            out.append([runs_of(net, t, next(left)) if ok else [] for t, ok in zip(texts, said)])
        return out

    return mapped(docs, [text], fields, make, keep=runs)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""
    got = identify(docs.select("doc_id", "text"), fit(docs))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
