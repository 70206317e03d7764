"""SentencePiece BPE encoding and decoding through a merge-type prefix table.

For every prefix of a chunk of text the table keeps the one token that ends the
prefix's encoding. An automaton over the vocabulary lists the tokens that end at
each position; the right one is the one that is pair-compatible with the last
token of the prefix before it. The ids are then recovered from the end backwards.

Chunks: no piece has a space after another character, nor certain marks after a
letter, so the text falls apart there; a worker encodes each distinct chunk once.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from larkspur.llm.common import mapped

SPACE = "▁"
#: Distinct chunks of one generation in a worker's memo; the one before it is kept, so that frequent chunks stay.
MEMO = 150_000


def load_pieces(model_path: str) -> tuple[list[str], list[float], list[int]]:
    """Pieces, scores and types (1 normal, 2 unknown, 3 control, 6 byte) by id."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as f:
        proto.ParseFromString(f.read())
    out = [p.piece for p in proto.pieces], [p.score for p in proto.pieces], [p.type for p in proto.pieces]
    check_model(proto.trainer_spec.model_type, proto.normalizer_spec, *out)
    return out


def check_model(kind: int, rules, pieces: list[str], scores: list[float], types: list[int]) -> None:
    """Raises ValueError for a model that the prefix table would not encode as its library does.

    It has to be a BPE model without normaliser rules (only the space put in front and the visible space mark),
    without user-defined pieces, whose pieces of spaces alone share one score, the lowest of all.
    """
    if kind != 2:
        raise ValueError("not a BPE model")
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
        raise ValueError("models with normaliser rules are not supported")
    if 4 in types:
        raise ValueError("user-defined pieces are not supported")
    if types.count(6) != 256:
        raise ValueError("models without a piece for every byte are not supported, as the library joins neighbouring unknowns there")
    blank = {s for p, s, t in zip(pieces, scores, types) if t == 1 and len(p) > 1 and not p.strip(SPACE)}
    longer = [s for p, s, t in zip(pieces, scores, types) if t == 1 and len(p) > 1 and p.strip(SPACE)]
    if len(blank) > 1 or blank and longer and min(blank) > min(longer):
        raise ValueError("pieces of spaces must share the lowest score")


def merge_all(symbols: list[str], rank: dict[str, float]) -> list[str]:
    """Plain merging: the best-scored adjacent pair first, the leftmost among equals."""
    text, n = list(symbols), len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and (s := rank.get(text[i] + text[j])) is not None:
            heapq.heappush(heap, (-s, i, j, text[i] + text[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, joined = heapq.heappop(heap)
        if after[i] != j or text[i] + text[j] != joined:
            continue
        text[i], text[j] = joined, ""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        after[j] = -2
        offer(before[i], i)
        offer(i, after[i])
    return [t for t in text if t]


class PrefixTable:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, pieces: list[str], scores: list[float], types: list[int]):
        import ahocorasick

        self.pieces, self.types = pieces, types
        self.rank = {p: s for p, s, t in zip(pieces, scores, types) if t == 1}
        self.ids = {p: i for i, (p, t) in enumerate(zip(pieces, types)) if t == 1}
        self.said = {p: str(i) for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(pieces, types)) if t == 6}
        self.unknown = next((i for i, t in enumerate(types) if t == 2), 0)
        # Marks that no piece has after a letter or digit: a word ends in front of them.
        after = {p[i + 1] for p in self.rank for i in range(len(p) - 1) if re.match(r"\w", p[i])}
        marks = "".join(re.escape(c) for c in sorted({c for p in self.rank for c in p} - after) if not re.match(r"\w", c) and c != SPACE)
        self.automaton = ahocorasick.Automaton()
        for p in self.rank:
            if len(p) > 1 and p.strip(SPACE):
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[str, str], bool] = {}
        self.chunks: dict[str, tuple[int, str, str]] = {}
        self.older = self.chunks
        self.runs: dict[int, tuple[str, ...]] = {}
        # A chunk is a run of spaces and what follows it up to the next one, or to a mark that ends a word.
        self.split = re.compile((f"{SPACE}*\\w++(?=[{marks}])|" if marks else "") + f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def fits(self, left: str, right: str) -> bool:
        """Whether left and right stay as they are when merged side by side."""
        key = (left, right)
        if (known := self.compatible.get(key)) is None:
            if len(self.compatible) > MEMO:
                self.compatible.clear()
            known = self.compatible[key] = merge_all([*left, *right], self.rank) == [x for x in key if x]
        return known

    def prefix_encode(self, word: str) -> list[str]:
        """The tokens of a chunk without inner spaces."""
        last = ["", *word]  # where no longer piece fits, the character itself is the last token
        known, found = self.compatible.get, -1
        for end, piece in self.automaton.iter(word):
            if end != found:
                left = last[end + 1 - len(piece)]
                # A token that doesn't reproduce itself fails this test for any neighbour.
                if (fits := known((left, piece))) or fits is None and self.fits(left, piece):
                    last[end + 1], found = piece, end
        out, j = [], len(word)
        while j:
            out.append(last[j])
            j -= len(last[j])
        return out[::-1]

    def spaces(self, n: int) -> tuple[str, ...]:
        """The tokens of n spaces: their pieces all share one score, so the leftmost pair wins."""
        if (known := self.runs.get(n)) is None:
            known = tuple(merge_all([SPACE] * n, self.rank)) if n else ()
            if n <= 256:
                self.runs[n] = known
        return known

    def chunk_tokens(self, chunk: str) -> list[str]:
        body = chunk.lstrip(SPACE)
        n = len(chunk) - len(body)
        if not body or not n:
            return [*self.spaces(n), *self.prefix_encode(body)] if body or n else []
        # The last space joins the word before any two spaces join, as all of their pieces score lowest.
        rest = self.prefix_encode(SPACE + body)
        return [*self.spaces(n), *rest[1:]] if rest[0] == SPACE else [*self.spaces(n - 1), *rest]

    def token_ids(self, token: str) -> list[int]:
        if (i := self.ids.get(token)) is not None:
            return [i]
        if self.bytes:
            return [self.bytes[b] for b in token.encode()]
        return [self.unknown]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids; the space that the encoder put in front goes if first."""
        out, raw = [], bytearray()
        for i in ids:
            if self.types[i] == 6:
                raw.append(int(self.pieces[i][3:5], 16))
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            piece = self.pieces[i] if self.types[i] == 1 else " ⁇ " if self.types[i] == 2 else ""
            out.append((piece.removeprefix(SPACE) if first else piece).replace(SPACE, " "))
            first = False
        if raw:
            out.append(raw.decode(errors="replace"))
        return "".join(out)

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        """Number of ids, the ids comma-joined, and what they decode to inside a text."""
        if (known := self.chunks.get(chunk) or self.older.get(chunk)) is None:
            tokens = self.chunk_tokens(chunk)
            said = [*map(self.said.get, tokens)]
            if None not in said:  # normal pieces only, which decode to themselves
                known = len(said), ",".join(said), chunk.replace(SPACE, " ")
            else:
                ids = [i for t in tokens for i in self.token_ids(t)]
                known = len(ids), ",".join(map(str, ids)), self.decode(ids, first=False)
        if len(chunk) <= 64:
            if len(self.chunks) > MEMO:
                self.older, self.chunks = self.chunks, {}
            self.chunks[chunk] = known
        return known

    def parts(self, text: str) -> list[tuple[int, str, str]]:
        if not text:
            return []
        known, make = self.chunks.get, self.chunk
        return [known(c) or make(c) for c in self.split(SPACE + text.replace(" ", SPACE))]

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.parts(text) for i in p[1].split(",")]


_TABLES: dict[str, PrefixTable] = {}


def _table(shared) -> PrefixTable:
    """One table per worker and broadcast vocabulary; a token tells them apart, as memory addresses come back."""
    token, vocabulary = shared.value
    if token not in _TABLES:
        _TABLES.clear()
        gc.set_threshold(200_000)  # the memo only grows; looking through it for cycles is wasted time
        _TABLES[token] = PrefixTable(*vocabulary)
    return _TABLES[token]


def _digests(table: PrefixTable, text: str | None) -> tuple[int, str, str, str]:
    counts, ids, decoded = zip(*table.parts(text)) if text else ((), (), ())
    decoded = "".join(decoded)
    # The space in front of the text is the encoder's own; the decoder takes it off again.
    decoded = decoded[1:] if decoded.startswith(" ") else decoded
    ids = ",".join(ids)
    return sum(counts), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids


def _with(df: DataFrame, model_path: str, row: Callable, fields: str, text: str, keep: list[str] | None) -> DataFrame:
    stays = keep is None or text in keep
    df = df.select(*dict.fromkeys([*(df.columns if keep is None else keep), text]))
    names = [f.split()[0] for f in fields.split(", ")]
    if clash := {c.lower() for c in df.columns} & set(names):
        df = df.withColumnsRenamed({c: f"{c}_in" for c in df.columns if c.lower() in clash})
        text = f"{text}_in" if text.lower() in clash else text
    shared = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, load_pieces(model_path)))

    def make(values: list) -> list:
        table = _table(shared)
        made = [row(table, v) for v in values]
        return [[m[k] for m in made] for k in range(len(names))]

    return mapped(df, [text], fields, make, keep=stays)


def encode(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """df with ``ids`` (array of int): what the sentencepiece library's encode() gives.

    A null text counts as empty and has no ids. Rows are kept one for one, repeats
    included; columns named ``ids`` come out as ``ids_in``.
    """
    return _with(df, model_path, lambda t, x: (t.encode(x or ""),), "ids array<int>", text, None)


def decode(df: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """df with ``decoded``: the text of its ids; null or no ids give an empty text, null ids count as none."""

    def run(table: PrefixTable, x: list[int | None] | None) -> tuple[str]:
        return (table.decode([i for i in x or [] if i is not None]),)

    return _with(df, model_path, run, "decoded string", ids, None)


def digest(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", extra: list[str] = (), ids: bool = False) -> DataFrame:
    """key, extra, n_tokens, ids_sha256 and decoded_sha256 of each row's whole text (null: empty); ids: also the ids, comma-joined."""
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string" * ids
    out = _with(df, model_path, _digests if ids else lambda t, x: _digests(t, x)[:3], fields, text, [key, *extra])
    return out.select(key, *extra, *(f.split()[0] for f in fields.split(", ")))
