"""Personal data: fixed patterns, and identifiers that bootstrapped patterns discover. DataFrame functions only.

The fixed patterns' matches are the seeds. Every other token with a digit or an at sign,
with the number groups that follow it, is a candidate. Both have lexical patterns of two
views: the words around them (two or one before, one behind, both, with a gap, the place
in the line) and the shape of the value. Patterns and values form a bipartite graph: a
pattern is worth the share of its values that are believed to be of a kind, a value what
its patterns say together (noisy or); seeds stay at 1. A pattern is only credited with what
the other view says of a value, lest it confirms itself. After some rounds the patterns
of high confidence and support name the kind of candidates that have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import durable
from larkspur.llm.spans_native import matches

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the contract's patterns: the same matches without backtracking, so that length is no danger.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token with a digit or an at sign and the number groups behind it, without the marks around them.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:(?<=[0-9)])\x20[(0-9][0-9().-]*+(?!\S))*+"
#: What the patterns of the value's shape start with; all others are of the words around it.
SHAPE = "# "
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.7, 5


def _luhn(digits: Column) -> Column:
    """The doubled digits are those at even places from the right, the last digit at place one."""

    def add(a: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _keeps(kind: str):
    return lambda m: _valid(kind, m["value"])


def _seed(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["value"].alias("value"), _contexts(m).alias("patterns"))


def _says(kind: str):
    return lambda m: F.concat_ws(":", F.lit(kind), m["start"], m["end"])


def base(text: Column) -> dict[str, Column]:
    """For each kind the valid matches of its pattern, as matches() gives them; a null text has none."""
    digit = text.rlike("[0-9]")
    maybe = {"email": F.instr(text, "@") > 0, "ip": digit, "card": digit, "phone": digit & (F.instr(text, "+") > 0)}
    return {k: F.filter(matches(text, p, maybe[k]), _keeps(k)) for k, p in PATTERNS.items()}


def _shape(value: Column) -> Column:
    """Letters and digits of a value by kind: up to three digits in a row are one 0, more keep their number."""
    letters = F.regexp_replace(value, r"\p{L}+", "a")
    digits = F.regexp_replace(letters, r"(?<![0-9])[0-9]{1,3}(?![0-9])", "\u0001")
    return F.replace(F.regexp_replace(digits, "[0-9]", "0"), F.lit("\u0001"), F.lit("0"))


def _contexts(m: Column) -> Column:
    """Lexical patterns of a match, digits in words as 0; a missing word makes no pattern."""
    left = F.lower(F.regexp_replace(m["before"], "[0-9]", "0"))
    right = F.lower(F.regexp_replace(m["after"], "[0-9]", "0"))
    two, one, far = (F.regexp_extract(left, r, 1) for r in (r"(\S+\s+\S+)\s*$", r"(\S+)\s*$", r"(\S+)\s+\S+\s*$"))
    next_ = F.regexp_extract(right, r"^\S*\s+(\S+)", 1)
    line = F.when(left.rlike(r"(^|\n)\s*$"), "^ ").otherwise("")
    made = lambda ok, *parts: F.when(ok, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    words = [made(two != "", "< ", F.regexp_replace(two, r"\s+", " ")), made(one != "", "<1 ", one), made(far != "", "<* ", far), made(next_ != "", "> ", next_), made((one != "") & (next_ != ""), "<> ", one, " _ ", next_)]
    return F.array_compact(F.array(*words, made(F.lit(True), SHAPE, _shape(m["value"])), made(line != "", SHAPE, line, _shape(m["value"]))))


def _trim(m: Column) -> Column:
    """A candidate without the marks before and behind it."""
    head = F.length(F.regexp_extract(m["value"], r"^[^\p{L}\p{N}+@_]*", 0))
    tail = F.length(F.regexp_extract(m["value"], r"[^\p{L}\p{N}_)]*$", 0))
    tail = F.least(tail, F.length(m["value"]) - head)
    value = F.substring(m["value"], head + 1, F.length(m["value"]) - head - tail)
    return F.struct((m["start"] + head).alias("start"), (m["end"] - tail).alias("end"), value.alias("value"), m["before"].alias("before"), m["after"].alias("after"))


def learn(edges: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, conf) of high confidence, from edges (pattern, value, kind), kind null where unknown.

    A value that is a seed of several kinds counts for each. Values and patterns are grouped
    by hash with partial aggregation, and each occurs once per pair, so that a pattern in
    very many texts weighs one row per distinct value.
    """
    pairs = durable(edges.groupBy("pattern", "value").agg(F.collect_set("kind").alias("kinds")))
    sizes = durable(pairs.groupBy("pattern").agg(F.count("*").alias("n")))
    seeds = pairs.select("pattern", "value", F.explode("kinds").alias("kind"), F.lit(1.0).alias("s"))
    unknown = durable(pairs.where(F.size("kinds") == 0).select("pattern", "value", F.startswith("pattern", F.lit(SHAPE)).alias("shape")))
    believed, patterns = seeds, None
    for k in range(rounds):
        patterns = believed.groupBy("pattern", "kind").agg(F.sum("s").alias("s")).join(sizes, "pattern").select("pattern", "kind", (F.col("s") / (F.col("n") + 1)).alias("conf"), "s")
        patterns = durable(patterns.where("s > 1"))
        if k < rounds - 1:
            spoken = unknown.join(patterns.where("conf >= 0.5"), "pattern").groupBy("value", "kind", "shape").agg((1 - F.exp(F.sum(F.log(1.0001 - F.col("conf"))))).alias("s"))
            heard = spoken.withColumn("shape", ~F.col("shape"))  # the other view's patterns hear it
            believed = seeds.unionByName(unknown.join(heard, ["value", "shape"]).select("pattern", "value", "kind", "s"))
    return patterns.where((F.col("conf") >= confidence) & (F.col("s") >= support)).select("pattern", "kind", "conf")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", hidden: int = 0, **limits) -> DataFrame:
    """(key, email, ip, card, phone, found): base matches of each kind, and discovered (kind, start, end).

    One row per row of docs. A null or empty text has no spans. A discovered span never
    overlaps a base span; where several patterns name a candidate's kind, the surest wins
    (then the kind by name). Repeated rows get equal results.

    To measure the discovery, ``hidden`` fifths of the base values (by hash) are taken for candidates.
    """
    t = F.col(text)
    seeds = lambda k: F.filter(k, lambda m: F.pmod(F.xxhash64(F.lower(m["value"]), F.lit(9)), F.lit(5)) >= hidden) if hidden else F.col(k)
    cand = F.filter(F.transform(matches(t, CANDIDATE, t.rlike("[0-9@]")), _trim), lambda m: m["value"].rlike(r"\p{N}|@"))
    same = F.xxhash64(F.coalesce(t, F.lit("")))
    rows = docs.select(F.col(key).alias("key"), same.alias("text_hash"), *(c.alias(k) for k, c in base(t).items()), cand.alias("cand"))
    taken = F.concat(*(F.transform(seeds(k), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))) for k in KINDS))
    rows = durable(rows.withColumn("cand", F.filter("cand", lambda c: ~F.exists(taken, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))))
    known = F.concat(*(F.transform(seeds(k), _seed(k)) for k in KINDS))
    open_ = F.transform("cand", lambda m: F.struct(F.lit(None).cast("string").alias("kind"), m["value"].alias("value"), _contexts(m).alias("patterns")))
    edges = rows.select(F.explode(F.concat(known, open_)).alias("e")).select("e.kind", F.lower("e.value").alias("value"), F.explode("e.patterns").alias("pattern"))
    sure = learn(edges, **limits)
    spots = rows.select("key", "text_hash", F.explode("cand").alias("m")).select("key", "text_hash", "m.start", "m.end", F.explode(_contexts(F.col("m"))).alias("pattern"))
    named = spots.join(sure, "pattern").groupBy("key", "text_hash", "start", "end").agg(F.max_by("kind", F.struct("conf", "kind")).alias("kind"))
    found = named.groupBy("key", "text_hash").agg(F.collect_set(F.struct("kind", "start", "end")).alias("found"))
    left = rows.alias("r").join(found.alias("f"), F.col("r.key").eqNullSafe(F.col("f.key")) & (F.col("r.text_hash") == F.col("f.text_hash")), "left")
    return left.select(F.col("r.key").alias(key), *(F.col(f"r.{k}") for k in KINDS), F.coalesce("f.found", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("found"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (base and discovered) of each document."""
    found = find(docs)
    only = F.concat(*(F.transform(k, _says(k)) for k in KINDS))
    place = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))
    more = lambda k: F.transform(F.filter("found", lambda m: m["kind"] == k), place)
    every = F.concat(*(F.transform(F.sort_array(F.concat(F.transform(k, place), more(k))), _says(k)) for k in KINDS))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(only, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"))
