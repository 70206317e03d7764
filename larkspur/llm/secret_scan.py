"""Secret scan: token candidates, and a random forest that tells findings from false positives. DataFrame functions only.

The forest is trained by Spark's own learner on labelled findings and then written out
as one SQL expression, so that scoring needs no shuffle: each row's candidates are an
array, features and votes are higher-order functions over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import durable
from larkspur.llm.spans_native import matches

#: Long tokens with a digit, and quoted values assigned to a telling name.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+=*+|(?<=(?i:token|secret|passw(?:or)?d|key) ?[:=] ?[\"'])[^\s\"']{6,}+"
# Words and word parts that make a token look like prose or code, common letter pairs, and telling neighbours.
DICTIONARY = "the and ing ion ent for with that this from test example sample user name data file path hash commit image http https www com org net html version build release document report order customer product number index value string object function class module package update config default public private common change message service request response password secret token draft invoice account session place holder your dummy".split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch".split()
TELLING = "key secret token passw auth credential bearer access private signature".split()
HARMLESS = "commit sha md5 hash uuid checksum version example sample test order invoice card phone build digest etag integrity revision blob cache".split()
HARMLESS_PATH = "test example sample fixture vendor lock doc".split()
TREES, DEPTH, SEED = 20, 7, 17


def _any(c: Column, words: list[str]) -> Column:
    return F.lower(c).rlike(f"(?<![a-z])(?:{'|'.join(words)})").cast("double")


def _rate(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.greatest(F.length(c), F.lit(1))


def features(value: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """What the forest sees of a candidate, by name; null parts count as empty."""
    value, before, after, path = (F.coalesce(c, F.lit("")) for c in (value, before, after, path))
    n = F.greatest(F.length(value), F.lit(1))
    near, close = F.right(before, F.lit(24)), F.right(before, F.lit(3))
    chars = F.array_distinct(F.split(value, ""))
    return {
        "length": F.length(value).cast("double"),
        "letter_digit": _rate(value, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
        "case_change": _rate(value, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "vowel_change": _rate(value, "(?i)(?<=[aeiou])(?=[bcdfghjklmnpqrstvwxyz])|(?<=[bcdfghjklmnpqrstvwxyz])(?=[aeiou])"),
        "pairs": _rate(value, f"(?i)(?={'|'.join(PAIRS)})"),
        "digits": _rate(value, "[0-9]"),
        "upper": _rate(value, "[A-Z]"),
        "joints": _rate(value, "[-_/+=.]"),
        "beyond_hex": _rate(value, "[^0-9a-fA-F]"),
        "kinds": F.size(chars).cast("double"),
        "distinct": F.size(chars) / n,
        "repeats": _rate(value, r"(?s)(.)(?=\1)"),
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(value), "|".join(DICTIONARY), "")) / n,
        "assigned": close.rlike(r"[:=]\s*[\"']?$").cast("double"),
        "quoted": (close.rlike(r"[\"']$") & after.rlike(r"^[\"']")).cast("double"),
        "telling": _any(near, TELLING),
        "harmless": _any(near, HARMLESS),
        "in_url": close.rlike(r"[/.@]$").cast("double"),
        "harmless_path": _any(path, HARMLESS_PATH),
    }


def labelled_findings(spark: SparkSession, n: int = 6000, held_out: bool = False) -> DataFrame:
    """(value, before, after, path, label) of n made-up findings, alike on every run: half of them secrets.

    No feature alone gives the label away: bare provider keys stand in prose, placeholders, names and
    numbers behind telling words, hashes behind harmless ones or in prose, and paths hold both.
    held_out: of templates (kinds of values, words around them) that the others don't have.
    """
    i = F.col("id")
    draw = lambda salt: F.sha2(F.concat(F.lit(salt), i).cast("binary"), 512)
    hexes = F.concat(draw("a"), draw("b"))
    base64 = F.translate(F.base64(F.unhex(draw("c"))), "=", "")
    base62 = F.translate(base64, "+/", "")
    upper = F.translate(F.upper(F.translate(base64, "+/", "")), "0189", "WXYZ")
    numbers = F.translate(draw("d"), "abcdef", "012345")

    def pick(salt: str, given: list, kept: list) -> Column:
        options = [F.lit(o) if isinstance(o, str) else o for o in (kept if held_out else given)]
        return F.element_at(F.array(*options), F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(options))).cast("int") + 1)

    chance = lambda salt, percent: F.pmod(F.xxhash64(F.lit(salt), i), F.lit(100)) < percent
    cut = lambda c, k: F.left(c, F.lit(k))
    pre = lambda p, c, k: F.concat(F.lit(p), cut(c, k))
    word = pick("w", ["customer", "document", "release", "thingable", "ounter", "report", "einander", "sollten"], ["session", "account", "invoice", "nombre", "packung", "message"])
    word2 = pick("v", ["draft", "final", "update", "archive", "index"], ["image", "value", "parte", "gruppe"])
    year = F.concat(F.lit("20"), cut(numbers, 2))

    key = pick("k", [pre("AKIA", upper, 16), pre("ghp_", base62, 36), pre("sk-", base62, 32), pre("xoxb-", base62, 30), pre("ya29", base62, 40), cut(upper, 24)], [pre("ASIA", upper, 16), pre("glpat-", base62, 20), pre("AIza", base62, 35), pre("npm_", base62, 36)])
    coded = pick("s", [cut(hexes, 40), cut(hexes, 32), cut(hexes, 18), cut(hexes, 24), cut(base64, 40), cut(base62, 16), cut(base62, 22)], [cut(hexes, 64), cut(hexes, 48), cut(hexes, 20), cut(base64, 44), cut(base62, 26)])
    hashed = pick("h", [cut(hexes, 40), cut(hexes, 32), cut(hexes, 64), F.concat(cut(base64, 43), F.lit("=")), pre("sha512-", base64, 64), F.concat_ws("-", cut(hexes, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))], [cut(hexes, 48), cut(hexes, 56), pre("sha384-", base64, 64)])
    filler = pick("f", [F.concat(F.repeat(cut(hexes, 1), 20), F.lit("1")), F.concat_ws("-", word, year, word2), F.concat(F.lit("your-"), word, F.lit("-"), cut(numbers, 5)), F.concat(F.lit("change"), word, cut(numbers, 4)), F.concat(F.repeat(F.lit("x"), 8), cut(numbers, 6)), F.lit("0123456789abcdef"), F.concat(F.lit("test_"), word, F.lit("_"), cut(numbers, 3)), F.concat(F.repeat(cut(hexes, 2), 8), F.lit("0"))], [F.concat(F.lit("placeholder"), cut(numbers, 8)), F.concat_ws("_", word2, word, year), F.concat(F.repeat(F.lit("0"), 16), cut(numbers, 1)), F.concat(F.lit("dummy-"), word, cut(numbers, 2)), F.concat(F.repeat(F.lit("abc1"), 5), F.lit("0"))])
    name = pick("n", [cut(numbers, 16), cut(numbers, 13), F.concat_ws("-", word, word2, cut(numbers, 3)), F.concat(word, F.lit("_"), word2, cut(numbers, 2)), F.concat_ws("/", F.lit(""), word, word2, cut(numbers, 4)), F.concat(F.upper(word), year, cut(numbers, 6)), F.concat(year, F.lit("-"), cut(numbers, 2), F.lit("-"), F.substring(numbers, 3, 2), F.lit("T00")), F.concat(F.initcap(word), F.initcap(word2), cut(numbers, 2))], [cut(numbers, 19), cut(numbers, 15), F.concat_ws("_", F.upper(word2), F.upper(word), cut(numbers, 4)), F.concat(word2, F.initcap(word), F.lit("V"), cut(numbers, 3)), F.concat_ws("-", cut(numbers, 4), F.substring(numbers, 5, 4), F.substring(numbers, 9, 4), F.substring(numbers, 13, 4))])

    prose = pick("q", ["in the ", "of that ", "see ", "and then ", "le de ", "und der ", "it. "], ["para los ", "with her ", "que la ", "which is "])
    told = pick("t", ["token = \"", "api_key: \"", "secret = '", "password=\"", "auth_token: ", "access_key = ", "SECRET_KEY=\"", "password=", "Bearer "], ["client_secret=\"", "credentials: '", "passwd: ", "x-auth-key = ", "private_key=\""])
    neutral = pick("u", ["value = \"", "x: ", "data=", "result = '"], ["entry: \"", "field=", "item = '"])
    harmless = pick("g", ["commit ", "sha1: ", "md5 = ", "checksum: ", "version ", "cache key = ", "token hash: ", "etag: \""], ["digest ", "revision = ", "blob ", "integrity: \"", "key checksum = "])
    yes, bare = i % 2 == 0, i % 4 == 0
    good = F.when(bare, key).otherwise(coded)
    around = F.when(bare, F.when(chance("1", 45), prose).when(chance("2", 60), told).otherwise(neutral)).otherwise(F.when(chance("3", 90), told).otherwise(neutral))
    kind = F.pmod(F.xxhash64(F.lit("z"), i), F.lit(3))
    bad = F.when(kind == 0, filler).when(kind == 1, name).otherwise(hashed)
    about = F.when(kind == 0, F.when(chance("4", 75), told).otherwise(neutral)).when(kind == 1, F.when(chance("5", 25), told).when(chance("6", 30), neutral).otherwise(prose)).otherwise(F.when(chance("7", 75), harmless).otherwise(prose))
    lead = F.concat(prose, F.when(yes, around).otherwise(about))
    close = F.when(lead.rlike("[\"']$"), F.right(lead, F.lit(1))).otherwise(" ")
    plain = pick("p", ["src0", "src7", "src/app.py", "notes.txt"], ["src3", "main.go", "page.html"])
    path = F.when(chance("8", 60), plain).when(yes == chance("9", 75), pick("x", ["config.yml", ".env", "deploy.sh"], ["settings.ini", "prod.tf"])).otherwise(pick("y", ["tests/fixture.json", "docs/report.md", "yarn.lock"], ["examples/demo.py", "vendor/lib.js"]))
    return spark.range(0, n, 1, 1).select(F.when(yes, good).otherwise(bad).alias("value"), lead.alias("before"), F.concat(close, F.lit("the")).alias("after"), path.alias("path"), F.when(yes, 1.0).otherwise(0.0).alias("label"))


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH):
    """A random forest model on labelled findings (value, before, after, path, label); null labels teach nothing."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    named = features(*(F.col(c) for c in ("value", "before", "after", "path")))
    rows = findings.where("label is not null").select(*(c.cast("double").alias(k) for k, c in named.items()), F.col("label").cast("double").alias("label"))
    rows = VectorAssembler(inputCols=list(named), outputCol="x").transform(durable(rows)).select("x", "label")
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED).fit(rows)


def as_sql(model, prefix: str = "") -> str:
    """The forest's mean vote for label 1 as SQL over the features' names, each behind prefix."""
    names = list(features(*(F.lit(""),) * 4))

    def of(node) -> str:
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return repr(float(stats[1] / sum(stats)) if sum(stats) else 0.5) + "D"
        split = node.split()
        return f"if({prefix}{names[split.featureIndex()]} <= {float(split.threshold())!r}D, {of(node.leftChild())}, {of(node.rightChild())})"

    votes = [of(t._java_obj.rootNode()) for t in model.trees]
    return f"({' + '.join(votes)}) / {len(votes)}"


def scan(docs: DataFrame, model, text: str = "text", path: str | None = "source", out: str = "secrets") -> DataFrame:
    """docs with ``secrets``: an array of (start, end, value, score) of all candidates, scores 0 to 1.

    A null or empty text has no candidates; rows stay one for one. Columns of docs named as
    the result come out with ``_in`` appended; a missing path column counts as empty.
    """
    clash = {c: f"{c}_in" for c in docs.columns if c.lower() in (out.lower(), "seen_")}
    docs, text, path = docs.withColumnsRenamed(clash), clash.get(text, text), clash.get(path, path)
    t = F.col(text)
    place = F.col(path).cast("string") if path in docs.columns else F.lit("")
    found = matches(t, CANDIDATE, t.rlike("[0-9=:]"))

    def seen(m: Column) -> Column:
        named = features(m["value"], m["before"], m["after"], place)
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), *(c.cast("double").alias(k) for k, c in named.items()))

    judged = F.expr(f"transform(seen_, m -> named_struct('start', m.start, 'end', m.`end`, 'value', m.value, 'score', {as_sql(model, 'm.')}))")
    return docs.withColumn("seen_", F.transform(found, seen)).withColumn(out, judged).drop("seen_")


def secrets_only(found: str = "secrets", threshold: float = 0.5) -> Column:
    return F.filter(found, lambda m: m["score"] >= threshold)


def redact(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """text with each of the ascending, disjoint spans replaced by mark; without spans as it is."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    step = lambda a, m: F.struct(m["end"].alias("at"), F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, m["start"] - a["at"]), F.lit(mark))).alias("parts"))
    whole = F.aggregate(spans, start, step, lambda a: F.array_join(F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, F.length(text)))), ""))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_candidates, n_secrets, spans (start:end of secrets, comma-joined) and redacted_sha256 of each document."""
    found = scan(docs.select("doc_id", "text", "source"), train(labelled_findings(docs.sparkSession)))
    found = found.withColumn("sure", secrets_only())
    spans = F.array_join(F.transform("sure", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    text = F.coalesce("text", F.lit(""))
    return found.select("doc_id", F.size("secrets").cast("long").alias("n_candidates"), F.size("sure").cast("long").alias("n_secrets"), spans.alias("spans"), F.sha2(redact(text, F.col("sure")), 256).alias("redacted_sha256"))
