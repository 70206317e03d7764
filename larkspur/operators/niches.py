"""What a free-text niche means: the known niche it names, its canonical key, other words for it, a place category.

Texts meet niches over an index of short pieces of both and over an index of words, so that a
text is compared with the niches it shares something with and with no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Known niches, in order of preference, each with the map tags that find it.
NICHES = {
    "dental": ["amenity=dentist"],
    "dentist": ["amenity=dentist"],
    "orthodontist": ["amenity=dentist"],
    "plastic surgery": ["healthcare=clinic", "amenity=clinic", "amenity=doctors"],
    "plastic surgeon": ["healthcare=clinic", "amenity=clinic", "amenity=doctors"],
    "cosmetic surgery": ["healthcare=clinic", "amenity=clinic", "amenity=doctors"],
    "cosmetic surgeon": ["healthcare=clinic", "amenity=clinic", "amenity=doctors"],
    "aesthetic clinic": ["healthcare=clinic", "amenity=clinic"],
    "dermatologist": ["healthcare=clinic", "amenity=doctors"],
    "skin clinic": ["healthcare=clinic", "amenity=doctors"],
    "restaurant": ["amenity=restaurant"],
    "cafe": ["amenity=cafe"],
    "coffee shop": ["amenity=cafe"],
    "bakery": ["shop=bakery"],
    "hotel": ["tourism=hotel"],
    "gym": ["leisure=fitness_centre"],
    "fitness": ["leisure=fitness_centre"],
    "salon": ["shop=hairdresser"],
    "hair salon": ["shop=hairdresser"],
    "barber": ["shop=hairdresser"],
    "spa": ["leisure=spa", "shop=beauty"],
    "beauty": ["shop=beauty"],
    "lawyer": ["office=lawyer"],
    "law firm": ["office=lawyer"],
    "attorney": ["office=lawyer"],
    "real estate": ["office=estate_agent"],
    "realtor": ["office=estate_agent"],
    "pharmacy": ["amenity=pharmacy"],
    "clinic": ["amenity=clinic"],
    "doctor": ["amenity=doctors"],
    "hospital": ["amenity=hospital"],
    "veterinary": ["amenity=veterinary"],
    "vet": ["amenity=veterinary"],
    "car dealer": ["shop=car"],
    "auto repair": ["shop=car_repair"],
    "mechanic": ["shop=car_repair"],
    "bank": ["amenity=bank"],
    "school": ["amenity=school"],
    "gas station": ["amenity=fuel"],
    "petrol station": ["amenity=fuel"],
    "supermarket": ["shop=supermarket"],
    "grocery": ["shop=supermarket"],
    "clothing store": ["shop=clothes"],
    "electronics store": ["shop=electronics"],
    "accountant": ["office=accountant"],
    "insurance": ["office=insurance"],
    "photographer": ["craft=photographer"],
    "florist": ["shop=florist"],
    "bar": ["amenity=bar"],
    "pub": ["amenity=pub"],
    "bookstore": ["shop=books"],
    "jewelry": ["shop=jewelry"],
    "travel agency": ["office=travel_agent"],
}
# Words that don't count when words are compared, and the category that the first of these words in a niche stands for.
STOP = ["a", "an", "the", "and", "or", "shop", "store", "service", "services"]
CATEGORIES = {
    "dentist": "healthcare.dentist",
    "dental": "healthcare.dentist",
    "clinic": "healthcare",
    "doctor": "healthcare",
    "medical": "healthcare",
    "hospital": "healthcare",
    "health": "healthcare",
    "restaurant": "catering.restaurant",
    "cafe": "catering.cafe",
    "coffee": "catering.cafe",
    "food": "catering",
    "supermarket": "commercial.supermarket",
    "grocery": "commercial.supermarket",
    "shop": "commercial",
    "store": "commercial",
    "gym": "sport.fitness",
    "fitness": "sport.fitness",
    "hotel": "accommodation.hotel",
    "lodging": "accommodation.hotel",
    "school": "education",
    "university": "education",
    "college": "education",
    "bank": "service",
    "salon": "service",
    "beauty": "service",
    "spa": "service",
}
PIECE = 3


def known_niches(spark: SparkSession, niches: dict[str, list[str]] = NICHES) -> DataFrame:
    """(place, name, tags) in order of preference."""
    return spark.createDataFrame([(i, n, tags) for i, (n, tags) in enumerate(niches.items())], "place int, name string, tags array<string>")


def words(c: Column) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0))), lambda w: (F.length(w) > 2) & ~w.isin(*STOP))


def pieces(c: Column) -> Column:
    """All different pieces of up to PIECE characters."""
    starts = F.sequence(F.lit(1), F.length(c))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(PIECE)), lambda n: F.transform(F.filter(starts, lambda i: i + n - 1 <= F.length(c)), lambda i: F.substr(c, i, n)))))


def match(texts: DataFrame, niches: DataFrame) -> DataFrame:
    """(text, name, place, tags): the niche that each distinct non-blank text (trimmed, lower-cased) names; texts that name none are absent.

    The niche of that name, else the first that is part of the text or that the text is part of, else the one with the most words in common, the first of equals.
    A part begins with its first three characters, so that a pair is only compared where one has the other's beginning among its pieces.
    """
    asked = texts.select("text").where("text <> ''").distinct()
    known = niches.select("name", "place", "tags")
    begins = lambda c: F.left(c, F.lit(PIECE))
    inside = asked.withColumn("piece", F.explode(pieces(F.col("text")))).join(known.withColumn("piece", begins(F.col("name"))), "piece").where(F.contains("text", F.col("name")))
    round_ = asked.withColumn("piece", begins(F.col("text"))).join(known.withColumn("piece", F.explode(pieces(F.col("name")))), "piece").where(F.contains("name", F.col("text")))
    same = F.when(F.col("text") == F.col("name"), 0).otherwise(1)
    step = lambda df, how, less: df.select("text", "name", "place", "tags", F.struct(how.alias("how"), less.alias("less"), F.col("place").alias("at")).alias("rank"))
    shared = asked.withColumn("word", F.explode(words(F.col("text")))).join(known.withColumn("word", F.explode(words(F.col("name")))), "word").groupBy("text", "name", "place", "tags").agg(F.count("*").cast("int").alias("n"))
    every = step(inside, same, F.lit(0)).unionAll(step(round_, same, F.lit(0))).unionAll(step(shared, F.lit(2), -F.col("n")))
    return every.groupBy("text").agg(F.min_by(F.struct("name", "place", "tags"), "rank").alias("m")).select("text", "m.*")


def canonical(rows: DataFrame, column: str, niches: DataFrame) -> DataFrame:
    """rows with ``niche`` (the known niche named, or null), ``niche_tags`` and ``niche_key``: the first niche with the same tags, else the text itself.

    Texts are trimmed and lower-cased; a null text has a null key.
    """
    text = F.lower(F.trim(F.col(column)))
    first = niches.groupBy(F.concat_ws("|", "tags").alias("signature_")).agg(F.min_by("name", "place").alias("first_"))
    found = match(rows.select(text.alias("text")), niches).withColumn("signature_", F.concat_ws("|", "tags")).join(first, "signature_")
    found = found.select(F.col("text").alias("text_"), F.col("name").alias("niche"), F.col("tags").alias("niche_tags"), "first_")
    return rows.withColumn("t_", text).join(found, F.col("t_") == F.col("text_"), "left").withColumn("niche_key", F.coalesce("first_", "t_")).drop("t_", "text_", "first_")


def expand(rows: DataFrame, column: str, synonyms: DataFrame) -> DataFrame:
    """One row for each phrase to search for: rows with ``term`` and ``term_place``, the text itself (0) and then its synonyms in order, each once.

    synonyms: (niche, place, term). Blank texts give no rows.
    """
    text = F.lower(F.trim(F.col(column)))
    listed = synonyms.groupBy(F.col("niche").alias("n_")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda s: s["term"]).alias("s_"))
    both = rows.withColumn("t_", text).where("t_ <> ''").join(listed, F.col("t_") == F.col("n_"), "left")
    terms = F.array_distinct(F.concat(F.array("t_"), F.coalesce("s_", F.array().cast("array<string>"))))
    return both.select(*rows.columns, F.posexplode(terms).alias("term_place", "term"))


def category(c: Column, categories: dict[str, str] = CATEGORIES) -> Column:
    """The category of the first listed word that the text holds, null if there is none."""
    low = F.lower(F.trim(c))
    return F.coalesce(*(F.when(F.contains(low, F.lit(w)), F.lit(v)) for w, v in categories.items()))
