"""The nearest places of each place, over a grid whose cells grow until enough are found.

The first grid is the coarsest one without crowded cells. Of places at one spot only the first
k + 1 by key can be among anyone's k nearest, so that no more are looked at. A place asks the nine cells round its own; what lies outside of them is farther than a bound
that follows from the cell's width and the place's latitude. Places that have enough within
that bound are done; the others ask again over cells of twice the width. At the widest, nine
cells hold the globe.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.geo import EARTH_KM, haversine_km, somewhere
from larkspur.session import durable

#: Columns of the finest and of the coarsest grid, as powers of two; places of nine cells of the grid to begin with, as a multiple of k.
FINEST, COARSEST = 16, 1
CROWD = 64


def _cell(lat: Column, lon: Column, columns: int) -> tuple[Column, Column]:
    wide = 360.0 / columns
    x = F.pmod(F.floor((lon + 180) / wide), F.lit(columns)).cast("int")
    return x, F.floor((lat + 90) / wide).cast("int")


def _begin(at: DataFrame, within: str, k: int) -> int:
    """The coarsest grid on which no nine cells of a group hold more than CROWD * k places, else the finest; counted by partial sums."""
    cells = F.array(*(F.struct(F.lit(p).alias("p"), *(c.alias(n) for n, c in zip("xy", _cell(F.col("lat"), F.col("lon"), 1 << p)))) for p in range(COARSEST, FINEST + 1)))
    full = at.select(within, F.explode(cells).alias("c")).groupBy(within, "c").count().groupBy("c.p").agg(F.max("count").alias("most"))
    return min((r.p for r in full.where(9 * F.col("most") <= CROWD * k).collect()), default=FINEST)


def nearest(places: DataFrame, k: int, key: str = "city", within: str = "country", asking: DataFrame | None = None) -> DataFrame:
    """(key, near, km, place): the k nearest other places of the same group for each asking one (default: all), ties by key.

    places has key, within, lat and lon; those nowhere (null, off the globe, or at 0, 0) take no part. Distances alike to a
    millimetre count as ties. Fewer than k come out only where a group has no more.
    """
    at = durable(places.where(somewhere(F.col("lat"), F.col("lon"))).select(key, within, F.col("lat").cast("double"), F.col("lon").cast("double")))
    asked = at if asking is None else at.join(asking.select(key).distinct(), key, "left_semi")
    spot = Window.partitionBy(within, "lat", "lon").orderBy(key)
    seen = durable(at.withColumn("rn_", F.row_number().over(spot)).where(F.col("rn_") <= k + 1).drop("rn_"))
    done, open_ = [], durable(asked)
    for power in range(_begin(seen, within, k), COARSEST - 1, -1):
        columns = 1 << power
        x, y = _cell(F.col("lat"), F.col("lon"), columns)
        here = seen.select(F.col(key).alias("near"), F.col(within).alias("w_"), F.col("lat").alias("lat_"), F.col("lon").alias("lon_"), x.alias("x_"), y.alias("y_"))
        nine = F.array_distinct(F.array(*(F.struct(F.pmod(x + dx, F.lit(columns)).alias("x"), (y + dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))
        looks = open_.withColumn("c_", F.explode(nine))
        # Neither side is broadcast: Spark takes exploded rows for as few as they were made of.
        pairs = looks.join(here.hint("merge"), (F.col(within) == F.col("w_")) & (F.col("c_.x") == F.col("x_")) & (F.col("c_.y") == F.col("y_")) & (F.col(key) != F.col("near")))
        pairs = pairs.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("lat_"), F.col("lon_")))
        first = pairs.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.round("km", 6), "near"))).where(F.col("place") <= k)
        if power == COARSEST:  # nine cells hold the globe
            done.append(durable(first.select(key, "near", "km", "place")))
            break
        wide = 360.0 / columns
        # To the parallel a cell's width away, and to the meridian a cell's width away.
        bound = F.least(F.lit(EARTH_KM) * F.radians(F.lit(wide)), F.lit(EARTH_KM) * F.asin(F.cos(F.radians("lat")) * F.sin(F.radians(F.lit(min(wide, 90.0))))))
        enough = (F.col("place") == k) & (F.col("km") + 1e-5 < bound)
        first = durable(first.withColumn("enough_", F.max(enough).over(Window.partitionBy(key))).where("enough_").select(key, "near", "km", "place"))
        done.append(first)
        open_ = durable(open_.join(first.where(F.col("place") == k).select(key).hint("merge"), key, "left_anti"))
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def nearest_by_name(cities: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """asked (country, city) with its k nearest other cities (near, km, place) by name, case and white space aside; unknown ones have none.

    cities (country, ordinal, name, lat, lon) is in order of size; of cities of one name in a country the first is meant.
    """
    low = F.lower(F.trim("city"))
    named = cities.withColumn("rn_", F.row_number().over(Window.partitionBy("country", F.lower("name")).orderBy("ordinal"))).where("rn_ = 1")
    keyed = named.select(F.col("ordinal").alias("id_"), F.col("country").alias("c_"), F.lower("name").alias("n_"), "name", "lat", "lon")
    meant = asked.withColumn("low_", low).join(keyed.select("id_", "c_", "n_"), (F.upper("country") == F.col("c_")) & (F.col("low_") == F.col("n_")))
    found = nearest(keyed.withColumnRenamed("c_", "country_"), k, "id_", "country_", meant)
    return meant.select("country", "city", "id_").join(found, "id_").join(keyed.select(F.col("id_").alias("near"), F.col("name").alias("near_name")), "near").select("country", "city", F.col("near_name").alias("near"), "km", "place")


def centre(cities: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (country, city) with lat and lon of the first city of that name, case and white space aside; null where none is known."""
    known = cities.where(somewhere(F.col("lat"), F.col("lon"))).withColumn("rn_", F.row_number().over(Window.partitionBy("country", F.lower("name")).orderBy("ordinal"))).where("rn_ = 1")
    known = known.select(F.col("country").alias("c_"), F.lower("name").alias("n_"), "lat", "lon")
    return asked.join(known, (F.upper("country") == F.col("c_")) & (F.lower(F.trim("city")) == F.col("n_")), "left").drop("c_", "n_")


def top_cities(cities: DataFrame, n: int) -> DataFrame:
    """The first n cities of each country."""
    return cities.withColumn("rn_", F.row_number().over(Window.partitionBy("country").orderBy("ordinal"))).where(F.col("rn_") <= n).drop("rn_")


def typeahead(cities: DataFrame, asked: DataFrame, limit: int = 8) -> DataFrame:
    """(id, name, lat, lon, place) for each asked (id, country, query): cities that begin with the query, else those that hold it, else the query itself at 0, 0.

    Case and white space around a query are no matter; queries of under two characters get nothing. Queries are compared with their own
    country's cities, each different one once.
    """
    q = asked.select("id", F.upper("country").alias("c_"), F.trim("query").alias("q_")).where(F.length("q_") >= 2)
    texts = q.select("c_", "q_", F.lower("q_").alias("low_")).distinct()
    known = cities.select(F.col("country").alias("c_"), "ordinal", "name", "lat", "lon")
    hit = texts.join(known, "c_").where(F.contains(F.lower("name"), F.col("low_"))).withColumn("tier_", F.when(F.startswith(F.lower("name"), F.col("low_")), 0).otherwise(1))
    first = hit.withColumn("best_", F.min("tier_").over(Window.partitionBy("c_", "q_"))).where("tier_ = best_")
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy("c_", "q_").orderBy("ordinal"))).where(F.col("place") <= limit)
    found = q.join(ranked.select("c_", "q_", "name", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "place"), ["c_", "q_"], "left")
    unknown = F.col("name").isNull()
    return found.select("id", F.coalesce("name", "q_").alias("name"), F.when(unknown, 0.0).otherwise(F.col("lat")).alias("lat"), F.when(unknown, 0.0).otherwise(F.col("lon")).alias("lon"), F.coalesce("place", F.lit(1)).alias("place"))


def within_radius(pois: DataFrame, limit: int, steps: tuple[float, ...] = (15, 50)) -> DataFrame:
    """Points (distance_km) of the smallest radius that holds enough of them, else of the largest; counted in one pass, no row moved."""
    counts = pois.agg(*(F.count_if(F.col("distance_km") <= r).alias(f"r{i}_") for i, r in enumerate(steps)))
    enough = F.coalesce(*(F.when(F.col(f"r{i}_") >= limit, F.lit(float(r))) for i, r in enumerate(steps)), F.lit(float(steps[-1])))
    one = counts.select(enough.alias("radius_"))  # one row
    return pois.join(F.broadcast(one), F.col("distance_km") <= F.col("radius_")).drop("radius_")
