"""Places on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def somewhere(lat: Column, lon: Column) -> Column:
    """Known, on the globe and not the origin of the grid."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


# Phrases of prose that gets into address fields, and words of real addresses.
PROSE = ["near me", "best ", "top ", "for appointments", "scheduling", "consultation", "call ", "contact us", "book appointment", "click here"]
STREET = r"\b(?:road|street|st\.?|lane|avenue|boulevard|block|colony|society|house no|shop no|plaza|market|phase|garden)\b"


def plausible_address(c: Column) -> Column:
    """At most 160 characters, no phrase of prose, and a street word or a digit."""
    low = F.lower(F.trim(c))
    prose = F.exists(F.array(*map(F.lit, PROSE)), lambda p: F.contains(low, p))
    return F.coalesce((low != "") & (F.length(low) <= 160) & ~prose & (low.rlike(STREET) | low.rlike("[0-9]")), F.lit(False))


# Names of countries and the codes of their directories.
COUNTRIES = {"pakistan": "pk", "united states": "us", "usa": "us", "america": "us", "united kingdom": "uk", "britain": "uk", "england": "uk", "australia": "au", "canada": "ca", "new zealand": "nz", "united arab emirates": "ae", "uae": "ae", "saudi arabia": "sa", "india": "in", "germany": "de", "france": "fr", "spain": "es", "italy": "it", "netherlands": "nl", "singapore": "sg"}


def country_code(c: Column) -> Column:
    """The code of a country's name, case aside; empty for unknown ones."""
    codes = F.create_map(*(F.lit(x) for pair in COUNTRIES.items() for x in pair))
    return F.coalesce(F.try_element_at(codes, F.lower(c)), F.lit(""))
