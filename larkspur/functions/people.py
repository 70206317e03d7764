"""People named near e-mail addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = r"[A-Z][a-z]+ [A-Z][a-z]+"
NEAR = rf"({NAME})[^@]{{0,120}}?\b([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}})"


def people(text: Column) -> Column:
    """(name, email) of names with an address within 120 characters after them, then names without one."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(NEAR), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(NEAR), F.lit(2)).alias("email"))
    paired = F.transform(pairs, lambda p: F.struct(p["name"].alias("name"), F.lower(p["email"]).alias("email")))
    bare = F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(NAME), F.lit(0))), F.transform(paired, lambda p: p["name"]))
    return F.concat(paired, F.transform(bare, lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("email"))))
