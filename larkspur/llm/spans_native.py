"""Regular-expression matches with positions, from DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of context kept on each side of a match.
CONTEXT = 48
MATCH = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def matches(text: Column, pattern: str, maybe: Column | None = None) -> Column:
    """Leftmost non-overlapping matches: an array of (start, end, value, before, after).

    Positions are code points, the end exclusive. maybe: where it is false, there is no
    match for sure and the pattern isn't tried. A null text has no matches.

    Matches are put between two marks that no pattern here can match; the text is split
    at them, and running lengths give the positions. Found matches are gathered in short
    runs, so that a text with very many of them costs no quadratic copying.
    """
    clean = F.translate(text, "\x01\x02", "\x03\x03")
    parts = F.split(F.regexp_replace(clean, pattern, "\x01$0\x02"), "[\x01\x02]")
    none = F.array().cast(MATCH)

    def of(p: Column) -> Column:
        zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit("").alias("last"), none.alias("run"), F.array().cast(f"array<{MATCH}>").alias("runs"))

        def step(a: Column, x: Column) -> Column:
            n = F.length(x)
            hit = a["i"] % 2 == 1
            full = F.size(a["run"]) >= 256
            after = F.left(F.coalesce(F.try_element_at(p, a["i"] + 2), F.lit("")), F.lit(CONTEXT))
            m = F.struct(a["at"].alias("start"), (a["at"] + n).alias("end"), x.alias("value"), F.right(a["last"], F.lit(CONTEXT)).alias("before"), after.alias("after"))
            run = F.when(~hit, a["run"]).when(full, F.array(m)).otherwise(F.concat(a["run"], F.array(m)))
            runs = F.when(hit & full, F.concat(a["runs"], F.array(a["run"]))).otherwise(a["runs"])
            return F.struct((a["i"] + 1).alias("i"), (a["at"] + n).alias("at"), x.alias("last"), run.alias("run"), runs.alias("runs"))

        return F.aggregate(p, zero, step, lambda a: F.flatten(F.concat(a["runs"], F.array(a["run"]))))

    # A one-element array binds the split once instead of once per use.
    found = F.element_at(F.transform(F.array(parts), lambda p: F.when(F.size(p) > 1, of(p)).otherwise(none)), 1)
    return F.coalesce(F.when(maybe, found) if maybe is not None else found, none)
