"""What built-in functions can't do with HTML: Arrow-batched helpers from Python's standard library.

unescape() decodes all entities of texts that have any; rows without an ampersand aren't sent to Python."""

from __future__ import annotations

import html
import json
import re
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import MapType, StringType, StructField, StructType


@pandas_udf(StringType())
def html_unescape(c: pd.Series) -> pd.Series:
    """All named and numeric entities decoded."""
    return c.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """c with all named and numeric entities decoded."""
    return F.coalesce(html_unescape(F.when(F.contains(c, F.lit("&")), c)), c)


_FIELDS = ["email", "phone", "website", "address", "hours"]
RECORD = StructType([*(StructField(k, StringType()) for k in _FIELDS), StructField("social_links", MapType(StringType(), StringType()))])
# Whose profile pages a structured record may name.
PROFILES = {"facebook.com": "facebook", "instagram.com": "instagram", "linkedin.com": "linkedin", "twitter.com": "twitter", "x.com": "twitter", "youtube.com": "youtube", "tiktok.com": "tiktok"}
_BLOCK = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.I | re.S)


def _texts(node, key: str):
    """All non-blank texts under a key, outermost first, at any depth."""
    todo = [node]
    while todo:
        here = todo.pop(0)
        if isinstance(here, dict):
            if isinstance(here.get(key), str) and here[key].strip():
                yield here[key].strip()
            todo = [*here.values(), *todo]
        elif isinstance(here, list):
            todo = [*here, *todo]


def _record(page: str | None) -> dict:
    made: dict = {}

    def keep(name: str, value) -> None:
        if value and name not in made:
            made[name] = value

    for code in _BLOCK.findall(page or ""):
        try:
            block = json.loads(code)
        except (ValueError, RecursionError):
            continue
        for node in (n for n in (block if isinstance(block, list) else [block]) if isinstance(n, dict)):
            keep("email", next(_texts(node, "email"), None))
            keep("phone", next(_texts(node, "telephone"), None) or next(_texts(node, "phone"), None))
            at = node.get("address")
            keep("address", ", ".join(str(at[k]) for k in ("streetAddress", "addressLocality", "postalCode") if at.get(k)) if isinstance(at, dict) else at.strip() if isinstance(at, str) else None)
            keep("hours", node.get("openingHours") if isinstance(node.get("openingHours"), str) else None)
            link = node.get("url")
            keep("website", link if isinstance(link, str) and link.startswith(("http://", "https://")) else None)
            same, profiles = node.get("sameAs"), {}
            for u in [same] if isinstance(same, str) else same if isinstance(same, list) else []:
                host = urlparse(u).netloc.lower().removeprefix("www.") if isinstance(u, str) else ""
                name = next((p for d, p in PROFILES.items() if host == d or host.endswith("." + d)), None)
                if name:
                    profiles[name] = u  # the last of a list, the first of several records
            if profiles:
                made["social_links"] = profiles | made.get("social_links", {})
    return made


@pandas_udf(RECORD)
def structured_record(c: pd.Series) -> pd.DataFrame:
    """Contact fields out of every JSON-LD block of a page, the first of each; what a page lacks, or can't be read, is null."""
    rows = [_record(x) for x in c]
    return pd.DataFrame({k: pd.Series([r.get(k) for r in rows], dtype=object) for k in (*_FIELDS, "social_links")})
