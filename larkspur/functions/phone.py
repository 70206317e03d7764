"""Phone numbers: found, scored, normalised. PHONE and the tests for fakes follow one rule everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.email import first_best
from larkspur.functions.html import unescape

PHONE = r"(?:\+\d{1,3}[\s-]?)?(?:\(?\d{2,4}\)?[\s-]?){2,4}\d{3,4}"
#: One match takes the label in front with it, so that positions aren't needed.
LABELLED = r"(?:(?i:tel|phone|call|contact|whatsapp|mobile|cell|hotline|helpline)\s*[:\-]?\s*)?" + PHONE
LABEL = r"^(?i)(?:tel|phone|call|contact|whatsapp|mobile|cell|hotline|helpline)\s*[:\-]?\s*"
# Numbers nobody has, dialling prefix and national length by country, and calling codes.
FAKES = ["1234567", "12345678", "123456789", "0123456789"]
DIAL = {"PK": ("92", 10), "IN": ("91", 10), "US": ("1", 10), "GB": ("44", 10), "CA": ("1", 10), "AU": ("61", 9), "AE": ("971", 9), "SA": ("966", 9), "QA": ("974", 8), "BH": ("973", 8), "KW": ("965", 8), "OM": ("968", 8), "TR": ("90", 10), "DE": ("49", 11), "FR": ("33", 9), "ES": ("34", 9), "IT": ("39", 10), "NL": ("31", 9), "SG": ("65", 8), "HK": ("852", 8), "MY": ("60", 9), "BD": ("880", 10), "NP": ("977", 10), "LK": ("94", 9)}
MOST = 30


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def fake(d: Column) -> Column:
    """Digits that are no number: too few, all alike, counted up, or ten and more after 000, 111 or 999."""
    return (F.length(d) < 7) | d.rlike(r"^(\d)\1*$") | d.isin(FAKES) | (d.rlike("^(?:000|111|999)") & (F.length(d) >= 10))


def collect_phones(text: Column) -> Column:
    """Distinct candidates in order of appearance, at most 30. A bare run of digits counts only behind a label."""
    found = F.regexp_extract_all(unescape(text), F.lit(LABELLED), F.lit(0))
    seen = F.transform(found, lambda m: F.struct(F.trim(F.regexp_replace(m, LABEL, "")).alias("v"), m.rlike(LABEL).alias("labelled")))
    seen = F.filter(seen, lambda s: F.length(digits(s["v"])).between(7, 15) & ~fake(digits(s["v"])) & (s["labelled"] | (s["v"] != digits(s["v"]))))
    keyed = F.transform(seen, lambda s: F.struct(s["v"].alias("v"), digits(s["v"]).alias("d")))
    none = F.array().cast("array<struct<v:string,d:string>>")
    again = lambda acc, x: (F.size(acc) >= MOST) | F.exists(acc, lambda y: y["d"] == x["d"])
    return F.transform(F.aggregate(keyed, none, lambda acc, x: F.when(again(acc, x), acc).otherwise(F.array_append(acc, x))), lambda s: s["v"])


def score_phone(c: Column, country: str | None = None) -> Column:
    d, t = digits(c), F.trim(c)
    form = F.when(t.startswith("+") & (d != ""), 5).when(t.startswith("0") | t.startswith("("), 2).otherwise(0)
    known = DIAL.get((country or "").upper())
    sane = F.lit(0)
    if known:
        code, national = known
        rest = F.length(d) - len(code)
        sane = F.when(d.startswith(code), F.when((rest > 0) & ~rest.between(national - 2, national + 2), -20).otherwise(5)).when(F.length(d) == national + 2, -10).otherwise(0)
    return form + sane + F.when(t.startswith("555-") | t.endswith("-5555"), -20).otherwise(0)


def best_phone(text: Column, country: str | None = None, preferred: Column | None = None) -> Column:
    found = collect_phones(text)
    top = first_best(found, lambda v: score_phone(v, country))
    if preferred is None:
        return top
    return F.coalesce(F.try_element_at(F.filter(found, lambda v: (digits(v) == digits(preferred)) & (digits(preferred) != "")), F.lit(1)), top)


def tel_link(html: Column) -> Column:
    link = F.regexp_extract(html, "(?i)tel:([^\"'\\s]+)", 1)
    return F.when(F.length(digits(link)).between(7, 15), link)


def normalize_e164(c: Column, calling_code: Column) -> Column:
    """+ and 11 to 15 digits of an international number; a national one of 6 to 11 digits behind its calling code; else null."""
    raw = F.trim(c)
    d = digits(raw)
    abroad = raw.startswith("+") | raw.startswith("00")
    intl = F.when(raw.startswith("00"), F.substring(d, F.lit(3), F.length(d))).otherwise(d)
    home = F.when(d.startswith("0") & (F.length(d) > 1), F.substring(d, F.lit(2), F.length(d))).otherwise(d)
    return F.when(abroad, F.when(F.length(intl).between(11, 15), F.concat(F.lit("+"), intl))).when(F.length(home).between(6, 11), F.concat(F.lit("+"), calling_code, home))


def normalize_phone(c: Column, country: str = "PK", calling_code: Column | None = None) -> Column:
    raw, d = F.trim(c), digits(c)
    bad = (F.length(d) < 7) | d.rlike(r"^(\d)\1*$") | d.isin(FAKES)
    kept = F.concat(F.lit("+"), d)
    if country == "PK":
        shapes = [r"^0?3[-\s]?\d{2}[-\s]?\d{7}$", r"^(?:\+?92|0092)[-\s]?3[-\s]?\d{2}[-\s]?\d{7}$", r"^0\d{2,3}[-\s]?\d{6,8}$"]
        home = F.when(raw.rlike("|".join(shapes)), F.concat(F.lit("+92"), F.right(d, F.lit(10))))
    else:
        code = calling_code if calling_code is not None else F.lit(DIAL.get(country, (None, 0))[0])
        home = F.coalesce(normalize_e164(raw, code), F.when(F.length(d).between(9, 12), d))
    return F.when(~bad, F.when(raw.startswith("+") & (F.length(d) >= 11), kept).otherwise(home))


def merge_key(c: Column) -> Column:
    return F.right(digits(c), F.lit(10))


def stored(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def for_messages(c: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(c, "[^0-9+]", ""), "^00", "+")
    return F.when(p.startswith("+"), p).otherwise(F.concat(F.lit("+"), p))


def chat_links(e164: Column) -> Column:
    d = digits(e164)
    return F.struct(F.concat(F.lit("https://wa.me/"), d).alias("whatsapp"), F.concat(F.lit("https://t.me/+"), d).alias("telegram"))
