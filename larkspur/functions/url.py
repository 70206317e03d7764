"""Web addresses and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Link patterns by platform, and what a contact page's address looks like.
SOCIAL = {
    "facebook": r"https?://(?:www\.)?facebook\.com/[^\s\"'<>]+",
    "instagram": r"https?://(?:www\.)?instagram\.com/[^\s\"'<>]+",
    "linkedin": r"https?://(?:www\.)?linkedin\.com/[^\s\"'<>]+",
    "twitter": r"https?://(?:www\.)?(?:twitter|x)\.com/[^\s\"'<>]+",
    "youtube": r"https?://(?:www\.)?youtube\.com/@?[^\s\"'<>]+",
    "tiktok": r"https?://(?:www\.)?tiktok\.com/@[^\s\"'<>]+",
    "whatsapp": r"https?://(?:www\.)?(?:wa\.me|api\.whatsapp\.com)/[^\s\"'<>]+",
}
CONTACT_HINT = r"contact|get\s*[-_]?in\s*touch|getintouch|reach\s*us|connect\s*with|about\s*us|say\s*hello|تواصل"
CONTACT_PATHS = ["/contact", "/contact-us", "/contact.html", "/about", "/about-us"]
CHALLENGES = ["captcha", "recaptcha", "not a robot", "unusual traffic", "access denied", "verify you are human"]
ANCHOR = r"(?is)<a[^>]+href=[\"']([^\"'#]+)[\"'][^>]*>(.*?)</a>"


def normalize_website(c: Column) -> Column:
    """https, lower-cased host without www., path without trailing slashes (a bare / stays); no query, no fragment; null if there is no host."""
    raw = F.trim(c)
    full = F.when(raw.rlike("^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    host = F.regexp_replace(F.lower(F.regexp_extract(full, "^[a-z]+://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(full, "^[a-z]+://[^/?#]*([^?#]*)", 1), ";[^/]*$", "")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    return F.when((raw != "") & (host != ""), F.concat(F.lit("https://"), host, path))


def website_key(c: Column) -> Column:
    return F.substring_index(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^https?://(www\.)?", ""), "/", 1)


def anchors(html: Column) -> Column:
    """(href, text) of links without a fragment, in order; texts without tags, white space collapsed."""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("text"))
    return F.transform(pairs, lambda p: F.struct(p["href"].alias("href"), F.trim(F.regexp_replace(F.regexp_replace(p["text"], "<[^>]+>", ""), r"\s+", " ")).alias("text")))


def joined(page: Column, href: Column) -> Column:
    """The address that a page's link leads to: absolute ones stay, ./ and ../ are resolved."""
    origin = F.regexp_extract(page, "^([A-Za-z]+://[^/?#]+)", 1)
    here = F.regexp_replace(F.regexp_replace(page, "[?#].*$", ""), "(?<![:/])/[^/]*$", "")
    path = F.when(href.startswith("/"), href).otherwise(F.concat(F.substring(here, F.length(origin) + 1, F.length(here)), F.lit("/"), href))
    path = F.regexp_replace(path, r"/(?:\./)+", "/")
    for _ in range(4):
        path = F.regexp_replace(path, r"/(?!\.\./)[^/?#]+/\.\./", "/")
    path = F.regexp_replace(path, r"^(?:/\.\.)+/", "/")
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(page, "^([A-Za-z]+:)", 1), href)).otherwise(F.concat(origin, path))


def contact_pages(url: Column, html: Column, most: int = 8) -> Column:
    """Usual contact paths first, then links of the page to the same host (www. aside) whose address or text looks like one."""
    bare = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, "^[A-Za-z]+://([^/?#]*)", 1)), r"^www\.", "")
    wanted = F.filter(anchors(html), lambda a: F.concat_ws(" ", a["href"], a["text"]).rlike(f"(?i){CONTACT_HINT}"))
    found = F.filter(F.transform(wanted, lambda a: joined(url, a["href"])), lambda u: u.rlike("^https?://") & (bare(u) == bare(url)))
    usual = F.transform(F.array(*map(F.lit, CONTACT_PATHS)), lambda p: joined(url, p))
    plain = F.transform(F.concat(usual, found), lambda u: F.regexp_replace(F.regexp_replace(u, "[?#].*$", ""), "/+$", ""))
    return F.slice(F.array_distinct(plain), 1, most)


def social_links(text: Column) -> Column:
    """The first link of each platform, trailing marks removed."""
    first = [(k, F.regexp_replace(F.regexp_extract(text, f"(?i){p}", 0), r"[).,;]+$", "")) for k, p in SOCIAL.items()]
    made = F.create_map(*(x for k, v in first for x in (F.lit(k), v)))
    return F.map_filter(made, lambda k, v: v != "")


def meta_description(html: Column, most: int = 280) -> Column:
    def of(attribute: str) -> Column:
        ahead = F.regexp_extract(html, rf"(?is)<meta[^>]*{attribute}[^>]*content=[\"']([^\"']*)[\"']", 1)
        behind = F.regexp_extract(html, rf"(?is)<meta[^>]*content=[\"']([^\"']*)[\"'][^>]*{attribute}", 1)
        return F.coalesce(F.nullif(ahead, F.lit("")), F.nullif(behind, F.lit("")))

    return F.left(F.trim(F.coalesce(of("name=[\"']description[\"']"), of("property=[\"']og:description[\"']"))), F.lit(most))


def blocked_host(host: Column, domains: list[str], markers: list[str] = ()) -> Column:
    listed = F.exists(F.array(*map(F.lit, domains)), lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))
    return listed | F.lit(False) if not markers else listed | F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(host, m))


def challenge_page(status: Column, body: Column) -> Column:
    """A page that keeps robots out instead of showing its content."""
    return status.isin(403, 429) | F.lower(body).rlike("|".join(CHALLENGES))
