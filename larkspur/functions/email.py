"""E-mail addresses: found, scored, validated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.html import unescape

EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
# Hosts, endings and local parts that decide what an address is worth.
BLOCKED_DOMAINS = ["sentry.io", "example.com", "wixpress.com", "godaddy.com", "schema.org"]
ASSET_ENDINGS = ["png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "css", "js", "json", "woff", "woff2", "ttf", "map", "mp4", "webm"]
DISPOSABLE = ["mailinator.com", "yopmail.com", "guerrillamail.com", "sharklasers.com", "trashmail.com", "10minutemail.com", "temp-mail.org", "throwawaymail.com", "tempmail.com", "maildrop.cc", "getnada.com", "dispostable.com", "mytemp.email", "fakeinbox.com", "mailnesia.com", "spamgourmet.com", "tempinbox.com", "discard.email", "emailondeck.com"]
SYSTEM_LOCALS = ["noreply", "no-reply", "no_reply", "donotreply", "do-not-reply", "mailer", "mailer-daemon", "postmaster", "webmaster", "abuse", "admin", "support-mail"]
SYSTEM_PREFIXES = ["noreply", "no-reply", "donotreply", "mailer", "postmaster", "webmaster", "abuse"]
PLACEHOLDER = "your|example|test|demo|sample|dummy|xxxx|yourdomain|email@"
GOOD_LOCALS = ["info", "contact", "hello", "hi", "sales", "bookings", "booking", "reservations", "reservation", "reception", "office", "admin", "manager"]
PORTALS = ["facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "yelp.com", "tripadvisor.com", "maps.google.com", "goo.gl", "youtube.com", "wikipedia.org", "foursquare.com", "justdial.com", "yellowpages.com", "waze.com", "maps.apple.com", "bing.com", "openstreetmap.org", "about.me", "linktr.ee", "linkin.bio", "beacons.ai", "netlify.app", "vercel.app", "github.io", "gitlab.io", "surge.sh", "pages.dev", "firebaseapp.com", "webflow.io", "wixsite.com"]
MOST = 40


def local_part(c: Column) -> Column:
    return F.substring_index(c, "@", 1)


def domain(c: Column) -> Column:
    return F.substring_index(c, "@", -1)


def collect_emails(text: Column, blocked: list[str] = BLOCKED_DOMAINS) -> Column:
    """Distinct lower-cased addresses in order of appearance, at most 40, without assets and boilerplate hosts."""
    found = F.transform(F.regexp_extract_all(unescape(text), F.lit(EMAIL), F.lit(0)), F.lower)
    keep = F.filter(found, lambda e: ~domain(e).isin(blocked) & ~F.substring_index(e, ".", -1).isin(ASSET_ENDINGS))
    return F.slice(F.array_distinct(keep), 1, MOST)


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)", 1), r"^www\.", "")


def own_domain(email: Column, website: Column) -> Column:
    """The address's domain and the site's host are equal, or one is a sub-domain of the other; portals never match."""
    d, h = domain(F.lower(email)), host(website)
    portal = F.exists(F.array(*map(F.lit, PORTALS)), lambda p: (h == p) | h.endswith(F.concat(F.lit("."), p)))
    same = (d == h) | d.endswith(F.concat(F.lit("."), h)) | h.endswith(F.concat(F.lit("."), d))
    return F.coalesce((h != "") & (d != "") & same & ~portal, F.lit(False))


def score_email(email: Column, website: Column | None = None) -> Column:
    e = F.lower(email)
    local, d = local_part(e), domain(e)
    own = F.when(own_domain(e, website), 40).otherwise(0) if website is not None else F.lit(0)
    desk = F.when(local.isin(SYSTEM_LOCALS), -30).when(local.isin(GOOD_LOCALS), 10).otherwise(0)
    official = F.when(d.endswith(".gov") | d.endswith(".edu"), -5).otherwise(0)
    return own + F.when(d.isin(DISPOSABLE), -40).otherwise(0) + F.when(local.rlike(f"(?i){PLACEHOLDER}"), -25).otherwise(0) + desk + official


def first_best(values: Column, score) -> Column:
    """The value of the highest score, the first among equals; null of an empty array."""
    ranked = F.transform(values, lambda v, i: F.struct(score(v).alias("s"), (-i).alias("o"), v.alias("v")))
    return F.array_max(ranked)["v"]


def best_email(text: Column, website: Column | None = None, preferred: Column | None = None) -> Column:
    found = collect_emails(text)
    top = first_best(found, lambda e: score_email(e, website))
    junk = domain(top).isin(DISPOSABLE) & local_part(top).rlike(f"(?i){PLACEHOLDER}")
    top = F.when(~junk, top)
    if preferred is None:
        return top
    p = F.lower(F.trim(preferred))
    return F.when(F.coalesce(F.array_contains(found, p), F.lit(False)), p).otherwise(top)


def mailto(html: Column) -> Column:
    link = F.regexp_extract(html, "(?i)mailto:([^\"'?\\s]+)", 1)
    address = F.lower(F.trim(F.try_url_decode(link)))
    return F.when(address.rlike(f"^{EMAIL}$"), address)


def protected_address(html: Column) -> Column:
    """The address that a page hides as hex digits, each byte XORed with the first."""
    code = F.regexp_extract(html, 'data-cfemail="([0-9a-fA-F]+)"', 1)
    byte = lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int")
    chars = F.transform(F.sequence(F.lit(3), F.length(code) - 1, F.lit(2)), lambda i: F.char(byte(i).bitwiseXOR(byte(F.lit(1)))))
    plain = F.when((F.length(code) >= 4) & (F.length(code) % 2 == 0), F.lower(F.array_join(chars, "")))
    return F.when(plain.rlike(f"^{EMAIL}$"), plain)


def validate_email(c: Column, has_mx: Column | None = None) -> Column:
    """The cleaned address if a person may read it, else null; has_mx: whether its domain takes mail, where known."""
    e = F.lower(F.trim(c))
    local, d = local_part(e), F.substring(e, F.instr(e, "@") + 1, F.length(e))
    last = F.substring_index(e, "@", -1)
    prefix = "^(?:" + "|".join(SYSTEM_PREFIXES) + ")"
    ok = (F.instr(e, "@") > 0) & (F.instr(last, ".") > 0) & F.length(local).between(1, 64) & (F.length(d) <= 255)
    ok &= ~local.isin(SYSTEM_LOCALS) & ~local.rlike(prefix) & ~local.rlike(f"(?i){PLACEHOLDER}") & ~d.isin(DISPOSABLE)
    return F.when(ok & (F.lit(True) if has_mx is None else F.coalesce(has_mx, F.lit(True))), e)


def predicted(first: Column, last: Column, domain_: Column) -> Column:
    """Usual address forms of a person at a domain, likeliest first, without repeats."""
    f, n = (F.regexp_replace(F.lower(F.trim(c)), "[^a-z]", "") for c in (first, last))
    fi, li = F.left(f, F.lit(1)), F.left(n, F.lit(1))
    joins = [(f, ".", n), (f, "", n), (fi, "", n), (fi, ".", n), (f, "", li), (f, "_", n), (f, "-", n), (f, "", ""), (n, "", ""), (n, ".", f), (n, "", f), (n, "", fi)]
    forms = [F.concat(a, F.lit(j), b if not isinstance(b, str) else F.lit(b)) for a, j, b in joins]
    made = F.transform(F.array_distinct(F.filter(F.array(*forms), lambda x: x.rlike("^[a-z].*[a-z]$|^[a-z]$"))), lambda x: F.concat(x, F.lit("@"), F.lower(domain_)))
    return F.when((f != "") & (n != "") & (domain_ != ""), made).otherwise(F.array().cast("array<string>"))
