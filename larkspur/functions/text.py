"""Names and message texts: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.html import html_unescape, unescape  # noqa: F401 - unescape is for callers

# Words that a business name is compared without, and phrases that ask to be left alone.
NAME_NOISE = ["pvt", "ltd", "llc", "inc", "limited", "private", "company", r"official\s*website", "home"]

LEAVE_ME = ["unsubscribe", "remove me", "stop emailing", "stop emailing me", "don't contact me", "do not contact me", "opt out", "not interested in emails", "stop sending me", "remove me from your list", "take me off"]


def wants_out(c: Column) -> Column:
    """Whether a message asks to be left alone."""
    return F.coalesce(F.lower(c).rlike("|".join(LEAVE_ME)), F.lit(False))


def present(c: Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def filled(c: Column) -> Column:
    """Neither null nor empty; blanks count as filled."""
    return F.coalesce(c != "", F.lit(False))


def normalize_name(c: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"\b(?:{'|'.join(NAME_NOISE)})\b", "")
    return F.regexp_replace(low, "[^a-z0-9]+", "")


def clean_business_name(c: Column) -> Column:
    head = F.trim(F.substring_index(c, "|", 1))
    return F.when(head != "", head).otherwise(c)


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# The first end of a line with the blanks around it, or all others that follow: two matches at most in a run of white space. The class that it
# starts with is only to leave other characters quickly.
_WHITE = r"[ \t\xa0\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028-\u2029]"
BREAK = rf"(?={_WHITE})(?:(?<!{_WHITE})[ \t\xa0]*+(?:{LINES})[ \t\xa0]*+|(?<={_WHITE})(?:{LINES}){_WHITE}*+)"


def collapse_blank_lines(c: Column) -> Column:
    """Lines without white space around them (hard spaces are spaces), runs of blank ones as one, none at either end."""
    return F.btrim(F.replace(F.regexp_replace(c, BREAK, "\n"), F.lit("\xa0"), F.lit(" ")), F.lit(" \t\n"))


# Where a reply ends and what it quotes begins, in the order in which they are tried.
QUOTES = [
    r"(?i)\bOn\b[^\n]*?\bwrote\s*:\s*(?:\n|$)?",
    r"(?i)\n\s*[-_]{3,}\s*\n?\s*(?:Original Message|Reply Message)\s*[-_]{3,}",
    r"\n\s*[-_]{4,}\s*\n",
    r"(?i)\n\s*(?:From|To|Sent|Cc|Bcc|Subject|Date|Reply-To|Return-Path|Message-ID|MIME-Version|Content-Type|Delivered-To):\s*\S",
    r"\n\s*>",
]
# A whole text; the group of the first of QUOTES that occurs anywhere holds what is before it.
QUOTED = r"(?s)\A(?:" + "|".join(rf"(.*?)(?:{p}).*" for p in QUOTES) + ")"
# What a message quotes: from a blockquote on, or from the first of QUOTES unless a blockquote stands between its two words.
HISTORY = r"(?is)(?:<blockquote|\bOn\b(?>[^\n]*?(?:<blockquote|\bwrote\s*:))(?<!<blockquote)).*"
# Line breaks of HTML, also where a <br> that is one itself stands in a </p>; tags and all from a blockquote on, which no tag reaches over.
BR = r"(?i)</p(?:\s|<br\s*+/?>)*+>|<br\s*+/?>"
TAG = r"(?is)<(?:blockquote.*|(?:[^<>]++|<(?!blockquote))++>)"


# In these functions each value is used once: where one is used twice, Spark works out all the steps before it for both. Texts go to Python with an
# ampersand or not for that reason. A quote is cut off by regexp_replace(), as split() compiles its pattern in every row.


def plain_message(c: Column) -> Column:
    """c without what follows a blockquote: line breaks for <br> and </p>, other tags gone, all entities decoded."""
    return html_unescape(F.regexp_replace(F.regexp_replace(c, BR, "\n"), TAG, ""))


def clean_message(c: Column) -> Column:
    """A message without quoted history, tags and light markup; a null one is empty."""
    text = plain_message(F.regexp_replace(F.coalesce(c, F.lit("")), HISTORY, ""))
    # The marks that are taken off, in this order.
    text = F.regexp_replace(F.regexp_replace(text, r"\*\*(.+?)\*\*", "$1"), "`(?!#)([^`]+?)`", "$1")
    text = F.regexp_replace(text, r"(?m)^\s*#{1,6}\s*", "")
    return collapse_blank_lines(F.regexp_replace(text, r"(?m)^\s*(?:[-*•]|\d+\.)\s+", ""))


def strip_quotes(c: Column) -> Column:
    """A reply as text without what it quotes: up to a blockquote, then up to the first of QUOTES that occurs; if nothing is left, its first 2000 characters."""
    body = collapse_blank_lines(F.regexp_replace(plain_message(c), QUOTED, "".join(f"${i + 1}" for i in range(len(QUOTES)))))
    return F.get(F.transform(F.array(body), lambda b: F.when(b != "", b).otherwise(F.left(c, F.lit(2000)))), F.lit(0))


def sender(c: Column) -> Column:
    """(name, email) of a header like ``Name <a@b>``."""
    angle = F.regexp_extract(c, "<([^>]*)>", 1)
    name = F.trim(F.regexp_replace(F.substring_index(c, "<", 1), '"', ""))
    email = F.lower(F.trim(F.when(angle != "", angle).otherwise(c)))
    return F.struct(F.when(angle != "", name).otherwise(F.lit("")).alias("name"), email.alias("email"))


def subject(c: Column, who: Column) -> Column:
    return F.when(~present(c), F.concat(F.lit("Re: Conversation with "), who)).when(F.lower(c).startswith("re:"), c).otherwise(F.concat(F.lit("Re: "), c))


def name_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 1))


def name_similarity(a: Column, b: Column) -> Column:
    """Shared name tokens over the larger number of tokens, 0 where either has none."""
    x, y = name_tokens(a), name_tokens(b)
    most = F.greatest(F.size(x), F.size(y))
    return F.when(F.least(F.size(x), F.size(y)) > 0, F.size(F.array_intersect(x, y)) / most).otherwise(0.0)


def masked(c: Column) -> Column:
    return F.concat(F.left(c, F.lit(8)), F.lit("••••"))


def template_name(body: Column) -> Column:
    return F.concat(F.lit("agent_"), F.left(F.sha1(body.cast("binary")), F.lit(8)))


def map_first(a: Column, b: Column) -> Column:
    """Both maps; where both have a key, a's value."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, y))


def map_set(c: Column, key: str, value: Column) -> Column:
    """The map with one key set."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(c), lambda e: e["key"] != key), F.array(F.struct(F.lit(key).alias("key"), value.alias("value")))))


def map_drop(c: Column, key: str) -> Column:
    return F.map_filter(c, lambda k, v: k != key)


def title(c: Column) -> Column:
    """Every run of letters with a capital first letter and small ones after it."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


ADDRESS = r"[^\s<>()\[\]\\,;:\"@]+@[^\s<>()\[\]\\,;:\"@]+"
_NAMES = ["name", "display_name", "displayName", "full_name", "sender_name", "senderName"]
_MAILS = ["email", "address", "mail", "email_address", "emailAddress", "sender_email", "senderEmail"]


def any_sender(c: Column) -> Column:
    """(name, email) of a sender however it is given: an object, ``"Name" <a@b>``, an address with or without a name, a name alone; null of blank texts."""
    made = lambda name, mail: F.struct(name.alias("name"), mail.alias("email"))
    bind = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731 - value is worked out once
    angle = r"^\"?([^\"<]*)\"?\s*<\s*([^>]+)\s*>$"

    def beside(s: Column, found: Column) -> Column:
        at = F.instr(s, found)
        rest = F.concat(F.left(s, at - 1), F.substring(s, at + F.length(found), F.length(s)))
        rest = F.trim(F.regexp_replace(F.regexp_replace(rest, "[<>\"']", ""), r"[,\s]+$", ""))
        return F.when(found == "", made(s, F.lit(""))).when(found == s, made(F.lit(""), found)).otherwise(made(rest, found))

    def of(s: Column) -> Column:
        known = lambda keys: F.trim(F.coalesce(*(F.get_json_object(F.when(s.startswith("{"), s), f"$.{k}") for k in keys), F.lit("")))
        quoted = F.regexp_replace(F.trim(F.regexp_extract(s, angle, 1)), "^[\"']+|[\"']+$", "")
        text = F.when(s.rlike(angle), made(quoted, F.trim(F.regexp_extract(s, angle, 2)))).otherwise(bind(F.regexp_extract(s, ADDRESS, 0), lambda found: beside(s, found)))
        given = bind(made(known(_NAMES), known(_MAILS)), lambda g: F.when((g["name"] != "") | (g["email"] != ""), g).otherwise(text))
        return F.when(s != "", given)

    return bind(F.regexp_replace(c, r"^\s+|\s+$", ""), of)


def with_parameter(body: Column, name: Column) -> Column:
    """A message as a template for all: the first name of its recipient replaced by {{1}}, or {{1}} put behind it if the name isn't in it."""
    first = F.regexp_extract(F.coalesce(name, F.lit("")), r"\S+", 0)
    return F.when((first != "") & F.contains(body, first), F.replace(body, first, F.lit("{{1}}"))).otherwise(F.concat(body, F.lit(" {{1}}")))


# The texts of letters that are sent out.
SHELL = '<div style="font-family:sans-serif">%s</div>'
OUTREACH = "<p>Hi %s,</p><p>Thanks for your interest — I'm reaching out from <strong>%s</strong>.</p><p>Would you have a few minutes this week to connect?</p><p>Best regards,<br/>%s</p>"


def outreach_letter(name: Column, workspace: Column) -> Column:
    return F.format_string(SHELL.replace("%s", OUTREACH), name, workspace, workspace)


def paragraphs(body: Column) -> Column:
    """The non-blank lines of a text as paragraphs of a letter."""
    lines = F.filter(F.split(body, LINES), present)
    return F.concat(F.lit(SHELL.split("%s")[0]), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), ""), F.lit(SHELL.split("%s")[1]))
