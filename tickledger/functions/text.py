"""Redaction of report and log text with built-in regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import LABEL_PREFIX, steamid_label

# fixed values: tokens and patterns
URL_TOKEN, PATH_TOKEN, QUERY_TOKEN = "<url>", "<path>", "<redacted>"
URL = r"(?i)https?://[^\s'\"<>]+"
WIN_PATH = r"\\\\[^\s'\"<>|]+|[A-Za-z]:[\\/][^\s'\"<>|]*"
POSIX_PATH = r"(^|[\s'\"(=])/(?:[^\s/'\"<>]+/)+[^\s'\"<>]*"
STEAMID = r"(^|[^0-9])(7656119[0-9]{10})($|[^0-9])"
URL_QUERY = r"(?i)(https?://[^\s'\"<>?]+)\?[^\s'\"<>]+"
PATH_QUERY = r"(/[^\s'\"<>?]*)\?[^\s'\"<>]+"
BEARER = r"(?i)(Bearer\s+)[^\s'\"<>]+"


def scrub_ids(s: Column, prefix: str = LABEL_PREFIX) -> Column:
    """Every 17-digit player id to its label, one distinct id after the other."""
    found = F.array_distinct(F.regexp_extract_all(s, F.lit(r"(7656119[0-9]{10})"), F.lit(1)))
    start = F.struct(s.alias("s"))

    def one(acc: Column, i: Column) -> Column:
        pattern = F.concat(F.lit("(?<![0-9])"), i, F.lit("(?![0-9])"))
        return F.struct(F.regexp_replace(acc["s"], pattern, steamid_label(i.cast("bigint"), prefix)).alias("s"))

    return F.when(s.isNotNull(), F.aggregate(found, start, one)["s"])


def scrub_report(s: Column, show_ids: bool = False, prefix: str = LABEL_PREFIX) -> Column:
    """Report text: URLs and absolute paths to tokens, player ids to labels."""
    s = F.regexp_replace(s, URL, URL_TOKEN)
    s = F.regexp_replace(s, WIN_PATH, PATH_TOKEN)
    s = F.regexp_replace(s, POSIX_PATH, "$1" + PATH_TOKEN)
    return s if show_ids else scrub_ids(s, prefix)


def redact_log(s: Column) -> Column:
    """Log text: query strings of URLs and paths and bearer tokens are cut."""
    s = F.regexp_replace(s, URL_QUERY, "$1?" + QUERY_TOKEN)
    s = F.regexp_replace(s, PATH_QUERY, "$1?" + QUERY_TOKEN)
    return F.regexp_replace(s, BEARER, "$1" + QUERY_TOKEN)


def leaks(s: Column, name: str, show_ids: bool = False) -> Column:
    """Array of ``<kind> in <name>`` for everything a report must not hold."""
    no_url = F.regexp_replace(s, URL, URL_TOKEN)
    found = [
        F.when(s.rlike(URL), F.lit(f"url in {name}")),
        F.when(no_url.rlike(WIN_PATH) | no_url.rlike(POSIX_PATH), F.lit(f"path in {name}")),
    ]
    if not show_ids:
        found.append(F.when(s.rlike(STEAMID), F.lit(f"steamid in {name}")))
    return F.array_compact(F.array(*found))
