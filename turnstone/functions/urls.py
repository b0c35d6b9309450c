"""Identifiers inside links, and links that must not be followed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.functions.text import col, strip

# The forms of links to a video, tried in this order.
VIDEO_LINKS = [
    r"(?:https?://)?(?:www\.|m\.)?youtube\.com/watch\?(?:.*&)?v=([a-zA-Z0-9_-]{11})",
    r"(?:https?://)?youtu\.be/([a-zA-Z0-9_-]{11})",
    r"(?:https?://)?(?:www\.)?youtube\.com/(?:embed|v)/([a-zA-Z0-9_-]{11})",
    r"(?:https?://)?(?:www\.)?youtube\.com/shorts/([a-zA-Z0-9_-]{11})",
    r"(?:https?://)?(?:www\.)?youtube\.com/live/([a-zA-Z0-9_-]{11})",
]
VIDEO_ID = "^[a-zA-Z0-9_-]{11}$"

# Suffixes of video files.
VIDEO_SUFFIXES = ["mp4", "mkv", "mov", "webm", "avi", "m4v", "flv", "ts", "wmv", "mpeg", "mpg", "3gp"]

# Ports and networks of internal services.
BANNED_PORTS = [21, 22, 23, 25, 53, 69, 110, 111, 135, 137, 138, 139, 143, 389, 445, 636, 1433, 1521, 2049, 2375, 2376, 3306, 3389, 5432, 5900, 6379, 9200, 11211, 27017]
BANNED_NETWORKS = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4"]
BANNED_V6 = r"(?i)^\[?(?:::1|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)\]?$"


def _first(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def video_id(c: str | Column) -> Column:
    """The eleven-character id in a link or on its own; null if there is none."""
    s = strip(c)
    query = F.try_parse_url(s, F.lit("QUERY"), F.lit("v"))
    host = F.try_parse_url(s, F.lit("HOST"))
    other = F.when(F.contains(host, F.lit("youtube")) & query.rlike(VIDEO_ID), query)
    return F.coalesce(F.when(s.rlike(VIDEO_ID), s), *[_first(s, p) for p in VIDEO_LINKS], other)


def playlist_id(c: str | Column) -> Column:
    return _first(strip(c), r"[?&]list=([a-zA-Z0-9_-]+)")


def route(c: str | Column) -> Column:
    """'file', 'playlist', 'video' or 'unknown' for one line of input, in that order of preference."""
    s = strip(c)
    suffix = F.lower(F.regexp_extract(s, r"\.([^./\\?#]+)$", 1))
    listed = playlist_id(s).isNotNull() & (F.contains(s, F.lit("youtube.com/playlist")) | video_id(s).isNull())
    local = ~s.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://") & suffix.isin(VIDEO_SUFFIXES)
    return F.when(local, "file").when(listed, "playlist").when(video_id(s).isNotNull(), "video").otherwise("unknown")


def ip_number(host: str | Column) -> Column:
    """An IPv4 literal as a number; null for anything else."""
    p = F.split(col(host), r"\.")
    ok = col(host).rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    return F.when(ok, F.aggregate(p, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long")))


def in_network(number: Column, cidr: str) -> Column:
    base, bits = cidr.split("/")
    low = sum(int(x) << s for x, s in zip(base.split("."), (24, 16, 8, 0)))
    return number.between(low, low + (1 << (32 - int(bits))) - 1)


def link_problem(c: str | Column) -> Column:
    """Why a link must not be followed, null if nothing speaks against it. Host names are not looked up."""
    s = strip(c)
    scheme = F.lower(F.regexp_extract(s, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    authority = F.regexp_extract(s, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(F.regexp_replace(authority, "^[^@]*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1))
    port = F.expr("null").cast("int") if c is None else F.try_to_number(F.nullif(F.regexp_extract(authority, r":(\d+)$", 1), F.lit("")), F.lit("999999")).cast("int")
    number = ip_number(host)
    internal = F.lit(False)
    for cidr in BANNED_NETWORKS:
        internal = internal | F.coalesce(in_network(number, cidr), F.lit(False))
    return (
        F.when(F.coalesce(s, F.lit("")) == "", "empty")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(F.contains(authority, F.lit("@")), "credentials")
        .when(host == "", "host")
        .when(host.isin("localhost", "localhost.localdomain"), "localhost")
        .when(port.isin(BANNED_PORTS), "port")
        .when(internal | host.rlike(BANNED_V6), "network")
    )
