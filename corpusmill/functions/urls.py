"""URL, title, name and date expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill import config as C

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def canonical_url(c: Column) -> Column:
    """Scheme and host in lower case, one www. dropped, no tracking parameters, fragment or trailing slash; blank for what is no URL."""
    u = F.trim(F.regexp_replace(c, r"\s+", " "))
    part = lambda i: F.regexp_extract(u, _URL, i)
    host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    kept = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.regexp_like(F.lower(p), F.lit("^(" + "|".join(C.TRACKING) + ")")))
    query = F.array_join(kept, "&")
    joined = F.concat(F.lower(part(1)), F.lit("://"), host, F.regexp_replace(part(3), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.coalesce(F.regexp_like(u, F.lit(_URL)), F.lit(False)), joined).otherwise("")


def host_of(c: Column) -> Column:
    """Host in lower case without one www.; blank if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(F.trim(c), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)", 1)), r"^www\.", ""), F.lit(""))


def canonical_title(c: Column) -> Column:
    """Lower case, everything but letters, digits and _ as single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\p{M}_]+", " "))


def handler(c: Column) -> Column:
    """arxiv, pdf or web."""
    u = F.lower(F.trim(c))
    return F.when(F.regexp_like(u, F.lit(r"^https?://([a-z0-9.]+\.)?arxiv\.org/")), "arxiv").when(F.regexp_like(u, F.lit(r"\.pdf([?#].*)?$")), "pdf").when(u != "", "web")


def fetched_url(c: Column) -> Column:
    """The address a fetch takes, and hashes: an arXiv paper's one PDF address, else the URL itself."""
    number = F.regexp_extract(c, r"arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,6})", 1)
    return F.when(number != "", F.concat(F.lit("https://arxiv.org/pdf/"), number, F.lit(".pdf"))).otherwise(F.trim(c))


def arxiv_id(c: Column) -> Column:
    """The arXiv number that stands on its own in an address or a file name; null if there is none."""
    x = F.regexp_extract(c, r"(?<![0-9.])([0-9]{4}\.[0-9]{4,6})(?![0-9])", 1)
    return F.when(x != "", x)


def url_hash(c: Column) -> Column:
    """First 8 hex digits of the sha1."""
    return F.substring(F.sha1(c), 1, 8)


def hash_suffix(c: Column) -> Column:
    """The 8 hex digits that end a file name before its extension, after _; null if there are none."""
    x = F.regexp_extract(c, r"_([0-9a-f]{8})\.[A-Za-z0-9]+$", 1)
    return F.when(x != "", x)


def file_slug(c: Column, most: int = 80) -> Column:
    """Runs of other characters than letters, digits, dot, _ and - as one _."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", ""), 1, most)


def topic_slug(c: Column, most: int = 60) -> Column:
    """Lower-case letters and digits, joined by -."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, most)


def indexable(c: Column) -> Column:
    """True unless a path is hidden, trashed, staged, part of the index or logs, a document about the collection, or an audit."""
    parts = F.split(c, "/")
    name = F.element_at(parts, -1)
    has = lambda p: F.array_contains(parts, p)
    root = F.size(parts) == 1
    out = [
        F.exists(parts, lambda p: p.startswith(".")), has("_trash"), has("_add_by_me"), has("_index") & ~has("saved_queries"), has("_logs"),
        root & (name.isin(C.META_DOCUMENTS) | name.startswith("_")), F.regexp_like(name, F.lit(r"^_audit_.*\.md$")),
    ]
    return ~reduce(lambda a, b: a | b, out)


def fetch_slug(c: Column, most: int = 120) -> Column:
    """A title as the name of a fetched file: characters other than letters, digits, _, blanks and - dropped, runs of blanks as one _."""
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_ \t-]+", "")), r"[ \t]+", "_"), 1, most)


def sidecar_path(c: Column) -> Column:
    """True for paths that get a row in the sidecar: indexable, and in no inbox, trash, folder of duplicates, audit or health check."""
    old = r"/_inbox/|/_trash_|/_dupes_|(^|/)(_audit_|_health_check_)[^/]*$"
    return indexable(c) & ~F.regexp_like(F.concat(F.lit("/"), c), F.lit(old))


def comparable_path(c: Column) -> Column:
    """True for paths that take part in the search for duplicates: outside of trash, index, settings, inbox and folders of duplicates."""
    return ~F.regexp_like(F.concat(F.lit("/"), c), F.lit(r"/(_trash|_index|\.obsidian|_inbox)/|/_dupes_|/_trash_"))


def clean_day(c: Column) -> Column:
    """An ISO day at the start of the text, from 2010 on and not the first of January; blank otherwise."""
    d = F.regexp_extract(F.trim(c), r"^(\d{4}-\d{2}-\d{2})", 1)
    day = F.try_to_date(d, "yyyy-MM-dd")
    return F.when((d != "") & day.isNotNull() & (day >= F.lit("2010-01-01").cast("date")) & ~d.endswith("-01-01"), d).otherwise("")


def scrub(c: Column) -> Column:
    """Control characters other than tab and newline as blanks."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F\x7F]", " ")


def day_problem(c: Column, today: Column) -> Column:
    """Why a text that begins with an ISO day is dropped as a day of publication; null if it is kept or has another notation."""
    iso = F.regexp_extract(F.trim(c), r"^(\d{4}-\d{2}-\d{2})", 1)
    now = F.date_format(today, "yyyy-MM-dd")
    return F.when(iso == "", None).when(iso == now, "today").when(iso.endswith("-01-01"), "first of January").when(iso > now, "in the future").when(iso < "2010", "before 2010")


def author_problem(c: Column) -> Column:
    """Why an author is dropped; null if kept."""
    found = [F.when(F.contains(c, F.lit(x)), F.lit(f"contains {x.strip()}")) for x in C.SUSPECT_AUTHORS]
    return F.coalesce(*found, F.when(F.length(F.trim(c)) > C.LONGEST_AUTHOR, F.lit("too long")))
