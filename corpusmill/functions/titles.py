"""Repairing titles: each rule gives a value and the reason for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill import config as C
from corpusmill.functions.markdown import without_front

#: Titles that say nothing.
EMPTY_TITLES = ["", "untitled", "null", "none", "nan", "~", "-", "n/a", "title", "home", "index", "document", "no title", "tbd", "unknown"]


def join_spaced_capitals(c: Column) -> Column:
    """T H E  C O S T as THE COST: single capitals with single blanks between, words parted by more."""
    joined = F.regexp_replace(c, r"(?<=\b\p{Lu}) (?=\p{Lu}\b)", "")
    return F.when(F.regexp_like(c, F.lit(r"^\s*\p{Lu}(?: +\p{Lu}\b){3,}\s*$")), F.trim(F.regexp_replace(joined, " {2,}", " "))).otherwise(c)


def join_small_capitals(c: Column) -> Column:
    """L ANGUAGE M ODELS as Language Models: a capital parted from a run of two or more, which small capitals leave behind."""
    halves = F.split(F.regexp_replace(c, r"\b([A-Z])\s+([A-Z]{2,})\b", "\x01$1\x02$2\x01"), "\x01")
    whole = F.transform(halves, lambda x: F.when(F.contains(x, F.lit("\x02")), F.concat(F.substring_index(x, "\x02", 1), F.lower(F.substring_index(x, "\x02", -1)))).otherwise(x))
    return F.array_join(whole, "")


def from_slug(c: Column) -> Column:
    """A slug or file name as words: extension, hash suffix and separators removed, first letters large."""
    bare = F.regexp_replace(F.regexp_replace(c, r"\.[A-Za-z0-9]{1,5}$", ""), r"[_-][0-9a-f]{8}$", "")
    return F.initcap(F.trim(F.regexp_replace(bare, r"[-_+.\s]+", " ")))


def from_url(c: Column) -> Column:
    """The last part of a URL's path as words; blank if there is none."""
    path = F.regexp_extract(F.trim(c), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^?#]*)", 1)
    return from_slug(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1))


def is_meaningless(c: Column) -> Column:
    """True for null, blank and empty titles, bare numbers, hashes and addresses."""
    t = F.lower(F.trim(c))
    return F.coalesce(t.isin(EMPTY_TITLES) | F.regexp_like(t, F.lit(r"^([0-9\W_]+|[0-9a-f]{8,}|https?://\S*|\S+\.(pdf|html?|md|docx?))$")), F.lit(True))


def fixed_title(title: Column, url: Column, filename: Column) -> Column:
    """struct(value, reason): the title itself, or the first source that gives one; reason is blank if nothing changed."""
    spaced = join_small_capitals(join_spaced_capitals(title))
    u, f = from_url(url), from_slug(filename)
    give = lambda v, r: F.struct(v.alias("value"), F.lit(r).alias("reason"))
    site = F.lower(F.regexp_replace(F.trim(title), r"^[\"']+|[\"']+$", "")).isin(C.SITE_TITLES)
    return (
        F.when(site & ~is_meaningless(u), give(u, "site name")).when(is_meaningless(title) & ~is_meaningless(u), give(u, "from url")).when(is_meaningless(title) & ~is_meaningless(f), give(f, "from file name"))
        .when(is_meaningless(title), give(F.lit(""), "meaningless")).when(spaced != title, give(spaced, "spaced capitals")).otherwise(give(F.trim(title), ""))
    )


def looks_like_authors(c: Column) -> Column:
    """True for texts that are only names joined by commas, semicolons or and."""
    name = r"\p{Lu}[\p{L}.'-]*(?: \p{Lu}[\p{L}.'-]*){1,3}"
    return F.coalesce(F.regexp_like(F.trim(c), F.lit(rf"^{name}(?:(?:, | and |; ){name})+$")), F.lit(False))


def from_body(c: Column) -> Column:
    """The first heading of level one or two after the top block that says something, blanks folded, at most 200 characters; null if there is none."""
    heads = F.filter(F.split(without_front(c), r"\r?\n"), lambda x: F.regexp_like(x, F.lit(r"^[ \t]*##? +[^ \t]")))
    said = F.transform(heads, lambda x: F.substring(F.trim(F.regexp_replace(F.regexp_replace(x, r"^[ \t]*##? +", ""), r"[ \t]+", " ")), 1, 200))
    return F.get(F.filter(said, lambda x: (F.length(x) > 2) & ~is_meaningless(x)), F.lit(0))


def from_file_name(c: Column) -> Column:
    """A file name as it stands, without extension and hash suffix, runs of _ as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\.[^.]*$", ""), r"_[0-9a-f]{8}$", ""), "_+", " "))
