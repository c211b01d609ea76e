"""Front blocks, fields, fences and marked names of Markdown texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRONT = r"(?s)^(?:\x{FEFF})?---[ \t]*\r?\n(.*?)(?<=\n)---[ \t]*(?:\r?\n|\z)"
_FIELD = r"(?dm)^([A-Za-z_][A-Za-z0-9_-]*)[ \t]*:[ \t]*([^\r\n]*)"


def front_block(c: Column) -> Column:
    """The lines between the --- lines at the top of a text; blank if there is no such block, null for null."""
    return F.regexp_extract(c, FRONT, 1)


def front_fields(c: Column) -> Column:
    """Array of (field, value) of the top block's `key: value` lines in their order, values without outer blanks and quotes."""
    block = front_block(c)
    pairs = F.arrays_zip(F.regexp_extract_all(block, F.lit(_FIELD), F.lit(1)).alias("field"), F.regexp_extract_all(block, F.lit(_FIELD), F.lit(2)).alias("value"))
    return F.transform(pairs, lambda p: F.struct(p["field"].alias("field"), F.regexp_replace(p["value"], r"^[ \t'\"]+|[ \t'\"]+$", "").alias("value")))


def field_line(c: Column, name: str) -> Column:
    """The value on a field's own line anywhere in a text, never of the next line; null if there is no such line."""
    pattern = rf"(?dm)^{name}[ \t]*:[ \t]*([^\r\n]*)"
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, 1))


def with_field(c: Column, name: str, value: str) -> Column:
    """The text with the field's line giving another value; texts without the line stay as they are. value is taken literally."""
    literal = value.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(c, rf"(?dm)^({name}[ \t]*:)[^\r\n]*", rf"$1 {literal}")


def code_lines(c: Column) -> Column:
    """struct(fences, lines): lines that open or close a fence, and lines inside fences; an open fence runs to the end. Null for null."""
    start = F.struct(F.lit(0).alias("fences"), F.lit(0).alias("lines"))
    fence = lambda x: F.regexp_like(x, F.lit(r"^[ \t]*```"))
    inside = lambda s: s["fences"] % 2 == 1
    return F.aggregate(F.split(c, "\n"), start, lambda s, x: F.struct((s["fences"] + F.when(fence(x), 1).otherwise(0)).alias("fences"), (s["lines"] + F.when(inside(s) & ~fence(x), 1).otherwise(0)).alias("lines")))


def marked_names(c: Column) -> Column:
    """Names between single back-ticks within a line."""
    return F.regexp_extract_all(c, F.lit(r"(?:^|[^`])`([^`\r\n]+)`"), F.lit(1))


def without_front(c: Column) -> Column:
    """The text after its top block; the text itself if it has none, null for null."""
    return F.regexp_replace(c, FRONT, "")


def stripped_body(c: Column) -> Column:
    """struct(body, blocks): the text after its top block, without later blocks of fields between --- lines, and how many there were.

    Only texts with a top block lose later ones. Blocks are tried in order; one in which fewer than three fifths of
    the lines that aren't blank are `key: value` ends the search, and all from there on stays, as does a block that
    isn't closed. A block that goes leaves one blank line. Delimiters that stay lose blanks at their end. Null for null.
    """
    parts = F.split(without_front(c), r"\n---[ \t]*(?=\n)", -1)
    lines = lambda x: F.filter(F.split(x, "\n"), lambda y: F.trim(y) != "")
    fields = lambda x: F.filter(lines(x), lambda y: F.regexp_like(y, F.lit(r"^[A-Za-z_][A-Za-z0-9_-]*[ \t]*:")))
    plain = lambda x: (F.size(lines(x)) == 0) | (F.size(fields(x)) * 5 < F.size(lines(x)) * 3)
    had = F.regexp_like(c, F.lit(FRONT))
    with_stop = F.struct(parts.alias("p"), F.filter(F.transform(parts, lambda x, i: F.when((i % 2 == 1) & (~had | (i == F.size(parts) - 1) | plain(x)), i)), lambda i: i.isNotNull()).alias("s"))
    done = F.transform(F.array(with_stop), lambda w: F.struct(w["p"].alias("p"), F.coalesce(F.get(w["s"], F.lit(0)), F.size(w["p"])).cast("int").alias("stop")))
    made = F.transform(done, lambda w: F.struct(
        F.concat(
            F.array_join(F.filter(w["p"], lambda x, i: (i < w["stop"]) & (i % 2 == 0)), "\n\n"),
            F.array_join(F.transform(F.filter(w["p"], lambda x, i: i >= w["stop"]), lambda x: F.concat(F.lit("\n---"), x)), ""),
        ).alias("body"), (w["stop"] / 2).cast("int").alias("blocks"),
    ))
    return F.when(c.isNotNull(), F.get(made, F.lit(0)))


#: The entities that pages use most, & last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def html_text(c: Column) -> Column:
    """The text of a page: scripts, styles, comments and tags dropped, a line for each block, blanks folded. Null for null."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->", " ")
    lined = F.regexp_replace(F.regexp_replace(bare, r"[\s\x{A0}]+", " "), r"(?i)<br\s*/?>|</?(p|div|section|article|header|footer|main|nav|ul|ol|li|table|tr|h[1-6]|blockquote|pre|title)\b[^>]*>", "\n")
    text = F.regexp_replace(lined, r"</?[A-Za-z!][^>]*>", "")
    for entity, plain in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]*\n[ \t\n]*", "\n"), r" {2,}", " "), r"^\s+|\s+$", "")
