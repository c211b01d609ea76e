"""Problem 5: cutting oversized texts into pieces under a limit, at natural boundaries, with overlap.

Method: agglomerative merging. A text is broken into atomic segments; adjacent pairs wait in a heap by the
strength of the boundary between them, and the weakest boundaries are merged first while the combined size
and the overlap fit.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import word_count
from corpusmill.sources.tables import table

MAX_TOKENS = 800
OVERLAP_WORDS = 37
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORD = re.compile(f"[^{_SPACE}]+")
_GAP = re.compile(f"[{_SPACE}]+")
_HEADING = re.compile(r"#{1,6}[ \t]+\S")
_ITEM = re.compile(r"(?:[-*+•]|\d+[.)])[ \t]")
_SENTENCE_END = re.compile(r"[.!?。！？…][\"'”’»)\]]*$")
_CLAUSE_END = re.compile(r"[,;:，；、]$")
WORD, CLAUSE, SENTENCE, LINE, ITEM, PARAGRAPH, HEADING = range(7)


def max_words(max_tokens: int) -> int:
    """The most words whose floor(words / 0.75) is within max_tokens."""
    return ((max_tokens + 1) * 3 - 1) // 4


def _strength(text: str, gap: re.Match, before: str) -> int:
    space = gap.group()
    lines = space.count("\n") + (space.count("\r") - space.count("\r\n")) + space.count("\u2028") + 2 * space.count("\u2029") + space.count("\x0c")
    rest = text[gap.end() : gap.end() + 12]
    if lines and _HEADING.match(rest):
        return HEADING
    if lines > 1:
        return PARAGRAPH
    if lines:
        return ITEM if _ITEM.match(rest) else LINE
    if _SENTENCE_END.search(before[-4:]):
        return SENTENCE
    return CLAUSE if _CLAUSE_END.search(before[-1:]) else WORD


def segments(text: str, most: int) -> tuple[list[int], list[int]]:
    """Atomic segments: starts, as numbers of words, and the strength of the boundary before each. No segment has more than `most` words."""
    words = [m.span() for m in _WORD.finditer(text)]
    strong = [PARAGRAPH]
    for (a, b), (c, _) in zip(words, words[1:]):
        strong.append(_strength(text, _GAP.match(text, b), text[max(a, b - 4) : b]))
    starts = [i for i, s in enumerate(strong) if i == 0 or s >= SENTENCE]
    out: list[int] = []
    for lo, hi in zip(starts, [*starts[1:], len(words)]):
        out.append(lo)
        while hi - lo > most:  # an over-long sentence: at its last clause, else anywhere between words
            cut = next((i for i in range(lo + most, lo + most // 2, -1) if strong[i] == CLAUSE), lo + most)
            out.append(cut)
            lo = cut
    return out, [strong[i] for i in out]


def pieces(text: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_WORDS) -> list[tuple[int, int, int, int]]:
    """(start, end, own words, overlap words) of each piece; start is where its overlap begins, so text[start:end] is the piece."""
    words = [m.span() for m in _WORD.finditer(text)]
    limit = max_words(max_tokens)
    if not words:
        return []
    starts, strong = segments(text, max(1, limit - overlap))
    n = len(starts)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    size = [b - a for a, b in zip(starts, [*starts[1:], len(words)])]
    heap = [(strong[j], size[j - 1] + size[j], j) for j in range(1, n)]  # j: the right side of the boundary
    heapq.heapify(heap)
    while heap:
        _, both, j = heapq.heappop(heap)
        i = before[j]
        if i == -2 or i < 0 or size[i] + size[j] != both:
            continue
        if both + (overlap if i else 0) > limit:
            continue
        size[i], after[i], before[j] = both, after[j], -2
        if (k := after[i]) >= 0:
            before[k] = i
            heapq.heappush(heap, (strong[k], size[i] + size[k], k))
        if i > 0:
            heapq.heappush(heap, (strong[i], size[before[i]] + size[i], i))
    out, i = [], 0
    while i >= 0:
        lo, hi = starts[i], starts[i] + size[i]
        carried = min(overlap, lo)  # what the piece before ends with, its own overlap included
        end = words[hi][0] if hi < len(words) else len(text)
        out.append((words[lo - carried][0] if lo else 0, end, hi - lo, carried))
        i = after[i]
    return out


def current_oversized(chunks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """file_id, chunk_id, heading_path, text, n_words of chunks whose current text is over the limit.

    The current row of a chunk has the latest indexed_at (null is oldest; equal times: the most words, then
    the larger text). Only texts over the limit travel with the keys; others are known by their counts.
    """
    n = F.coalesce(word_count(F.col("text")), F.lit(0))
    limit = max_words(max_tokens)
    rows = chunks.select("file_id", "chunk_id", F.unix_micros("indexed_at").alias("at"), n.alias("n"), F.when(n > limit, F.struct("heading_path", "text")).alias("big"))
    order = F.struct(F.coalesce("at", F.lit(-(2**63))).alias("at"), "n", F.col("big.text").alias("t"))
    last = rows.groupBy("file_id", "chunk_id").agg(F.max_by(F.struct("n", "big"), order).alias("w"))
    return last.where(F.col("w.n") > limit).select("file_id", "chunk_id", "w.big.heading_path", "w.big.text", F.col("w.n").alias("n_words"))


def split_oversized(oversized: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """The ordered pieces of each text: file_id, chunk_id, piece, heading_path, start, n_tokens, overlap_words, text.

    A piece has at most max_tokens tokens with its overlap, which is the last `overlap` words before it in the
    text (all of them, if there are fewer); the piece before it ends with these, though they may be its own overlap. heading_path is the chunk's own, followed by the last heading
    in the text before the piece's own words. Null and blank texts have no pieces.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, c, path, text in zip(b["file_id"], b["chunk_id"], b["heading_path"], b["text"]):
                heading = None
                for k, (start, end, own, carried) in enumerate(pieces(text or "", max_tokens, overlap)):
                    part = text[start:end]
                    fresh = [m.start() for m in _WORD.finditer(part)][carried]
                    here = re.match(r"(#{1,6})[ \t]+([^\r\n]+)", part[fresh:])
                    heading = here.group(2).strip() if here else heading
                    rows.append((f, c, k, " > ".join(x for x in (path, heading) if x), start, (own + carried) * 4 // 3, carried, part))
                    for m in re.finditer(r"^#{1,6}[ \t]+([^\r\n]+)", part[fresh:], re.M):
                        heading = m.group(1).strip()
            if rows:
                yield pd.DataFrame(rows, columns=["file_id", "chunk_id", "piece", "heading_path", "start", "n_tokens", "overlap_words", "text"])

    return oversized.select("file_id", "chunk_id", "heading_path", "text").mapInPandas(
        run, "file_id string, chunk_id string, piece int, heading_path string, start int, n_tokens int, overlap_words int, text string"
    )


def p5_pieces(spark, sf_dir):
    return split_oversized(current_oversized(table(spark, sf_dir, "chunks")))


def p5_found(spark, sf_dir):
    return p5_pieces(spark, sf_dir).where("piece = 0").select("file_id", "chunk_id")


_WS = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}
SQL = {
    "p5_found": f"""WITH r AS (SELECT file_id, chunk_id, len(regexp_extract_all(coalesce(text, ''), '[^{_WS}]+')) AS n,
      row_number() OVER (PARTITION BY file_id, chunk_id ORDER BY indexed_at DESC NULLS LAST, len(regexp_extract_all(coalesce(text, ''), '[^{_WS}]+')) DESC) AS r FROM chunks)
    SELECT file_id, chunk_id FROM r WHERE r = 1 AND floor(n / 0.75) > 800"""
}
