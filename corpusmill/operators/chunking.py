"""Cutting bodies into chunks under heading paths, with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill import config as C

_HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*$")


def tokens_of(text: str) -> int:
    return max(1, int(len(text.split()) / C.WORDS_PER_TOKEN))


def blocks_of(body: str) -> Iterator[tuple[str, str]]:
    """(heading path, text) between headings; levels that were skipped leave no mark in the path."""
    path, lines = {}, []
    for line in [*body.splitlines(), None]:
        found = _HEADING.match(line) if line is not None else None
        if line is None or found:
            if text := "\n".join(lines).strip():
                yield " > ".join(path[d] for d in sorted(path)), text
            lines = []
        if found:
            depth = len(found[1])
            path = {d: t for d, t in path.items() if d < depth} | {depth: found[2].strip()}
        elif line is not None:
            lines.append(line)


def greedy(parts: list[str], most: int, glue: str) -> Iterator[str]:
    """Neighbouring parts joined while their tokens stay within most; a longer part stays whole."""
    held, size = [], 0
    for part in parts:
        n = tokens_of(part)
        if held and size + n > most:
            yield glue.join(held)
            held, size = [], 0
        held.append(part)
        size += n
    if held:
        yield glue.join(held)


def packed(block: str) -> Iterator[str]:
    """A block over the limit: paragraphs up to the target, over-long paragraphs by sentences up to the limit."""
    waiting: list[str] = []
    for p in [q.strip() for q in re.split(r"\n\s*\n", block) if q.strip()]:
        if tokens_of(p) > C.MAX_TOKENS:
            yield from greedy(waiting, C.TARGET_TOKENS, "\n\n")
            waiting = []
            yield from greedy(re.split(r"(?<=[.!?])\s+", p), C.MAX_TOKENS, " ")
        else:
            waiting.append(p)
    yield from greedy(waiting, C.TARGET_TOKENS, "\n\n")


def chunks_of(body: str) -> list[tuple[str, str]]:
    """(heading path, text) of each chunk, with the last words of the one before in front."""
    raw: list[tuple[str, str]] = []
    run: list[str] = []
    where = ""

    def close() -> None:
        nonlocal run
        raw.extend((where, t) for t in greedy(run, C.TARGET_TOKENS, "\n\n"))
        run = []

    for path, block in blocks_of(body):
        if tokens_of(block) > C.MAX_TOKENS:
            close()
            raw += [(path, t) for t in packed(block)]
        else:
            if path != where:
                close()
            where = path
            run.append(block)
    close()
    keep, out = int(C.OVERLAP_TOKENS * C.WORDS_PER_TOKEN), []
    for path, text in raw:
        words = out[-1][1].split() if out else []
        out.append((path, f"{' '.join(words[-keep:])} ... {text}" if len(words) > keep else text))
    return out


def chunk_documents(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunk_id, heading_path, tokens, text. Null and blank texts have no chunks.

    Packing is a fold over a document's blocks with state, so it runs in Arrow batches, one document at a
    time, where the scan put it.
    """
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, f"c{i:04d}", p, tokens_of(t), t) for k, body in zip(b[key], b[text]) if body for i, (p, t) in enumerate(chunks_of(body))]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "chunk_id", "heading_path", "tokens", "text"])

    return documents.select(key, text).mapInPandas(run, f"`{key}` {kind}, chunk_id string, heading_path string, tokens int, text string")


def sentence_sizes(c: Column) -> Column:
    """Token estimates of a text's sentences, in order."""
    words = lambda s: F.size(F.filter(F.split(s, r"[ \t\r\n\f]+"), lambda x: x != ""))
    cut = F.split(F.regexp_replace(c, r"([.!?])[ \t\r\n\f]+", "$1\u0001"), "\u0001")
    return F.transform(F.filter(cut, lambda s: F.trim(s) != ""), lambda s: F.greatest(F.lit(1), F.floor(words(s) / C.WORDS_PER_TOKEN).cast("int")))


def greedy_pack(sizes: Column, most: int) -> Column:
    """Sizes of greedily filled packs, as a fold in generated code: an item that doesn't fit opens the next pack."""
    start = F.struct(F.array().cast("array<int>").alias("packs"), F.lit(0).alias("cur"))

    def add(acc, x):
        full = (acc["cur"] > 0) & (acc["cur"] + x > most)
        return F.struct(F.when(full, F.concat(acc["packs"], F.array(acc["cur"]))).otherwise(acc["packs"]).alias("packs"), F.when(full, x).otherwise(acc["cur"] + x).alias("cur"))

    return F.aggregate(sizes, start, add, lambda acc: F.when(acc["cur"] > 0, F.concat(acc["packs"], F.array(acc["cur"]))).otherwise(acc["packs"]))


def summary(description: Column, body: Column, most: int = 4) -> Column:
    """The description if it has 60 characters or more, else the first sentences of the first paragraph that is no short heading."""
    paragraphs = F.filter(F.transform(F.split(body, r"\n[ \t\r\n\f]*\n"), lambda p: F.regexp_replace(p, r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "")), lambda p: (p != "") & ~(p.startswith("#") & (F.length(p) < 80)))
    first = F.get(paragraphs, F.lit(0))
    sentences = F.split(F.regexp_replace(first, r"([.!?])[ \t\r\n\f]+([A-Z(])", "$1\u0001$2"), "\u0001")
    d = F.trim(F.coalesce(description, F.lit("")))
    return F.when(F.length(d) >= 60, d).otherwise(F.coalesce(F.array_join(F.slice(sentences, 1, most), " "), d))
