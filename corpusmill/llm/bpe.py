"""Problem 8: byte-level BPE ids of every text.

Method: two-tier lookup. Whole pre-tokens that are vocabulary entries are resolved by a minimal perfect
hash; the rest are merged by a heap over linked bytes. Only files of a public vocabulary are read; their
path is a parameter.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.tables import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 400_000
_M64 = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash of byte strings: hash, displace by bucket, compare with the entry in the slot.

    Buckets of one key store their slot itself, as -slot - 1, so building never searches for the last slots.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) < n:
            raise ValueError("keys repeat or their hashes collide")
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.shift = np.zeros(self.buckets, np.int64)
        taken, at = bytearray(n), [0] * n
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        free = None
        for b in order:
            own = members[b]
            if len(own) > 1:
                for d in range(1, 1 << 30):
                    slots = [self._slot(hashes[i], d) for i in own]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                self.shift[b] = d
            elif own:
                free = free or iter([s for s in range(n) if not taken[s]])
                slots = [next(free)]
                self.shift[b] = -slots[0] - 1
            else:
                break
            for i, s in zip(own, slots):
                taken[s], at[i] = 1, s
        self.shift = self.shift.tolist()
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        for i, s in enumerate(at):
            self.keys[s], self.values[s] = keys[i], values[i]

    def _slot(self, h: int, d: int) -> int:
        x = ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & _M64
        return (x >> 32) % self.n

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[s] if self.keys[s] == key else -1


class Encoder(dict):
    """Pre-token -> ids; a dict of what was looked up so far, filled by __missing__ and emptied at CACHE_ENTRIES."""

    def __init__(self, table: PerfectHash):
        super().__init__()
        self.table = table
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        whole = self.table.get(raw)
        ids = self[word] = [whole] if whole >= 0 else self.merge(raw)
        return ids

    def merge(self, raw: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals: a heap of joins over a linked list of pieces."""
        n, get = len(raw), self.table.get
        end = list(range(1, n + 1))  # piece i covers raw[i:end[i]]; 0: merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:  # a piece of this join has changed since
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(raw[i : end[stop]])) >= 0:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := get(raw[p:stop])) >= 0:
                heapq.heappush(heap, (r, p, stop))
        ids, i = [], 0
        while i < n:
            ids.append(get(raw[i : end[i]]))
            i = end[i]
        return ids

    def encode(self, text: str | None) -> list[int]:
        return [i for word in self.split(text) for i in self[word]] if text else []

    def count(self, text: str | None) -> int:
        return sum(len(self[word]) for word in self.split(text)) if text else 0


def load_vocabulary(path: str = VOCABULARY) -> PerfectHash:
    """The perfect hash of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return PerfectHash([base64.b64decode(a) for a, _ in pairs], [int(b) for _, b in pairs])


_WORKER: dict[int, Encoder] = {}


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, counts_only: bool = False) -> DataFrame:
    """key and ids (array<int>) of every row, without special tokens; or n_tokens, if counts_only.

    Null and empty texts give an empty list (0). Blank text is encoded as it stands, and text that looks
    like a special token is plain text. Rows are kept as they are: repeated keys give repeated rows. The
    vocabulary is broadcast: its size is that of the file, whatever the data. Texts are encoded where the
    scan put them, without a shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if counts_only:
                out = pa.array([encoder.count(t) for t in texts], pa.int32())
            else:
                lists = [np.array(encoder.encode(t), np.int32) for t in texts]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=[key, "n_tokens" if counts_only else "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, " + ("n_tokens int" if counts_only else "ids array<int>"))


def p8_ids(spark, sf_dir):
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
