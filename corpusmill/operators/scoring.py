"""BM25 on the executors in arrays: tokens of whole batches, hits of a row as bytes, and the best rows per set of terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusmill import config as C
from corpusmill.functions.stem import stem_en

#: Rows of a task's first tile, whose scores give the first bounds, and of the others.
FIRST_TILE, TILE = 8192, 65_536
SLACK = 1e-8  # scores are compared to 9 decimals

_KIND = np.zeros(256, np.uint8)  # 1: goes on with a token, 2: begins one
_KIND[[*b"0123456789_-"]] = 1
_KIND[[*range(65, 91), *range(97, 123)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes one after another, and where each row begins."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    return (np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)), off - off[0]


def tokens(column) -> tuple[pa.Array, np.ndarray]:
    """What raw_tokens finds in each row, one after another, and the row of each. All bytes of a batch at once: a run of letters, digits, _ and - holds one token, from its first letter on."""
    data, off = _bytes(column)
    kind = _KIND[data]
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = kind > 0
    cut = np.zeros(len(data) + 1, bool)  # a row begins here
    cut[off] = True
    begin = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
    letters = np.append(np.flatnonzero(kind == 2), len(data))
    first = letters[np.searchsorted(letters[:-1], begin)]
    good = end - first >= 2
    first, end = first[good], end[good]
    step = np.zeros(len(data) + 1, np.int8)
    step[first] += 1
    step[end] -= 1
    text = _LOWER[data[np.cumsum(step[:-1], dtype=np.int8) > 0]]
    starts = np.concatenate([[0], np.cumsum(end - first)]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(text))])
    return found, np.searchsorted(off, first, side="right") - 1


class Terms:
    """Places of tokens in a list of terms, by a lexicon's rules; -1 for those that aren't in it."""

    def __init__(self, terms: pa.Array, phrases: list[list[str]], stemmed: bool):
        self.stemmed, self.known = stemmed, {}
        self.terms = terms.cast(pa.large_binary())
        self.place = {t: i for i, t in enumerate(self.terms.to_pylist())} if stemmed or phrases else {}
        runs = sorted({tuple(p) for p in phrases if len(p) > 1}, key=lambda p: (-len(p), p))
        words = sorted({w for p in runs for w in p})
        at = {w: i for i, w in enumerate(words)}
        self.words = pa.array([w.encode() for w in words], pa.large_binary())
        self.runs: dict[int, list] = {}
        for p in runs:
            ids = [at[w] for w in p]
            self.runs.setdefault(ids[0] * len(words) + ids[1], []).append((ids, self._of("_".join(p).encode())))
        self.pairs = np.array(sorted(self.runs), np.int64)

    def _of(self, token: bytes) -> int:
        return self.place.get(stem_en(token.decode()).encode() if self.stemmed else token, -1)

    def of(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The row of each token and its place."""
        found, row = tokens(column)
        if self.stemmed:
            coded = found.dictionary_encode()
            own = coded.dictionary.to_pylist()
            for t in own:
                if t not in self.known:
                    self.known[t] = self._of(t)
            ids = np.array([self.known[t] for t in own], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if own else np.zeros(0, np.int64)
        else:
            ids = pc.index_in(found, value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self.pairs) and len(row) > 1:
            word = pc.index_in(found, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            pair = np.where((word[:-1] >= 0) & (word[1:] >= 0) & (row[:-1] == row[1:]), word[:-1] * len(self.words) + word[1:], -1)
            stay, free = np.ones(len(row), bool), 0
            for i in np.flatnonzero(np.isin(pair, self.pairs)).tolist():
                if i < free:
                    continue
                for run, term in self.runs[int(pair[i])]:  # the longest first
                    if i + len(run) <= len(row) and row[i + len(run) - 1] == row[i] and word[i : i + len(run)].tolist() == run:
                        ids[i], stay[i + 1 : i + len(run)], free = term, False, i + len(run)
                        break
            row, ids = row[stay], ids[stay]
        return row, ids


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends * values.itemsize), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def hits_of(text, title, heading, terms: Terms) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """For each row its number of tokens, the places of its terms (those of titles and headings further on), and how often each occurs. Rows without tokens have none."""
    n, t = len(text), max(1, len(terms.terms))
    row, ids = terms.of(text)
    dl = np.bincount(row, minlength=n)
    keys = [row[ids >= 0] * (3 * t) + ids[ids >= 0]]
    for kind, column in ((1, title), (2, heading)):
        row, ids = terms.of(column)
        keys.append(np.unique((row * (3 * t) + kind * t + ids)[(ids >= 0) & (dl[row] > 0)]))
    key, tf = np.unique(np.concatenate(keys), return_counts=True)
    ends = np.searchsorted(key, np.arange(n + 1) * (3 * t)).astype(np.int64)
    code = (key % (3 * t)).astype(code_type(len(terms.terms)))
    return dl, _binary(code, ends), _binary(tf.astype(np.uint8 if tf.max(initial=0) < 256 else np.uint32), ends)


def code_type(terms: int):
    return np.uint16 if 3 * terms <= 1 << 16 else np.uint32


def read_hits(codes, tfs, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, code and tf of each hit."""
    data, off = _bytes(codes)
    code = np.frombuffer(data.tobytes(), code_type(terms)).astype(np.int64)
    each = np.diff(off) // code_type(terms)().itemsize
    row = np.repeat(np.arange(len(each)), each)
    counts, at = _bytes(tfs)
    width = np.where(each > 0, np.diff(at) // np.maximum(each, 1), 1)
    if (width == 1).all():
        return row, code, counts.astype(np.int64)
    parts = [np.frombuffer(counts[at[i] : at[i + 1]].tobytes(), np.uint8 if width[i] == 1 else np.uint32).astype(np.int64) for i in range(len(each))]
    return row, code, np.concatenate(parts)


@dataclass
class Weights:
    """What scores need besides the hits: the terms, their idf, the mean length, and the sets of terms (a term's places from starts[i] to starts[i + 1])."""

    terms: pa.Array
    idf: np.ndarray
    avgdl: float
    sids: np.ndarray
    starts: np.ndarray
    places: np.ndarray

    def parts(self, code: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        """What each hit adds to a score."""
        n = len(self.idf)
        kind, term = np.divmod(code, max(1, n))
        body = self.idf[term] * tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * dl / self.avgdl))
        return np.where(kind == 0, body, np.where(kind == 1, C.TITLE_BOOST, C.HEADING_BOOST))

    def of(self, i: int) -> np.ndarray:
        return self.places[self.starts[i] : self.starts[i + 1]]


class Tile:
    """Some rows' hits by term, with the largest part of each term."""

    def __init__(self, w: Weights, dl: np.ndarray, row: np.ndarray, code: np.ndarray, tf: np.ndarray):
        self.n = len(dl)
        key = (code % max(1, len(w.idf))) * self.n + row
        by = np.argsort(key, kind="stable")
        key, part = key[by], w.parts(code, tf, dl[row])[by]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        self.part = np.add.reduceat(part, new) if len(new) else part
        term, self.row = np.divmod(key[new], max(1, self.n))
        self.starts = np.searchsorted(term, np.arange(len(w.idf) + 1))
        self.most = np.zeros(len(w.idf))
        there = np.flatnonzero(np.diff(self.starts))
        if len(there):
            self.most[there] = np.maximum.reduceat(self.part, self.starts[there])
        self.whole: dict[int, np.ndarray] = {}
        self.sum = np.zeros(self.n)

    def column(self, t: int) -> np.ndarray:
        """The parts of a term for all rows of the tile."""
        if t not in self.whole:
            if len(self.whole) >= 128:
                self.whole.clear()
            self.whole[t] = x = np.zeros(self.n)
            x[self.row[self.starts[t] : self.starts[t + 1]]] = self.part[self.starts[t] : self.starts[t + 1]]
        return self.whole[t]

    def above(self, terms: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows, in order, and scores, of all that may score more than the bound.

        Terms that together can't reach the bound (MaxScore) don't bring in rows: they are only added to those that other terms bring in.
        """
        most = self.most[terms]
        terms = terms[by := np.argsort(-most, kind="stable")][: int((most > 0).sum())]
        most = most[by][: len(terms)]
        rest = np.append(np.cumsum(most[::-1])[::-1], 0.0)  # what the terms from here on can add
        leading = int((rest[:-1] >= bound - SLACK).sum())
        if not leading:
            return np.zeros(0, np.int64), np.zeros(0)
        lists = [slice(self.starts[t], self.starts[t + 1]) for t in terms[:leading]]
        if leading == 1:
            rows, score = self.row[lists[0]], self.part[lists[0]].copy()
        else:
            for x in lists:
                self.sum[self.row[x]] += self.part[x]
            many = sum(x.stop - x.start for x in lists) > self.n // 8
            rows = np.flatnonzero(self.sum) if many else np.unique(np.concatenate([self.row[x] for x in lists]))
            score = self.sum[rows]
            self.sum[rows] = 0.0
        for t, more in zip(terms[leading:], rest[leading:]):
            stay = score + more >= bound - SLACK
            if not stay.all():
                rows, score = rows[stay], score[stay]
            if not len(rows):
                break
            score = score + self.column(int(t))[rows]
        return rows, score


def best(rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, best first; equal to 9 decimals, the earlier row first. rows ascend."""
    r = np.round(score, 9)
    if len(r) > k:
        least = np.partition(r, len(r) - k)[len(r) - k]
        over, same = np.flatnonzero(r > least), np.flatnonzero(r == least)
        at = np.sort(np.concatenate([over, same[: k - len(over)]]))
    else:
        at = np.arange(len(r))
    return at[np.argsort(-r[at], kind="stable")]


class Ranking:
    """The k best rows of each set of terms among all rows of a task, which come sorted by their keys."""

    def __init__(self, w: Weights, k: int, explain: bool):
        self.w, self.k, self.explain = w, k, explain
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.bound = np.full(len(w.sids), 0.0)
        self.n, self.keys, self.said = 0, [], {}

    def add(self, keys: pa.Table, dl: np.ndarray, row: np.ndarray, code: np.ndarray, tf: np.ndarray) -> None:
        tile = Tile(self.w, dl, row, code, tf)
        for i in range(len(self.w.sids)):
            rows, score = tile.above(self.w.of(i), self.bound[i])
            stay = np.round(score, 9) > self.bound[i] if i in self.held and len(self.held[i][0]) == self.k else score > 0
            rows, score = rows[stay], score[stay]
            if not len(rows):
                continue
            rows = rows + self.n
            if i in self.held:
                at, was = self.held[i]
                by = np.argsort(at)  # rows ascend again
                rows, score = np.concatenate([at[by], rows]), np.concatenate([was[by], score])
            top = best(rows, score, self.k)
            self.held[i] = rows[top], score[top]
            if len(top) == self.k:
                self.bound[i] = np.round(score[top[-1]], 9)
        if self.explain:
            inside = np.unique(np.concatenate([np.zeros(0, np.int64), *[r[r >= self.n] for r, _ in self.held.values()]])) - self.n
            lo = np.searchsorted(row, inside)
            hi = np.searchsorted(row, inside, side="right")
            self.said |= {self.n + int(i): (code[a:b], tf[a:b], dl[i]) for i, a, b in zip(inside, lo, hi)}
        self.keys.append(keys)
        self.n += len(dl)

    def result(self) -> pa.Table | None:
        if not self.held:
            return None
        sets = sorted(self.held)
        rows = np.concatenate([self.held[i][0] for i in sets])
        found = pa.concat_tables(self.keys).take(pa.array(rows))
        each = [len(self.held[i][0]) for i in sets]
        out = {"sid": pa.array(np.repeat(self.w.sids[sets], each))} | {c: found.column(c) for c in found.column_names}
        out["score"] = pa.array(np.concatenate([self.held[i][1] for i in sets]))
        if self.explain:
            names, said = self.w.terms.to_pylist(), []
            for i in sets:
                asked = set(self.w.of(i).tolist())
                for r in self.held[i][0].tolist():
                    code, tf, dl = self.said[r]
                    part = self.w.parts(code, tf, dl)
                    said.append(sorted((names[c], p) for c, p in zip(code.tolist(), part.tolist()) if c in asked and p > 0))
            out["said"] = pa.array([[{"term": a, "v": b} for a, b in x] for x in said], pa.list_(pa.struct([("term", pa.string()), ("v", pa.float64())])))
        return pa.table(out)


def ranked(batches, w: Weights, k: int, explain: bool, keys: list[str]):
    """mapInArrow over keys, dl, codes, tfs: sid, keys, score (and said) of the best rows."""
    ranking, waiting, have = Ranking(w, k, explain), [], 0

    def flush():
        t = pa.Table.from_batches(waiting)
        ranking.add(t.select(keys), t.column("dl").to_numpy(), *read_hits(t.column("codes"), t.column("tfs"), len(w.idf)))
        waiting.clear()

    for b in batches:
        lo = 0
        while lo < b.num_rows:
            part = b.slice(lo, (FIRST_TILE if not ranking.n else TILE) - have)
            waiting.append(part)
            lo, have = lo + part.num_rows, have + part.num_rows
            if have >= (FIRST_TILE if not ranking.n else TILE):
                flush()
                have = 0
    if waiting:
        flush()
    if (t := ranking.result()) is not None:
        yield from t.combine_chunks().to_batches(max_chunksize=65_536)


def paired(batches, w: Weights):
    """mapInArrow over sid, dl, codes, tfs and further columns: those, and the score of each row for its set."""
    at = {s: i for i, s in enumerate(w.sids.tolist())}
    for b in batches:
        if not b.num_rows:
            continue
        row, code, tf = read_hits(b.column("codes"), b.column("tfs"), len(w.idf))
        part = w.parts(code, tf, b.column("dl").to_numpy()[row])
        own = np.array([at[s] for s in b.column("sid").to_pylist()])
        n = max(1, len(w.idf))
        asked = np.unique(np.repeat(np.arange(len(w.sids)), np.diff(w.starts)) * n + w.places)
        score = np.bincount(row, np.where(np.isin(own[row] * n + code % n, asked), part, 0.0), minlength=b.num_rows).astype(np.float64)  # of no hits, whole numbers
        rest = [c for c in b.schema.names if c not in ("sid", "dl", "codes", "tfs")]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(score)], names=[*rest, "score"])
