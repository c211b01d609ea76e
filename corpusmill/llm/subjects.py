"""Problem 10: the subjects of each document.

Method: documents are embedded by term weighting and a truncated singular value decomposition; their
sentences, folded into the same space, go to the nearest of the subjects' seed centroids, which are refined
iteratively. A document has a subject if at least SHARE of its sentences are about it. A term's weight is
its inverse document frequency over the whole corpus times how unevenly the labelled documents that hold it
are spread over the subjects, so that turns of phrase found under every subject weigh next to nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.tables import table

RANK = 64
CENTROIDS = 12
ROUNDS = 12
SAMPLE_DOCUMENTS = 8_000
SHARE = 0.2
NONE = "none"
LEAST_COSINE = 0.15
LEAST_NORM = 0.25
MAJORITY = 0.5
PRIOR = 4.0
BLOCK = 100_000
CHARACTERS = 2_000_000
_FRONT = "\\A\\x{FEFF}?\\s*---[ \\t]*\\r?\\n(?s:.*?)\\n---[ \\t]*(?:\\r?\\n|\\z)"
_HEADING = "(?m)^[ \\t]*#{1,6}[ \\t].*$"
_ENDS = "[.!?。！？][\"'”’»)*_]*[\\s\\p{Z}]+|\\n\\s*\\n|\\n[ \\t]*(?:[-*+•]|\\d+[.)])[ \\t]"
_END = "\x01"


@dataclass
class Sentences:
    """The sentences of a batch of texts: hashes of their words one after the other, words per sentence, sentences per text."""

    words: np.ndarray
    sizes: np.ndarray
    per_text: np.ndarray

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of words and of pairs of words, and for each its sentence, in the order of sentences."""
        return _features(self.words, self.sizes)


def _features(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.repeat(np.arange(len(sizes)), sizes)
    inner = at[1:] == at[:-1] if len(at) else np.zeros(0, bool)
    with np.errstate(over="ignore"):
        pairs = (words[:-1] * np.int64(-7046029254386353131) + words[1:])[inner] if len(at) else words
    every, place = np.concatenate([words, pairs]), np.concatenate([at, at[:-1][inner] if len(at) else at])
    by = np.argsort(place, kind="stable")
    return every[by], place[by]


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


class WordHashes(dict):
    """64-bit hashes of the words met so far."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = _hash(word)
        return h


def _tokens(texts: pa.Array) -> pa.ListArray:
    """Words in lower case, with _END where a sentence ends; front matter and headings don't count."""
    t = pc.utf8_normalize(pc.fill_null(texts, ""), "NFD")
    t = pc.replace_substring_regex(t, _FRONT, "", max_replacements=1)
    t = pc.replace_substring(pc.replace_substring_regex(t, _HEADING, "\n\n"), "\r\n", "\n")
    t = pc.replace_substring_regex(pc.utf8_lower(t), _ENDS, f" {_END} ")
    t = pc.replace_substring_regex(pc.replace_substring(pc.replace_substring(t, "'", ""), "’", ""), f"[^\\p{{L}}\\p{{M}}{_END}]+", " ")
    return pc.split_pattern(t, " ")


def sentences(texts: pa.Array, known: WordHashes) -> Sentences:
    """Sentences of three words or more; null and blank texts have none."""
    lists = _tokens(texts)
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.array([known[w] for w in names], np.int64)
    kind = np.array([0 if w == "" else 2 if w == _END else 1 for w in names], np.int8)
    codes = coded.indices.to_numpy()
    text = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    kinds = kind[codes] if len(codes) else np.zeros(0, np.int8)
    number = np.cumsum(kinds == 2) + text  # differs between any two sentences
    is_word = kinds == 1
    words, text, number = hashes[codes[is_word]] if len(codes) else np.zeros(0, np.int64), text[is_word], number[is_word]
    new = np.concatenate([[True], number[1:] != number[:-1]]) if len(number) else np.zeros(0, bool)
    first = np.nonzero(new)[0]
    sizes = np.diff(np.concatenate([first, [len(words)]])) if len(first) else np.zeros(0, np.int64)
    long = sizes > 2
    return Sentences(words[np.repeat(long, sizes)], sizes[long], np.bincount(text[first][long], minlength=len(lists)) if len(first) else np.zeros(len(lists), np.int64))


def _slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of at most 1,024 texts and, but for a single longer text, CHARACTERS characters, each with its place."""
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False))
    lo, done = 0, 0
    while lo < len(column):
        hi = max(lo + 1, min(lo + 1024, int(np.searchsorted(sizes, done + CHARACTERS, "right"))))
        yield lo, column.slice(lo, hi - lo)
        lo, done = hi, int(sizes[hi - 1])


class Vocabulary:
    """Row numbers of known hashes: a table by their low bits, and the few that collide there in sorted order."""

    def __init__(self, hashes: np.ndarray):
        self.size = len(hashes)
        self.mask = np.int64((1 << max(4, (16 * len(hashes)).bit_length())) - 1)
        slot = hashes & self.mask
        _, first = np.unique(slot, return_index=True)
        self.row, self.key = np.full(int(self.mask) + 1, -1, np.int32), np.zeros(int(self.mask) + 1, np.int64)
        self.row[slot[first]], self.key[slot[first]] = first, hashes[first]
        late = np.setdiff1d(np.arange(len(hashes)), first)
        by = np.argsort(hashes[late])
        self.late_key, self.late_row = hashes[late][by], late[by]

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for those not known."""
        slot = hashes & self.mask
        row = self.row[slot]
        other = np.nonzero((row >= 0) & (self.key[slot] != hashes))[0]
        if len(other):
            row[other] = -1
            if len(self.late_key):
                at = np.minimum(np.searchsorted(self.late_key, hashes[other]), len(self.late_key) - 1)
                hit = self.late_key[at] == hashes[other]
                row[other[hit]] = self.late_row[at[hit]]
        return row


def document_frequencies(documents: DataFrame, vocabulary: Vocabulary, text: str = "text") -> tuple[np.ndarray, int]:
    """By row of the vocabulary in how many of all documents it occurs, and the number of texts. Each task sends one sum per row of the vocabulary."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = shared.value, WordHashes()
        df, n = np.zeros(v.size, np.int64), 0
        for b in batches:
            n += b.num_rows - b.column(0).null_count
            for _, part in _slices(b.column(0)):
                s = sentences(part, known)
                features, place = s.features()
                row = v.rows(features)
                doc = np.repeat(np.arange(len(part)), s.per_text)[place] if len(place) else place
                df += np.bincount(np.unique(doc[row >= 0] * v.size + row[row >= 0]) % max(1, v.size), minlength=v.size)
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at]).astype(np.int32)), pa.array(np.concatenate([[n], df[at]]))], names=["row", "df"])

    counts = documents.select(text).mapInArrow(run, "row int, df bigint").groupBy("row").agg(F.sum("df").alias("df")).toArrow()
    row, n = counts.column("row").to_numpy(), counts.column("df").to_numpy()
    df = np.zeros(vocabulary.size, np.int64)
    df[row[row >= 0]] = n[row >= 0]
    return df, int(n[row < 0].sum())


@dataclass
class SubjectModel:
    vocabulary: Vocabulary
    terms: np.ndarray  # by row of the vocabulary: right singular vectors times the row's weight
    centroids: np.ndarray
    owner: np.ndarray  # subject number of each centroid; len(subjects) is none
    subjects: list[str]
    floor: float  # sentences with a shorter vector are about no subject

    def classify(self, s: Sentences) -> np.ndarray:
        """Subject number of each sentence; len(subjects) for none."""
        features, place = s.features()
        x, norm = _embed(self.vocabulary.rows(features), place, len(s.sizes), self.terms)
        like = x @ self.centroids.T
        best = like.argmax(1) if len(like) else np.zeros(0, np.int64)
        return np.where((like[np.arange(len(like)), best] < LEAST_COSINE) | (norm < self.floor), len(self.subjects), self.owner[best])


def _embed(row, place, n, terms):
    """Unit vectors and lengths of n sentences, given the vocabulary's row (or -1) and the sentence of each feature, in the order of sentences."""
    out = np.zeros((n, terms.shape[1]), np.float32)
    sizes = np.bincount(place[row >= 0], minlength=n)
    row, starts = row[row >= 0], np.concatenate([[0], np.cumsum(sizes)])
    for lo in range(0, n, 4096):  # the first feature of every sentence at once, then the second, ...
        by = np.argsort(-sizes[lo : lo + 4096], kind="stable") + lo
        total = np.zeros((len(by), terms.shape[1]), np.float32)
        for i in range(int(sizes[by[0]])):
            live = int(np.searchsorted(-sizes[by], -i, "left"))
            total[:live] += terms[row[starts[by[:live]] + i]]
        out[by] = total
    norm = np.linalg.norm(out, axis=1)
    return out / np.maximum(norm, 1e-9)[:, None], norm


class _Sparse:
    """Rows of (column, weight) with products from both sides, a block of entries at a time."""

    def __init__(self, r, c, rows, weight):
        pairs, times = np.unique(r * len(weight) + c, return_counts=True)
        r, c = pairs // len(weight), pairs % len(weight)
        w = weight[c] * (1 + np.log(times))
        norm = np.sqrt(np.bincount(r, w * w, rows))
        self.r, self.c, self.w = r, c, (w / np.maximum(norm[r], 1e-9)).astype(np.float32)
        self.shape = (rows, len(weight))
        by = np.argsort(self.c, kind="stable")
        self.by_column = (self.c[by], self.r[by], self.w[by])

    @staticmethod
    def _times(out_ix, in_ix, w, dense, n):
        out = np.zeros((n, dense.shape[1]), np.float32)
        for lo in range(0, len(w), BLOCK):
            o, i, x = out_ix[lo : lo + BLOCK], in_ix[lo : lo + BLOCK], w[lo : lo + BLOCK]
            first = np.concatenate([[0], np.nonzero(np.diff(o))[0] + 1])
            out[o[first]] += np.add.reduceat(dense[i] * x[:, None], first, axis=0)
        return out

    def right(self, dense):
        return self._times(self.r, self.c, self.w, dense, self.shape[0])

    def left(self, dense):
        c, r, w = self.by_column
        return self._times(c, r, w, dense, self.shape[1])


def truncated_svd(a: _Sparse, rank: int, passes: int = 2, seed: int = 5) -> np.ndarray:
    """Right singular vectors of the largest singular values, by subspace iteration; columns scaled to unit length."""
    q = np.random.default_rng(seed).standard_normal((a.shape[1], min(rank + 8, a.shape[1]))).astype(np.float32)
    for _ in range(passes):
        q, _ = np.linalg.qr(a.left(a.right(q)))
    b = a.right(q)
    _, _, vt = np.linalg.svd(b.T @ b)
    return (q @ vt.T)[:, :rank].astype(np.float32)


def _unevenness(document: np.ndarray, row: np.ndarray, size: int, labels: np.ndarray) -> np.ndarray:
    """By row of the vocabulary: how far the labels of documents with it are from evenly spread (relative entropy, at most 1), shrunk for rare features, squared. (document, row) are distinct."""
    k = labels.shape[1]
    counts = np.stack([np.bincount(row, labels[document, i], size) for i in range(k)], 1).astype(np.float32)
    base = labels.sum(0)
    even = counts * (base.sum() / k / np.maximum(base, 1.0))  # as if every label were as frequent as the others
    p = (even + PRIOR / k) / (even.sum(1, keepdims=True) + PRIOR)
    return np.square((p * np.log(p * k)).sum(1) / np.log(k)).astype(np.float32)


@dataclass
class Sample:
    """Labelled documents: labels, sentences per document, words per sentence, hashes of words."""

    labels: list[list[str]]
    per_text: np.ndarray
    sizes: np.ndarray
    words: np.ndarray

    def with_areas(self, areas: list[tuple[str, str]]) -> Sample:
        """The subjects' own descriptions as further documents of one sentence each."""
        about = sentences(pa.array([f"{s.replace('_', ' ')} {d}".replace(".", " ") for s, d in areas], pa.string()), WordHashes())
        names = [[s] for (s, _), n in zip(areas, about.per_text) for _ in range(n)]
        return Sample(self.labels + names, np.concatenate([self.per_text, np.ones(len(names), np.int64)]), np.concatenate([self.sizes, about.sizes]), np.concatenate([self.words, about.words]))


def fit(sample: Sample, areas: list[tuple[str, str]], frequencies) -> SubjectModel:
    """frequencies gives, for a vocabulary, the document frequencies of its rows and the number of documents.

    The vocabulary is what the sample's documents hold. Seeds are drawn among the sentences of each label, and centroids are then refined over all sentences,
    whatever their labels; a centroid belongs to the label that most of its sentences' documents have, or to
    none if no label has MAJORITY. So wrong labels are outvoted, and each language gets centroids of its own.
    """
    subjects = [s for s, _ in areas]
    numbers = {s: i for i, s in enumerate(subjects)} | {NONE: len(subjects)}
    sample = sample.with_areas(areas)
    features, place = _features(sample.words, sample.sizes)
    if not len(features):
        return SubjectModel(Vocabulary(np.zeros(0, np.int64)), np.zeros((1, 1), np.float32), np.zeros((1, 1), np.float32), np.array([len(subjects)]), subjects, 0.0)
    vocabulary, row = np.unique(features, return_inverse=True)
    document = np.repeat(np.arange(len(sample.labels)), sample.per_text)
    shares = np.zeros((len(sample.labels), len(subjects) + 1), np.float32)
    for j, labels in enumerate(sample.labels):
        known = [numbers[s] for s in labels if s in numbers]
        shares[j, known] = 1 / max(1, len(known))
    v = Vocabulary(vocabulary)
    df, n_documents = frequencies(v)
    held = np.unique(document[place] * v.size + row)
    weight = np.maximum(np.log((n_documents + 1) / (df + 1.0)), 0).astype(np.float32) * _unevenness(held // v.size, held % v.size, v.size, shares)
    terms = truncated_svd(_Sparse(document[place], row, len(sample.labels), weight), min(RANK, v.size)) * weight[:, None]
    x, norm = _embed(row, place, len(sample.sizes), terms)
    belongs = shares[document]
    floor = LEAST_NORM * float(np.median(norm[norm > 0])) if (norm > 0).any() else 0.0
    heavy = (norm >= floor) & (norm > 0)
    rng = np.random.default_rng(3)
    seeds = [_seeds(x[mine], CENTROIDS, rng) for i in range(len(subjects) + 1) if len(mine := np.nonzero(heavy & (belongs[:, i] == 1))[0])]
    if not seeds:
        return SubjectModel(v, terms, np.zeros((1, terms.shape[1]), np.float32), np.array([len(subjects)]), subjects, floor)
    x, belongs = x[heavy], belongs[heavy]
    c = np.vstack(seeds)
    for _ in range(ROUNDS):
        near = np.concatenate([(x[i : i + 20_000] @ c.T).argmax(1) for i in range(0, len(x), 20_000)])
        total = _sums(x, near, len(c))
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c).astype(np.float32)
    votes = _sums(belongs, near, len(c))
    owner = np.where(votes.max(1) >= MAJORITY * np.maximum(votes.sum(1), 1e-9), votes.argmax(1), len(subjects))
    return SubjectModel(v, terms, c, owner, subjects, floor)


def _sums(x: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sum of the rows of each group."""
    total = np.zeros((groups, x.shape[1]), np.float64)
    for lo in range(0, len(x), 10_000):
        g = group[lo : lo + 10_000]
        member = np.zeros((groups, len(g)), np.float32)
        member[g, np.arange(len(g))] = 1
        total += member @ x[lo : lo + 10_000]
    return total


def _seeds(x: np.ndarray, k: int, rng) -> np.ndarray:
    """k rows far from each other: each next one is drawn by its distance to those before."""
    picked = [int(rng.integers(len(x)))]
    far = np.maximum(1 - x @ x[picked[0]], 0)
    while len(picked) < min(k, len(x)) and far.sum() > 1e-6:
        j = int(rng.choice(len(x), p=far / far.sum()))
        picked.append(j)
        far = np.minimum(far, np.maximum(1 - x @ x[j], 0))
    return x[picked]


def fit_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> SubjectModel:
    """The model: document frequencies over all documents; vocabulary, singular vectors and centroids from at most sample_documents labelled documents, chosen by a hash of doc_id."""
    known = [(r.subject, r.description or "") for r in areas.where("subject IS NOT NULL").select("subject", "description").orderBy("subject").collect()]
    marked = labels.where("subject IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("labels"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_documents)
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for lo, part in _slices(b.column("text")):
                s = sentences(part, hashes)
                ends = np.concatenate([[0], np.cumsum(s.per_text)])
                lists = lambda values, cuts: pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))
                words = np.concatenate([[0], np.cumsum(s.sizes)])[ends]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, len(part)), b.column("labels").slice(lo, len(part)), lists(s.sizes.astype(np.int32), ends), lists(s.words, words)], names=["doc_id", "labels", "sizes", "words"])

    # at most sample_documents rows are broadcast
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "labels", "text").mapInArrow(run, f"doc_id {kind}, labels array<string>, sizes array<int>, words array<bigint>")
    got = sample.toArrow().sort_by("doc_id")  # so that the model doesn't depend on how the rows are spread
    flat = lambda c, d: got.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(d)
    per_text = pc.list_value_length(got.column("sizes")).to_numpy().astype(np.int64)
    return fit(Sample(got.column("labels").to_pylist(), per_text, flat("sizes", np.int64), flat("words", np.int64)), known, lambda v: document_frequencies(documents, v))


def document_subjects(documents: DataFrame, model: SubjectModel, share: float = SHARE) -> DataFrame:
    """doc_id, subject, share of sentences: one row per subject of at least `share` of the document's sentences.

    Null, empty and blank texts, and texts without sentences, have none. Documents are read where the scan
    put them; the model is broadcast, and its size is bounded by the sample it was fitted on.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashes = shared.value, WordHashes()
        n, names = len(m.subjects), pa.array(m.subjects, pa.string())
        for b in batches:
            for lo, part in _slices(b.column("text")):
                s = sentences(part, hashes)
                doc = np.repeat(np.arange(len(part)), s.per_text)
                counts = np.bincount(doc * (n + 1) + m.classify(s), minlength=len(part) * (n + 1)).reshape(-1, n + 1)
                total = np.maximum(counts.sum(1), 1)
                rows, cols = np.nonzero((counts[:, :n] >= share * total[:, None] - 1e-9) & (counts[:, :n] > 0))
                if len(rows):
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows + lo)), names.take(pa.array(cols)), pa.array(np.round(counts[rows, cols] / total[rows], 6))], names=["doc_id", "subject", "share"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, subject string, share double")


def p10_shares(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = fit_subjects(documents, table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"))
    return document_subjects(documents, model)


def p10_found(spark, sf_dir):
    return p10_shares(spark, sf_dir).select("doc_id", "subject")


def p10_composition(spark, sf_dir):
    """How many documents each subject has, and its share of the corpus."""
    found = p10_found(spark, sf_dir).groupBy("subject").agg(F.countDistinct("doc_id").alias("n_documents"))
    return found.withColumn("corpus_share", F.round(F.col("n_documents") / F.lit(max(1, table(spark, sf_dir, "documents").count())), 6))


QUERIES = {"p10_found": p10_found, "p10_composition": p10_composition}
SQL: dict[str, str] = {}
