"""Problem 2: how often every distinct value or run of values occurs, in how many records, and which are too rare or too common.

Method: a suffix array with common-prefix intervals. Every position of a sequence opens a suffix. Suffixes are
range-sorted over the cluster twice: by record, where the common prefix of neighbours gives the duplicate
adjacencies within a record, and over all records, where neighbours that share their first n elements form
an interval. An interval's sum is the number of occurrences of that n-gram; less the duplicate adjacencies in
it, it is the number of records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import normal_term
from corpusmill.session import cut_lineage
from corpusmill.sources.tables import table

RARE_BELOW = 3
COMMON_SHARE = 0.1


def _prefixes(column: pa.ListArray, same: np.ndarray) -> np.ndarray:
    """Common prefix of each list with the one before; 0 for the first and where `same` (it and the one before may be compared) is false."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = column.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    lcp, live, at = np.zeros(len(lengths), np.int64), np.nonzero(same)[0], 0
    while len(live):
        live = live[np.minimum(lengths[live], lengths[live - 1]) > at]
        live = live[codes[start[live] + at] == codes[start[live - 1] + at]]
        at += 1
        lcp[live] = at
    return lcp


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Each batch with the last row of the one before in front, and whether it has one."""
    last = None
    for b in batches:
        if b.num_rows:
            yield (pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0] if last else b), bool(last)
            last = b.slice(b.num_rows - 1, 1)


def _equal(column: pa.Array) -> np.ndarray:
    """Whether each value equals the one before; false for the first."""
    codes = column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[False], codes[1:] == codes[:-1]])


def _adjacencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g, r, suffix, c and lcp, the prefix shared with the record's suffix before; -1 for a partition's first row, and its last row once more with -2."""
    last = None
    for b, more in _stacked(batches):
        lcp = _prefixes(b.column("suffix"), _equal(b.column("g")) & _equal(b.column("r")))
        if not more:
            lcp[0] = -1
        skip = int(more)
        yield pa.RecordBatch.from_arrays([*[b.column(x).slice(skip) for x in ("g", "r", "suffix", "c")], pa.array(lcp[skip:].astype(np.int32))], names=["g", "r", "suffix", "c", "lcp"])
        last = b.slice(b.num_rows - 1)
    if last is not None:
        yield pa.RecordBatch.from_arrays([*[last.column(x) for x in ("g", "r", "suffix", "c")], pa.array([-2], pa.int32())], names=["g", "r", "suffix", "c", "lcp"])


class _Intervals:
    """Sums of the intervals of one partition's sorted suffixes, level by level; those that touch its ends may go on in the next."""

    def __init__(self):
        self.open: dict[int, list] = {}  # n -> [group, ngram, occurrences, duplicates, touches the start]

    def rows(self, done: list) -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [[]] * 6
        kinds = [pa.string(), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)], names=["g", "ngram", "n", "occurrences", "dup", "edge"])

    def add(self, b: pa.RecordBatch, more: bool) -> pa.RecordBatch:
        lcp = _prefixes(b.column("suffix"), _equal(b.column("g")))
        skip = int(more)
        groups, suffixes = b.column("g").slice(skip), b.column("suffix").slice(skip)
        lengths = pc.list_value_length(suffixes).to_numpy(zero_copy_only=False)
        lcp, c, rest = lcp[skip:], b.column("c").to_numpy()[skip:], b.column("rest").to_numpy()[skip:]
        adj = b.column("adj").slice(skip)
        deep, times = adj.flatten(), pc.list_value_length(adj).to_numpy(zero_copy_only=False)
        row, depth, number = np.repeat(np.arange(len(c)), times), deep.field("lcp").to_numpy(zero_copy_only=False), deep.field("n").to_numpy(zero_copy_only=False)
        done = []
        for n in range(1, max(int(lengths.max()), max(self.open, default=0)) + 1):
            dup = rest + np.bincount(row[depth >= n], number[depth >= n], len(c)).astype(np.int64)
            starts = np.nonzero(lcp < n)[0]
            head = int(starts[0]) if len(starts) else len(c)
            if n in self.open and head:
                self.open[n][2] += int(c[:head].sum())
                self.open[n][3] += int(dup[:head].sum())
            if not len(starts):
                continue
            if n in self.open:
                g, ngram, occ, d, first = self.open.pop(n)
                done.append((g, ngram, n, occ, d, first))
            occ, dups = np.add.reduceat(c, starts), np.add.reduceat(dup, starts)
            long = np.nonzero(lengths[starts] >= n)[0]
            names, grams = groups.take(pa.array(starts[long])).to_pylist(), pc.list_slice(suffixes.take(pa.array(starts[long])), 0, n).to_pylist()
            for i, g, w in zip(long, names, grams):
                first = not more and starts[i] == 0
                if i == len(starts) - 1:
                    self.open[n] = [g, w, int(occ[i]), int(dups[i]), first]
                else:
                    done.append((g, w, n, int(occ[i]), int(dups[i]), first))
        return self.rows(done)

    def close(self) -> pa.RecordBatch:
        return self.rows([(g, w, n, occ, d, True) for n, (g, w, occ, d, _) in self.open.items()])


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _Intervals()
    for b, more in _stacked(batches):
        yield found.add(b, more)
    yield found.close()


def ngram_frequencies(sequences: DataFrame, group: str, record: str, elements: str, max_n: int | None = None) -> DataFrame:
    """Occurrences and records of every n-gram; of up to max_n elements if that is given.

    sequences: one row per sequence, with `group` (text; n-grams are counted apart in each), `record` (text, the thing
    whose number is counted; sequences without one count as occurrences only) and `elements` (array of text; null and empty arrays
    have no n-grams, null elements break sequences: no n-gram spans one). Other columns are ignored.

    Returns group, ngram (array), n, occurrences, records. No row for an empty table.

    Equal suffixes of a record are first counted together, map-side, and equal suffixes of all records before the
    second sort, so that a record or term that holds a large share of the rows shrinks to its distinct suffixes.
    Both sorts are by range, so a record or a first element of any size is spread over tasks; what crosses the
    border of two tasks (one suffix, one interval per length) is put together afterwards. Suffixes of whole
    sequences are written out, so without max_n a sequence of m elements costs m squared.
    """
    runs = sequences.select(F.col(group).cast("string").alias("g"), F.col(record).cast("string").alias("r"), F.posexplode(F.col(elements)).alias("pos", "e"), F.col(elements).alias("a"))
    tail = F.slice("a", F.col("pos") + 1, F.size("a") if max_n is None else F.lit(max_n))
    cut = F.array_position(F.transform(tail, lambda x: x.isNull()), True)
    suffixes = runs.where("e IS NOT NULL").select("g", "r", F.when(cut == 0, tail).otherwise(F.slice(tail, F.lit(1), (cut - 1).cast("int"))).alias("suffix"))
    counted = suffixes.groupBy("g", "r", "suffix").agg(F.count("*").alias("c"))
    partitions = max(1, int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = counted.repartitionByRange(partitions, "g", "r", "suffix").sortWithinPartitions("g", "r", "suffix")
    near = cut_lineage(sorted_.mapInArrow(_adjacencies, "g string, r string, suffix array<string>, c bigint, lcp int"))
    # two rows per task: its first suffix gets its prefix from the last one of the task before
    edge = near.where("lcp < 0")
    order = Window.orderBy("g", "r", "suffix", F.desc("lcp"))
    was = lambda c: F.lag(c).over(order)
    shared = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size("suffix"), F.size("before"))), lambda i: F.slice("suffix", F.lit(1), i) == F.slice("before", F.lit(1), i)))
    fixed = edge.withColumn("before", F.when((was("lcp") == -2) & was("g").eqNullSafe(F.col("g")) & was("r").eqNullSafe(F.col("r")), was("suffix"))).where("lcp = -1")
    fixed = fixed.select("g", "r", "suffix", "c", F.when(F.col("before").isNull(), 0).otherwise(shared).alias("lcp"))
    rows = near.where("lcp >= 0").unionByName(fixed)
    # occurrences without a record are no records: all of them count as duplicates
    alone = F.when(F.col("r").isNull(), F.col("c")).otherwise(F.col("c") - 1)
    by_prefix = rows.groupBy("g", "suffix", F.when(F.col("r").isNull(), 0).otherwise(F.col("lcp")).alias("lcp")).agg(F.sum("c").alias("c"), F.sum(alone).alias("rest"), F.count("*").alias("n"))
    whole = by_prefix.groupBy("g", "suffix").agg(F.sum("c").alias("c"), F.sum("rest").alias("rest"), F.collect_list(F.when(F.col("lcp") > 0, F.struct("lcp", "n"))).alias("adj"))
    schema = "g string, ngram array<string>, n int, occurrences bigint, dup bigint, edge boolean"
    found = cut_lineage(whole.repartitionByRange(partitions, "g", "suffix").sortWithinPartitions("g", "suffix").mapInArrow(_intervals, schema))
    border = found.where("edge").groupBy("g", "ngram", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("dup").alias("dup"))  # at most two intervals per length and task
    every = found.where("NOT edge").drop("edge").unionByName(border)
    return every.select(F.col("g").alias(group), "ngram", "n", "occurrences", (F.col("occurrences") - F.col("dup")).alias("records"))


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """One row per chunk row and kind, with its normalised terms; blank and null elements are null there."""
    terms = lambda c: F.transform(F.col(c), normal_term)
    kinds = F.array(F.struct(F.lit("tag").alias("kind"), terms("tags").alias("terms")), F.struct(F.lit("concept").alias("kind"), terms("concepts").alias("terms")))
    return chunks.select("file_id", F.explode(kinds).alias("k")).select("file_id", "k.kind", "k.terms")


def term_counts(chunks: DataFrame) -> DataFrame:
    """kind, term, n_rows (occurrences over all rows), n_files, mark (rare, common or null) of every term.

    A term is an array element without outer white space, in lower case. rare: fewer than RARE_BELOW files;
    common: more than COMMON_SHARE of all file_ids. Rows without file_id count as rows, but as no file.
    """
    files = chunks.where("file_id IS NOT NULL").select("file_id").distinct().agg(F.count("*").alias("n_all"))
    counts = ngram_frequencies(chunk_terms(chunks), "kind", "file_id", "terms", max_n=1)
    mark = F.when(F.col("records") < RARE_BELOW, "rare").when(F.col("records") > F.col("n_all") * F.lit(COMMON_SHARE), "common")
    return counts.crossJoin(F.broadcast(files)).select(  # files is one row
        "kind", F.element_at("ngram", 1).alias("term"), F.col("occurrences").alias("n_rows"), F.col("records").alias("n_files"), mark.alias("mark")
    )


def p2_found(spark, sf_dir):
    return term_counts(table(spark, sf_dir, "chunks")).where("mark IS NOT NULL").select("kind", "term", "mark")


def p2_terms(spark, sf_dir):
    return term_counts(table(spark, sf_dir, "chunks"))


def p2_runs(spark, sf_dir):
    """Runs of two or more adjacent tags or concepts of any length, with the rows and files that hold them."""
    counts = ngram_frequencies(chunk_terms(table(spark, sf_dir, "chunks")), "kind", "file_id", "terms")
    return counts.where("n > 1").select("kind", F.array_join("ngram", "|").alias("run"), "n", "occurrences", "records")


_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TERMS_SQL = f"""
e AS (SELECT 'tag' AS kind, file_id, unnest(tags) AS raw FROM chunks UNION ALL SELECT 'concept', file_id, unnest(concepts) FROM chunks),
t AS (SELECT kind, file_id, lower(regexp_replace(raw, '^{_WS}+|{_WS}+$', '', 'g')) AS term FROM e WHERE raw IS NOT NULL)
"""
_COUNTS = f"""WITH {TERMS_SQL},
n AS (SELECT count(DISTINCT file_id) AS n_all FROM chunks),
c AS (SELECT kind, term, count(*) AS n_rows, count(DISTINCT file_id) AS n_files FROM t WHERE term <> '' GROUP BY ALL),
m AS (SELECT kind, term, n_rows, n_files, CASE WHEN n_files < 3 THEN 'rare' WHEN n_files > n_all * 0.1 THEN 'common' END AS mark FROM c, n)
"""
QUERIES = {"p2_found": p2_found, "p2_terms": p2_terms, "p2_runs": p2_runs}
SQL = {
    "p2_found": _COUNTS + "SELECT kind, term, mark FROM m WHERE mark IS NOT NULL",
    "p2_terms": _COUNTS + "SELECT kind, term, n_rows, n_files, mark FROM m",
    "p2_runs": f"""WITH s AS (SELECT file_id, kind, list_transform(terms, lambda x: nullif(lower(regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), '')) AS a
      FROM (SELECT file_id, 'tag' AS kind, tags AS terms FROM chunks UNION ALL SELECT file_id, 'concept', concepts FROM chunks)),
    p AS (SELECT file_id, kind, a, unnest(range(1, len(a) + 1)) AS i FROM s),
    g AS (SELECT file_id, kind, a[i:i + n - 1] AS w, n FROM p, (SELECT unnest(range(2, (SELECT max(len(a)) FROM s) + 1)) AS n) v WHERE i + n - 1 <= len(a))
    SELECT kind, array_to_string(w, '|') AS run, n::INTEGER AS n, count(*) AS occurrences, count(DISTINCT file_id) AS records
    FROM g WHERE len(list_filter(w, lambda x: x IS NULL)) = 0 GROUP BY kind, w, n""",
}
