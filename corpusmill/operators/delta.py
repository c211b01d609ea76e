"""Current versions, deltas against earlier runs, and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What tells versions of a chunk apart besides their time and text.
DESCRIBED = ["heading_path", "title", "tokens", "tags", "concepts", "relpath", "category", "subcategory"]
KEYS = ["file_id", "chunk_id"]


def last_version(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the largest `order` (null is smallest). Aggregated map-side, so a key with many versions costs one row per task."""
    best = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(best.alias("_w")).select("_w.*")


def version(text: bool = True) -> list[Column]:
    """Columns _at, _form and, with text, _text: what orders the versions of a chunk. Equal times go to the larger digest."""
    own = [F.col("indexed_at").alias("_at"), F.xxhash64(*DESCRIBED).alias("_form")]
    return own + ([F.xxhash64("text").alias("_text")] if text else [])


def current_chunks(chunks: DataFrame, *columns: str | Column, text: bool = True) -> DataFrame:
    """file_id, chunk_id and the columns asked for, of the latest row of each chunk. One row per chunk; a null time is oldest.

    Columns are computed where rows are scanned and only their values are shuffled, so ask for what a plan needs
    of a text (a digest, a count) rather than for the text. Versions of equal time go to the larger digest of
    their attributes, then of their text; text=False leaves the text out of that, which is safe where no column
    depends on it, and then it isn't read.
    """
    order = version(text)
    asked = [F.col(c) if isinstance(c, str) else c for c in columns]
    rows = chunks.select(*KEYS, *order, F.struct(*asked).alias("_c") if asked else F.lit(None).cast("struct<x:int>").alias("_c"))
    names = ["_at", "_form"] + (["_text"] if text else [])
    best = rows.groupBy(*KEYS).agg(F.max_by("_c", F.struct(*names)).alias("_c"))
    return best.select(*KEYS, "_c.*") if asked else best.select(*KEYS)


def current_versions(chunks: DataFrame, *columns: Column) -> DataFrame:
    """file_id, chunk_id, _at, _form, _text, copies and the columns: which version of each chunk is current, and how many equal rows deliver it."""
    rows = chunks.select(*KEYS, *version(), F.struct(F.lit(1).alias("_one"), *columns).alias("_c")).repartition(*KEYS)  # both groupings below need no further shuffle
    each = rows.groupBy(*KEYS, "_at", "_form", "_text").agg(F.count("*").alias("copies"), F.first("_c").alias("_c"))
    best = each.groupBy(*KEYS).agg(F.max_by(F.struct("_at", "_form", "_text", "copies", "_c"), F.struct("_at", "_form", "_text")).alias("_w"))
    return best.select(*KEYS, "_w._at", "_w._form", "_w._text", "_w.copies", "_w._c.*").drop("_one")


def hash_delta(current: DataFrame, previous: DataFrame, key: str, digest: str) -> DataFrame:
    """state (reused, encoded, dropped) and n: current rows whose digest was there before, those to encode, and earlier digests no longer used.

    Rows of `current` with a null digest are to be encoded. Repeated digests count per current row and once among the dropped.
    """
    was = previous.select(F.col(digest).alias("d")).where("d IS NOT NULL").distinct()
    now = current.select(F.col(key).alias("k"), F.col(digest).alias("d"))
    state = now.join(was.withColumn("old", F.lit(True)), "d", "left").select(F.when(F.col("old"), "reused").otherwise("encoded").alias("state"))
    gone = was.join(now.select("d").where("d IS NOT NULL").distinct(), "d", "left_anti").select(F.lit("dropped").alias("state"))
    return state.unionByName(gone).groupBy("state").agg(F.count("*").alias("n"))


def reusable(current: DataFrame, previous: DataFrame, digest: str, row: str) -> DataFrame:
    """current with the smallest earlier row of the same digest, or null: rows to take over and rows to compute anew. Null digests match nothing."""
    was = previous.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(row).alias(row))
    return current.join(was, digest, "left").select(*current.columns, row)


def run_validity(matrix: DataFrame, ids: DataFrame, row: str, vector: str) -> DataFrame:
    """One row: n_ids, n_vectors, unmatched, lengths, state of an earlier run: valid, or what keeps it from being built upon."""
    keyed = matrix.where(F.col(row).isNotNull()).select(row, F.size(vector).alias("l"), F.col(vector).isNotNull().alias("is"))
    m = keyed.groupBy(row).agg(F.lit(1).alias("m"))
    i = ids.where(F.col(row).isNotNull()).select(row).distinct().withColumn("i", F.lit(1))
    sums = m.join(i, row, "full").agg(F.count("i").alias("n_ids"), F.count("m").alias("n_vectors"), F.count_if(F.col("i").isNull() | F.col("m").isNull()).alias("unmatched"))
    lengths = keyed.agg(F.count_distinct(F.when(F.col("is"), F.col("l"))).alias("lengths"))
    state = F.when(F.col("n_vectors") == 0, "no vectors").when(F.col("unmatched") > 0, "ids and vectors differ").when(F.col("lengths") > 1, "lengths differ").otherwise("valid")
    return sums.crossJoin(lengths).withColumn("state", state)  # two single rows


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a digest of all rows that doesn't depend on their order, and their number.

    Rows are hashed where they are and combined by sums of the hashes' halves, so nothing is collected; the
    digest is the sha256 of both sums and the count.
    """
    line = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)
    half = lambda i: F.sum(F.conv(F.substring(line, i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}")
    sums = rows.agg(half(1), half(13), F.count("*").alias("n"))
    return sums.select(F.sha2(F.concat_ws("|", F.coalesce("s1", F.lit(0)).cast("string"), F.coalesce("s13", F.lit(0)).cast("string"), F.col("n").cast("string")), 256).alias("digest"), "n")


def daily_upsert(log: DataFrame) -> DataFrame:
    """One entry per day and kind: the latest title and body, with the number of runs. Kinds are compared without case and outer blanks; null days and blank kinds have none."""
    kind = F.lower(F.trim("kind"))
    rows = log.where(F.col("entry_date").isNotNull() & (kind != "")).withColumn("kind", kind)
    order = F.struct("ingested_at", "log_id")
    return rows.groupBy("entry_date", "kind").agg(F.max_by(F.struct("title", "body"), order).alias("w"), F.count("*").alias("runs")).select(
        "entry_date", "kind", "w.title", "w.body", "runs", F.when(F.col("runs") > 1, F.concat(F.lit("Runs today: "), F.col("runs").cast("string"))).alias("note")
    )
