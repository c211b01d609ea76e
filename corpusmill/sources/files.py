"""Reading and writing trees of files, line formats and manifests."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.functions.urls import indexable
from corpusmill.operators.skew import small_side

CHUNK_SCHEMA = "file_id string, chunk_id string, relpath string, title string, category string, subcategory string, tags array<string>, concepts array<string>, heading_path string, tokens int, text string"
QREL_SCHEMA = "qid string, query string, relevant_file_ids array<string>, source string, split string, created string"
_PAIR = re.compile(r"^([A-Za-z_][\w-]*)[ \t]*:[ \t]*(.*)$")


def scan_tree(spark: SparkSession, root: str, pattern: str = "*.{md,pdf}") -> DataFrame:
    """relpath, type, modified, size, content of the indexable files under root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), "^file:/*", "/")
    rows = files.withColumn("relpath", F.substring_index(rel, base, -1))
    return rows.where(indexable(F.col("relpath"))).select(
        "relpath", F.lower(F.element_at(F.split("relpath", r"\."), -1)).alias("type"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content"
    )


def read_chunks(spark: SparkSession, path: str, every: bool = False) -> DataFrame:
    """JSON lines of chunks: malformed lines are dropped, excluded paths left out unless every is set."""
    rows = spark.read.schema(CHUNK_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return rows if every else rows.where(indexable(F.col("relpath")))


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV with header, quotes doubled and line breaks inside cells."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def qrel_violations(lines: DataFrame) -> DataFrame:
    """line, problem of each line of a judgement file that is no valid record; blank lines are skipped. lines: line, value."""
    r = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", QREL_SCHEMA))
    missing = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit("")) == ""
    problem = (
        F.when(F.col("r").isNull() | (missing("qid") & missing("query")), "not a record").when(missing("qid"), "no qid").when(missing("query"), "no query")
        .when(F.coalesce(F.size("r.relevant_file_ids"), F.lit(0)) < 1, "no relevant files").when(~F.coalesce(F.col("r.source"), F.lit("")).isin("saved_query", "synthetic"), "unknown source")
        .when(~F.coalesce(F.col("r.split"), F.lit("")).isin("dev", "holdout"), "unknown split")
    )
    repeated = r.where("r.qid <> ''").groupBy("r.qid").agg(F.count("*").alias("n"), F.min("line").alias("first")).where("n > 1")
    twice = r.join(repeated, F.col("r.qid") == F.col("qid")).where("line > first").select("line", F.lit("qid occurs twice").alias("problem"))
    return r.select("line", problem.alias("problem")).where("problem IS NOT NULL").unionByName(twice)


def front_matter(text: str | None) -> tuple[dict[str, str], str]:
    """Fields of the block between --- lines at the top, lists as values joined by |, and the body after it."""
    m = re.match(r"\A﻿?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", text or "", re.S)
    if not m:
        return {}, text or ""
    fields: dict[str, str] = {}
    last = None
    for line in m.group(1).splitlines():
        item = re.match(r"^\s*-\s+(.*)$", line)
        if item and last:
            fields[last] = "|".join(x for x in (fields[last], item.group(1).strip().strip("\"'")) if x)
        elif pair := _PAIR.match(line):
            last, value = pair.group(1), pair.group(2).strip()
            if value.startswith("[") and value.endswith("]"):
                value = "|".join(x.strip().strip("\"'") for x in value[1:-1].split(",") if x.strip())
            fields[last] = value.strip("\"'")
    return fields, text[m.end() :]


def parse_markdown(files: DataFrame) -> DataFrame:
    """relpath, fields (map), body of Markdown contents; bytes that are no UTF-8 are replaced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = [front_matter(bytes(c).decode("utf-8", "replace") if c is not None else None) for c in b["content"]]
            yield pd.DataFrame({"relpath": b["relpath"], "fields": [p[0] for p in parsed], "body": [p[1] for p in parsed]})

    return files.select("relpath", "content").mapInPandas(run, "relpath string, fields map<string,string>, body string")


def extract_pages(files: DataFrame, extractor: Callable[[bytes], list[str]]) -> DataFrame:
    """relpath, n_pages, body, error of binary documents through a pluggable extractor of page texts; a failing file gives an error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["relpath"], b["content"]):
                try:
                    pages = extractor(bytes(content))
                    rows.append((path, len(pages), "\n\n".join(f"## Page {i}\n\n{p}" for i, p in enumerate(pages, 1)), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, 0, "", str(e)))
            yield pd.DataFrame(rows, columns=["relpath", "n_pages", "body", "error"])

    return files.select("relpath", "content").mapInPandas(run, "relpath string, n_pages int, body string, error string")


def cached_extract(files: DataFrame, extractor: Callable[[bytes], list[str]], previous: DataFrame | None = None) -> DataFrame:
    """relpath, sha1, n_pages, body, error: extracts of an earlier run are taken over where the content is the same.

    previous: sha1, n_pages, body, error. Only contents it lacks are extracted, equal ones once; errors are tried
    again. A null content has a null digest and no extract.
    """
    named = files.withColumn("sha1", F.sha1("content"))
    keys = named.select("relpath", "sha1")
    known = None if previous is None else previous.where("sha1 IS NOT NULL AND error IS NULL").dropDuplicates(["sha1"]).select("sha1", "n_pages", "body", "error")
    missing = keys.where("sha1 IS NOT NULL").groupBy("sha1").agg(F.min("relpath").alias("relpath"))
    if known is not None:
        missing = missing.join(known.select("sha1"), "sha1", "left_anti")
    first = small_side(missing)
    made = extract_pages(named.join(first.select("relpath"), "relpath", "left_semi"), extractor).join(first, "relpath").select("sha1", "n_pages", "body", "error")
    return keys.join(made if known is None else made.unionByName(known), "sha1", "left").select("relpath", "sha1", "n_pages", "body", "error")


def manifest_cell(c: str, kind: str, delimiter: str = "|") -> Column:
    """A manifest cell: lists joined, control characters and line breaks as blanks, null as empty."""
    text = F.array_join(c, delimiter) if kind.startswith("array") else F.col(c).cast("string")
    return F.coalesce(F.regexp_replace(text, r"[\x00-\x1F\x7F]+", " "), F.lit("")).alias(c)


def write_manifest(files: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV of the columns with all cells quoted."""
    kinds = dict(files.dtypes)
    files.select(*[manifest_cell(c, kinds[c]) for c in columns]).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
