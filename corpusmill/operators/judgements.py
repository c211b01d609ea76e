"""Search results kept as Markdown records, and relevance judgements mined from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.markdown import field_line, front_block, without_front

LONGEST_TEXT = 1200


def saved_query(hits: DataFrame, query: str, answer: str) -> DataFrame:
    """query, text: one Markdown record per query. hits: query, answer, rank, file_id, relpath, title, text of a bounded top-k list.

    The record has the question in its front block, the answer of the query's first hit, and the results in order, their texts cut.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = F.concat(
        F.lit("### "), F.col("rank").cast("string"), F.lit(". ["), F.regexp_replace(said("title"), r"[\[\]\r\n]+", " "), F.lit("]\n\nfile_id: `"), F.col("file_id"), F.lit("` path: `"), said("relpath"), F.lit("`\n\n"),
        F.regexp_replace(F.substring(said("text"), 1, LONGEST_TEXT), r"(?m)^#", " #"), F.lit("\n"),
    )
    rows = hits.groupBy(query).agg(F.min_by(answer, "rank").alias("_a"), F.sort_array(F.collect_list(F.struct("rank", one.alias("t")))).alias("_b"))  # at most k results a query
    text = F.concat(F.lit("---\nquestion: "), F.regexp_replace(F.col(query), r"[\r\n]+", " "), F.lit("\n---\n\n## Answer\n\n"), F.coalesce("_a", F.lit("")), F.lit("\n\n## Top results\n\n"), F.array_join(F.transform("_b", lambda x: x["t"]), "\n"))
    return rows.select(query, text.alias("text"))


def section(c: Column, heading: str) -> Column:
    """The text under a heading of level two up to the next one; blank if there is none."""
    return F.trim(F.regexp_replace(F.regexp_extract(c, rf"(?ms)^{heading}[ \t]*$(.*?)(?=^## |\z)", 1), r"^\s+|\s+$", ""))


def mined(c: Column) -> Column:
    """struct(question, cited) of a saved record: the results that its answer names by id, file name or title (in any case), once each in their order.

    What follows a line on paraphrases is no part of the answer. Null where the question, answer or results are missing or none is cited.
    """
    body = without_front(c)
    question = F.trim(field_line(front_block(c), "question"))
    answer = F.regexp_replace(section(body, "## Answer"), r"(?ms)^\*\*Paraphrases used:\*\*.*", "")
    blocks = F.split(section(body, "## Top results"), r"(?m)(?=^### \d+\.)")
    parts = F.transform(blocks, lambda b: F.struct(
        F.regexp_extract(b, r"file_id: `([^`]+)`", 1).alias("id"), F.element_at(F.split(F.regexp_extract(b, r"path: `([^`]+)`", 1), "/"), -1).alias("name"),
        F.lower(F.regexp_extract(b, r"(?m)^### \d+\. \[([^\]]*)\]", 1)).alias("title"),
    ))
    named = lambda p: F.contains(answer, p["id"]) | ((p["name"] != "") & F.contains(answer, p["name"])) | ((p["title"] != "") & F.contains(F.lower(answer), p["title"]))
    cited = F.array_distinct(F.transform(F.filter(parts, lambda p: (p["id"] != "") & named(p)), lambda p: p["id"]))
    return F.when((question != "") & (answer != "") & (F.size(cited) > 0), F.struct(question.alias("question"), cited.alias("cited")))


def judgements(records: DataFrame, key: str, text: str, prior: DataFrame | None = None) -> DataFrame:
    """qid, query, relevant_file_ids, source, split of every usable record. prior: qid, split, source of earlier judgements.

    A record known before keeps its split, others are dev; earlier synthetic judgements aren't touched here. Unusable records give no row.
    """
    rows = records.select(F.concat(F.lit("sq-"), F.col(key).cast("string")).alias("qid"), mined(F.col(text)).alias("m")).where("m IS NOT NULL")
    made = rows.select("qid", F.col("m.question").alias("query"), F.col("m.cited").alias("relevant_file_ids"), F.lit("saved_query").alias("source"))
    if prior is None:
        return made.withColumn("split", F.lit("dev"))
    known = prior.groupBy("qid").agg(F.min("split").alias("split"))
    return made.join(known, "qid", "left").withColumn("split", F.coalesce("split", F.lit("dev")))


def drift(relevant: DataFrame, known: DataFrame, qid: str = "qid", file: str = "file_id") -> DataFrame:
    """qid, n_relevant, n_known, state: excluded if none of the relevant files is known any more, else kept."""
    marked = relevant.select(qid, file).distinct().join(known.select(file).distinct().withColumn("_k", F.lit(1)), file, "left")
    g = marked.groupBy(qid).agg(F.count("*").alias("n_relevant"), F.count("_k").alias("n_known"))
    return g.withColumn("state", F.when(F.col("n_known") > 0, "kept").otherwise("excluded"))
