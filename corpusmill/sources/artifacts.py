"""Results kept between runs: frames written first, the note that completes a run last."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_NOTE = "run bigint, name string, n_rows bigint, attributes map<string,string>"


def write_artifact(spark: SparkSession, frames: dict[str, DataFrame], folder: str, attributes: dict[str, str] | None = None, run: int | None = None) -> int:
    """Write the frames as a run of their own under a shared folder; returns its number. Earlier runs stay.

    The note with the rows of each frame is committed after all frames, in one write, so a run that was broken off is never read.
    """
    run = time.time_ns() if run is None else run
    notes = []
    for name, df in frames.items():
        path = f"{folder}/runs/{run}/{name}"
        df.write.mode("overwrite").parquet(path)
        notes.append((run, name, spark.read.schema(df.schema).parquet(path).count(), attributes or {}))
    spark.createDataFrame(notes, _NOTE).coalesce(1).write.mode("append").parquet(f"{folder}/notes")
    return run


def read_artifact(spark: SparkSession, folder: str, attributes: dict[str, str] | None = None) -> dict[str, DataFrame] | None:
    """The frames of the last complete run, or None where there is none, its attributes differ from those asked for, or a frame has lost rows."""
    try:
        notes = spark.read.schema(_NOTE).parquet(f"{folder}/notes")
    except AnalysisException:
        return None
    last = notes.selectExpr("max(run) AS run").first().run
    rows = notes.where(f"run = {last}").collect() if last is not None else []  # one per frame
    if not rows or any(dict(r.attributes) | (attributes or {}) != dict(r.attributes) for r in rows):
        return None
    try:
        frames = {r.name: spark.read.parquet(f"{folder}/runs/{last}/{r.name}") for r in rows}
    except AnalysisException:
        return None
    return frames if all(frames[r.name].count() == r.n_rows for r in rows) else None


def write_lines(rows: DataFrame, path: str, *order: str) -> None:
    """JSON lines in the order of the columns, nulls written out: judgements and reports."""
    rows.orderBy(*order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def shrunk(new: DataFrame, old: DataFrame | None, least: float = 0.5) -> bool:
    """Whether a regenerated table has fewer rows than a share of the earlier one: the guard to ask before it takes its place."""
    return old is not None and new.count() < least * old.count()
