"""Every problem's query on tables that are empty, and on tables with null rows, repeated rows and extra columns of clashing names."""

import pytest
from pyspark.sql import functions as F

from corpusmill.llm.queries import QUERIES
from tests.compare import rows

TABLES = "files chunks emb_matrix emb_ids notion_sources dedup_report vocab_terms documents subject_areas subject_labels".split()
#: Names that the operators use for columns of their own.
CLASHING = "n r h a b c g k j v id key first last copies size length shard container part cell block rep own term item kind field value entered name labels raw canon at big score rank w x y".split()
DELIVERED_TWICE = {"chunks", "emb_matrix", "emb_ids", "dedup_report", "subject_labels"}
NAMES = "p1_found p2_found p3_found p4_found p5_pieces p6_found p7_copies p8_ids p9_packed p10_found".split()


def _write(spark, source, target, change):
    for t in TABLES:
        change(t, spark.read.parquet(f"{source}/{t}.parquet")).coalesce(1).write.parquet(f"{target}/{t}.parquet")
    return str(target)


@pytest.fixture(scope="module")
def empty(spark, tiny, tmp_path_factory):
    return _write(spark, tiny, tmp_path_factory.mktemp("empty"), lambda t, df: df.where("false"))


@pytest.fixture(scope="module")
def untidy(spark, tiny, tmp_path_factory):
    def change(t, df):
        more = df.unionByName(df) if t in DELIVERED_TWICE else df
        more = more.unionByName(spark.createDataFrame([(None,) * len(df.columns)], df.schema)) if all(f.nullable for f in df.schema) else more
        return more.select("*", *[F.lit("extra").alias(c) for c in CLASHING if c not in {x.lower() for x in df.columns}])

    return _write(spark, tiny, tmp_path_factory.mktemp("untidy"), change)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_null_rows_repeated_rows_and_extra_columns_change_nothing(spark, tiny, untidy, name):
    want, got = QUERIES[name](spark, tiny).toPandas(), QUERIES[name](spark, untidy).toPandas()
    for key in {"doc_id", "row_id"} & set(got.columns):  # the null row itself is a row of its own where every row has one
        got = got[got[key].notna()].astype({key: "int64"})
    assert rows(got) == rows(want)
