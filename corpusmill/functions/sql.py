"""Functions for spark.sql: expressions stay in generated code, stems run in Arrow batches, the chunker is a table function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.markdown import FRONT
from corpusmill.functions.stem import stem_en
from corpusmill.functions.text import TOKEN, WORDS_PER_TOKEN

#: name: parameters, type and expression of what Spark itself can say. Patterns come from the column expressions.
EXPRESSIONS = {
    "tokenize": ("t STRING", "ARRAY<STRING>", f"transform(regexp_extract_all(t, r'{TOKEN}', 1), x -> lower(x))"),
    "count_tokens": ("t STRING", "INT", rf"greatest(1, cast(floor(regexp_count(t, r'(?U)\S+') / {WORDS_PER_TOKEN}D) AS INT))"),
    "front_block": ("t STRING", "STRING", f"regexp_extract(t, r'{FRONT}', 1)"),
    "vec_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vec_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))"),
}


class _Chunks:
    def eval(self, text: str):
        from corpusmill.operators.chunking import chunks_of, tokens_of

        for i, (path, t) in enumerate(chunks_of(text) if text else []):
            yield f"c{i:04d}", path, tokens_of(t), t


def _stem(words: pd.Series) -> pd.Series:
    return words.map(stem_en, na_action="ignore")


def register_functions(spark: SparkSession) -> None:
    """Register tokenize, count_tokens, front_block, vec_dot, vec_cosine, stem_en and the table function chunk_text for this session.

    Null gives null; chunk_text(text) gives chunk_id, heading_path, tokens, text of each chunk, and no row for null and
    blank texts. The cosine with a zero vector is null, as is a product of vectors of different length.
    """
    for name, (parameters, kind, expression) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {expression}")
    spark.udf.register("stem_en", F.pandas_udf(_stem, "string"))
    spark.udtf.register("chunk_text", F.udtf(_Chunks, returnType="chunk_id string, heading_path string, tokens int, text string"))
