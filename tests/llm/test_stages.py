"""Each stage of the pipeline on odd rows: nulls, empty and long texts, repeated rows, clashing names, an empty table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DIR = "/root/testdata/sf0.001"
ROWS = [
    (1, None, "en", None, None), (2, "", "en", "a", 0), (3, "x", None, "a", 1), (4, "one two three four", "en", "b", 18), (4, "one two three four", "en", "b", 18),
    (None, "one two three four five", "en", "b", 23), (6, "word " * 300_000, "en", "c", 1_500_000), (7, "é\n\n日本語 \U0001f600", "fr", "c", 9), (8, " \n\t ", "fr", "a", 4),
]
ODD = ("_served", "n_removed", "n_lines", "_bad", "_gone", "d", "id", "size", "a.b", "key", "codes", "bucket", "component_id")


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stage_keeps_columns_and_takes_odd_rows(spark, stage):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in ODD})
    out = stage[1](spark, df, DIR)
    assert out.columns == df.columns
    rows = out.collect()
    assert all(r[c] == c for r in rows for c in ODD)
    assert {r.doc_id for r in rows} <= {r[0] for r in ROWS} and rows
    assert stage[1](spark, df.limit(0), DIR).count() == 0


def test_packing_takes_odd_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in ODD})
    rows = corpus_pipeline.STAGES[-1][1](spark, df, DIR).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ROWS}
    assert corpus_pipeline.STAGES[-1][1](spark, df.limit(0), DIR).count() == 0
