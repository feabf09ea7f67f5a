"""Texts go to Python workers some megabytes at a time, and are taken one by one there."""

from __future__ import annotations

import pyarrow as pa
import pytest

from narae.operators import detect, fix
from narae.sources import tokens

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def docs(spark):
    yield spark.createDataFrame([(1, "몇일 동안 쉬었다"), (2, None)], "doc_id long, text string")
    spark.conf.unset(NAME)


def test_texts_are_sent_in_small_batches(spark, docs):
    edits = spark.createDataFrame([], "doc_id long, edits array<struct<start:long,end:long,turn:int,original:string,suggestion:string,rule_id:string>>")
    steps = [lambda: tokens.tokens(docs), lambda: tokens.range_table(docs), lambda: detect.pattern_places(docs, ["몇일"]), lambda: fix.applied(docs, edits)]
    for step in steps:
        spark.conf.set(NAME, "67108864b")  # Spark's default: 64 MB a worker, several times over
        step()
        assert spark.conf.get(NAME) == "8m"
        spark.conf.set(NAME, "3m")  # a setting of the session's own stays
        step()
        assert spark.conf.get(NAME) == "3m"


def test_rows_of_a_batch_come_one_at_a_time():
    from narae.session import rows_of

    found = rows_of(pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["가", None])], names=["a", "b"]))
    assert next(found) == (1, "가") and next(found) == (2, None) and next(found, None) is None
