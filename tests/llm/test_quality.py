import numpy as np
import pytest
from pyspark.sql import functions as F

from yardbook.llm import quality

LARGER = "/root/testdata/sf0.01"


def test_thresholds_are_ordered_and_grades_follow_the_features():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 4, 400)
    rows = [np.array([3, 8], np.int32)] * 400
    values = [np.array([g / 4 + rng.normal(0, 0.02), 1 - g / 4], np.float32) for g in grades]
    weights, thresholds = quality.fit(rows, values, grades)
    assert len(thresholds) == 3 and (np.diff(thresholds) > 0).all()
    score = np.array([weights[r] @ v for r, v in zip(rows, values)])
    assert (np.searchsorted(thresholds, score) == grades).mean() > 0.95


def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = quality.scored(docs, quality.ratings(labels.where(~held))).join(labels.where(held), "doc_id").collect()
    assert len(got) > 50 and np.mean([r.keeps == bool(r.quality) for r in got]) > 0.97
    assert all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in got)


def test_odd_rows_keep_their_columns(spark, docs_frame):
    rows = [(i, "GOOD words and more of them", "s") if i % 2 else (i, "%%% ### $$$ %%%", "s") for i in range(40)]
    rows += [(90, None), (91, ""), (None, "GOOD words"), (1, "GOOD words and more of them"), (92, "GOOD words " * 100_000)]
    frame = docs_frame(rows).withColumns({"tail": F.lit(1), "grade": F.lit("x"), "_grade": F.lit(2)})
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(1, 1), (None, 0), (7, None), (500, 0)], "doc_id long, grade int")
    kept = quality.keep_good(frame, labels)
    assert kept.columns == frame.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in range(40) if i % 2} | {92, None} <= ids and not ids & {i for i in range(40) if i % 2 == 0}


def test_nothing_to_learn(spark, docs_frame):
    frame = docs_frame([(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert [(r.tail, r.keeps, r.expected_grade) for r in quality.scored(frame, none).collect()] == [(1.0, True, None)] * 2
    assert quality.keep_good(docs_frame([]), none).count() == 0
