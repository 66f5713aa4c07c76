"""Quality grades by ordinal cumulative-link regression on hashed text.

``P(grade > k) = sigmoid(w . x - threshold_k)`` with one weight vector for all grades and ordered
thresholds. ``x`` is the mean over a text's words of hashed features: the lower-cased word, its shape
(case, signs, digits, length), its last bytes, and whether it repeats the word before. The expected
grade is the sum of these probabilities; a document is kept if ``P(grade >= select)`` is at least 1/2.

The model is fitted on at most ``sample`` labelled rows of each grade, those with the smallest hash of
the identifier; their features (at most ``DIMENSIONS`` a row) are all that reaches the driver. Every
document is scored, whole, in one pass without a shuffle.

Defined results: null and empty texts have no features and are graded by the thresholds alone; labels
without a rating or document are ignored, repeated ones count once; with fewer than two grades to
learn from every document is kept with the expected grade null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, mix, text_of, text_slices, words

DIMENSIONS = 1 << 14
SAMPLE = 3000
_SCALE = 10.0
_SLICE = 1 << 18
_BLOCK = 1 << 17


def _features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, 4) feature numbers, and the words up to each text's end."""
    hashes, starts, stops, upto = words(data, ends)
    lengths = stops - starts

    def inside(kind: np.ndarray) -> np.ndarray:
        """How many bytes of a kind are in each word."""
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind, out=sums[1:])
        return (sums[stops] - sums[starts]).astype(np.int64)

    capital = (data >= 65) & (data <= 90)
    n_upper, n_digit = inside(capital), inside((data >= 48) & (data <= 57))
    n_letter = inside(capital | ((data >= 97) & (data <= 122)) | (data >= 128))
    signs = lengths - n_letter - n_digit
    shape = np.minimum(n_upper, 3) + 4 * np.minimum(n_digit, 2) + 12 * np.minimum(signs, 4) + 60 * np.minimum(lengths // 4, 4)
    tail = np.zeros(len(starts), np.uint64)
    for back in (1, 2, 3):
        at = np.maximum(stops - back, starts)
        tail = tail * np.uint64(256) + np.where(stops - back >= starts, data[at], 0).astype(np.uint64)
    repeats = np.zeros(len(hashes), np.uint64)
    repeats[1:] = hashes[1:] == hashes[:-1]
    first = np.concatenate([[0], upto[:-1]])
    repeats[first[first < len(repeats)]] = 0
    kinds = [hashes, shape.astype(np.uint64) + np.uint64(1 << 40), tail + np.uint64(1 << 41), repeats + np.uint64(1 << 42)]
    return np.stack([(mix(k) % np.uint64(DIMENSIONS)).astype(np.int32) for k in kinds], axis=1), upto


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, value = [], []
        for _, _, data, ends in text_slices(batch.column(1), _SLICE):
            numbers, upto = _features(data, ends)
            begin = 0
            for end in upto:
                found, count = np.unique(numbers[begin:end], return_counts=True)
                at.append(found.tobytes())
                value.append((count / max(1, end - begin)).astype(np.float32).tobytes())
                begin = end
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["grade", "at", "value"]
        )


def fit(rows: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, steps: int = 150, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ordered thresholds) of the cumulative-link model, each grade weighing the same."""
    at = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    value = np.concatenate(values) if values else np.zeros(0, np.float32)
    return _descend(at, value, np.array([len(r) for r in rows], np.int64), grades, steps, penalty)


def _descend(
    at: np.ndarray, value: np.ndarray, lengths: np.ndarray, grades: np.ndarray, steps: int = 150, penalty: float = 1e-4
) -> tuple[np.ndarray, np.ndarray]:
    """``fit`` of rows that stand one after the other; ``_BLOCK`` entries at a time are widened to 64 bits."""
    levels = int(grades.max())
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    blocks = [slice(k, k + _BLOCK) for k in range(0, len(at), _BLOCK)]

    def wide(block: slice) -> np.ndarray:
        return value[block].astype(float) * _SCALE

    share = 1.0 / np.bincount(grades, minlength=levels + 1)[grades]
    share /= share.sum()
    # Thresholds are a first one and positive gaps, so they stay ordered.
    weights, low, gaps = np.zeros(DIMENSIONS), np.zeros(1), np.zeros(max(levels - 1, 0))
    parameters = [weights, low, gaps]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parameters]
    above = grades[:, None] > np.arange(levels)[None, :]
    for step in range(1, steps + 1):
        thresholds = low[0] + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(gaps)))])
        score = np.zeros(len(lengths))
        for block in blocks:
            np.add.at(score, row[block], wide(block) * weights[at[block]])
        chance = 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - thresholds, -30, 30)))
        error = (chance - above) * share[:, None]
        by_threshold, by_row, slope = -error.sum(axis=0), error.sum(axis=1), np.zeros(DIMENSIONS)
        for block in blocks:
            np.add.at(slope, at[block], wide(block) * by_row[row[block]])
        slopes = [
            slope + penalty * weights,
            np.array([by_threshold.sum()]),
            np.array([by_threshold[k + 1 :].sum() for k in range(len(gaps))]) / (1.0 + np.exp(-gaps)),
        ]
        for p, g, (m, v) in zip(parameters, slopes, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights * _SCALE, low[0] + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(gaps)))])


def train(docs: DataFrame, labels: DataFrame, sample: int, text: str, doc_id: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The model from ``labels`` (doc_id, grade), or None if there is nothing to tell apart."""
    known = labels.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    levels = sorted(r.grade for r in known.select("grade").distinct().collect())  # a handful of grades
    if len(levels) < 2:
        return None
    picked = None
    for place, grade in enumerate(levels):
        part = known.where(F.col("grade") == grade).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        part = part.select("doc_id", F.lit(place).alias("grade"))
        picked = part if picked is None else picked.unionByName(part)
    # Bounded by `sample` rows of each grade.
    texts = docs.select(docs[doc_id].alias("doc_id"), text_of(docs, text).alias("text")).join(F.broadcast(picked), "doc_id")
    found = texts.select("grade", "text").mapInArrow(_sample_features, "grade int, at binary, value binary").collect()
    found.sort(key=lambda r: (r.grade, bytes(r.at), bytes(r.value)))
    grades = np.array([r.grade for r in found])
    if len(set(grades)) < 2 or grades.max() + 1 != len(set(grades)):
        return None
    at = np.frombuffer(b"".join(r.at for r in found), np.int32)
    value = np.frombuffer(b"".join(r.value for r in found), np.float32)
    lengths = np.array([len(r.at) // at.itemsize for r in found], np.int64)
    del found  # the arrays hold all of it
    return _descend(at, value, lengths, grades)


def _graded(docs: DataFrame, labels: DataFrame, name: str, select: int, sample: int, text: str, doc_id: str) -> DataFrame:
    """``docs`` plus the struct ``name`` of expected grade, tail and whether the document stays."""
    model = train(docs, labels, sample, text, doc_id)
    if model is None:
        nothing = F.struct(F.lit(None).cast("double").alias("expected_grade"), F.lit(1.0).alias("tail"), F.lit(True).alias("keeps"))
        return docs.withColumn(name, nothing)
    # Fixed size: DIMENSIONS numbers and a threshold for each grade.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<expected_grade double, tail double, keeps boolean>")
    def grade(texts: pd.Series) -> pd.DataFrame:
        weights, thresholds = shared.value
        out = np.zeros(len(texts))
        for row, after, data, ends in text_slices(pa.array(texts, pa.large_string(), from_pandas=True), _SLICE):
            numbers, upto = _features(data, ends)
            sums = np.concatenate([[0.0], np.cumsum(weights[numbers].sum(axis=1))])
            first = np.concatenate([[0], upto[:-1]])
            out[row:after] = (sums[upto] - sums[first]) / np.maximum(1, upto - first)
        chance = 1.0 / (1.0 + np.exp(-np.clip(out[:, None] - thresholds, -30, 30)))
        tail = chance[:, select - 1] if 0 < select <= len(thresholds) else np.full(len(out), float(select <= 0))
        return pd.DataFrame({"expected_grade": chance.sum(axis=1), "tail": tail, "keeps": tail >= 0.5})

    return docs.withColumn(name, grade(text_of(docs, text)))


def scored(docs: DataFrame, labels: DataFrame, select: int = 1, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``expected_grade``, ``tail`` (P(grade >= select)) and ``keeps`` of each row.

    ``select`` counts grades from the lowest one as 0.
    """
    slim = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return _graded(slim, labels, "grade", select, sample, "text", "doc_id").select("doc_id", "grade.*")


def keep_good(docs: DataFrame, labels: DataFrame, select: int = 1, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents of grade ``select`` or better; columns stay as they are."""
    name = free_name(docs, "_grade")
    return _graded(docs, labels, name, select, sample, text, doc_id).where(F.col(f"{name}.keeps")).drop(name)


def ratings(labels: DataFrame) -> DataFrame:
    """Graded ratings of the label table: 0 poor, 1 well formed but toxic, 2 good."""
    good: Column = F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))
    return labels.select("doc_id", good.cast("int").alias("grade"))
