"""Language identification by error-correcting output codes.

Every language has a codeword of bits. One binary classifier a bit - logistic regression on hashed byte
n-grams - learns from labelled texts which side of the bit a text's language is on. Up to five languages get the
exhaustive code (all ways to split them in two); more get a code of ``BITS_PER_DOUBLING`` bits for each
doubling of their number, chosen among seeded draws for the largest least Hamming distance, so that a
few wrong bits still leave the right codeword nearest.

*Decoding* is loss-weighted: a language's loss is the sum over bits of ``log(1 + exp(-code * margin))``,
each bit weighing what its classifier explains of labelled texts that it did not learn from. The smallest
loss wins, ties to the first language by code point; the score is its share of ``exp(-loss)`` over all languages. A text whose second
language comes within ``margin`` of the first is flagged as ambiguous.

A text is its lower-cased (A-Z) words - runs of ASCII letters and non-ASCII bytes - each between two
spaces; its features are the shares of its byte n-grams of 2 to 4 bytes in ``DIMENSIONS`` hashed places.

The model learns from at most ``sample`` labelled rows, the same number of each language (smallest hash
of the text first); their features are all that reaches the driver. Every text is scored, whole, in one
pass without a shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0; if nothing can be
learnt all texts are; one learnt language is given to every text with score 1; labels that are null are not
learnt; repeated rows are scored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, text_of, text_slices

DIMENSIONS = 1 << 13
SAMPLE = 3000
CHECKS = 5  # every fifth sampled text weighs the bits and is not learnt from
BITS_PER_DOUBLING = 10
MARGIN = 0.7
LITTLE = 20  # n-grams of no language that every text has besides its own, so that short texts weigh less
ORDERS = (2, 3, 4)
UNDETERMINED = "und"
_SLICE = 1 << 18
_SCALE = 30.0

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def _grams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each n-gram, number of the text it is in) of texts that end at ``ends``."""
    # Each text begins and ends with a space; n-grams of one space after another are left out.
    sizes = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(len(ends)), sizes + 2)
    plain = np.full(len(owner), 32, np.uint8)
    begins = np.cumsum(sizes + 2) - sizes - 1
    plain[np.arange(len(data)) + np.repeat(begins - (ends - sizes), sizes)] = _PLAIN[data]
    space = plain == 32
    places, owners = [], []
    code = plain.astype(np.uint64)
    inner = np.zeros(len(plain), bool)  # an n-gram may begin or end with a space but holds none inside
    for n in range(2, min(max(ORDERS), len(plain)) + 1):
        code = (code[:-1] << np.uint64(8)) | plain[n - 1 :]
        inner = inner[:-1] | (space[n - 2 : -1] if n > 2 else np.False_)
        if n in ORDERS:
            only_space = space[: len(code)] & space[n - 1 :] if n == 2 else np.False_
            at = np.flatnonzero(~inner & ~only_space & (owner[: len(code)] == owner[n - 1 :]))
            places.append((mix(code[at] + (np.uint64(n) << np.uint64(40))) % np.uint64(DIMENSIONS)).astype(np.int32))
            owners.append(owner[at])
    if not places:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(owners)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, value = [], []
        for row, after, data, ends in text_slices(batch.column(1), _SLICE):
            place, owner = _grams(data, ends)
            order = np.argsort(owner, kind="stable")
            place, cuts = place[order], np.searchsorted(owner[order], np.arange(after - row + 1))
            for i in range(after - row):
                found, count = np.unique(place[cuts[i] : cuts[i + 1]], return_counts=True)
                at.append(found.astype(np.int32).tobytes())
                value.append((_SCALE * count / (count.sum() + LITTLE)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["lang", "at", "value"])


def codewords(languages: int) -> np.ndarray:
    """(languages, bits) of -1 and 1: distinct codewords, no bit the same for all, no two bits alike."""
    if languages <= 5:
        rest = np.arange(2 ** (languages - 1) - 1)
        bits = [np.ones(len(rest), int)] + [np.where(rest >> k & 1, 1, -1) for k in range(languages - 1)]
        return np.stack(bits)
    size = int(np.ceil(BITS_PER_DOUBLING * np.log2(languages)))
    best, reached = None, -1
    for seed in range(20):
        random = np.random.default_rng(seed)
        # Balanced bits: half of the languages on either side.
        draw = np.stack([random.permutation(np.arange(languages) % 2) * 2 - 1 for _ in range(size)], axis=1)
        draw = draw * draw[:1]
        draw = np.unique(draw, axis=1)
        apart = (draw.shape[1] - draw @ draw.T) // 2
        np.fill_diagonal(apart, draw.shape[1])
        if apart.min() > reached:
            best, reached = draw, int(apart.min())
    return best


def fit(features: np.ndarray, sides: np.ndarray, steps: int = 60, penalty: float = 1e-4) -> np.ndarray:
    """(DIMENSIONS + 1, bits) weights, the last row constant, of one logistic regression a bit."""
    rows, bits = sides.shape
    weights, constant = np.zeros((features.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    # Both sides of a bit weigh the same.
    share = np.where(sides > 0, 0.5 / np.maximum(1, (sides > 0).sum(axis=0)), 0.5 / np.maximum(1, (sides < 0).sum(axis=0)))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, constant)]
    for step in range(1, steps + 1):
        margin = np.clip(sides * (features @ weights + constant), -30, 30)
        error = (-sides * share / (1.0 + np.exp(margin))).astype(np.float32)
        for p, g, (m, v) in zip((weights, constant), (features.T @ error + penalty * weights, error.sum(axis=0)), moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return np.concatenate([weights, constant[None]])


class Model:
    """Languages by code point, their codewords, the weights of each bit and what each bit is worth."""

    def __init__(self, languages: list[str], codes: np.ndarray, weights: np.ndarray, worth: np.ndarray):
        self.languages, self.codes, self.weights, self.worth = languages, codes, weights, worth

    def margins(self, column: pa.Array) -> np.ndarray:
        """(texts, bits): positive where a text's language is on the bit's positive side."""
        out = np.zeros((len(column), self.codes.shape[1]))
        for row, after, data, ends in text_slices(column, _SLICE):
            place, owner = _grams(data, ends)
            count = np.bincount(owner, minlength=after - row)
            for bit in range(out.shape[1]):
                sums = np.bincount(owner, self.weights[place, bit], after - row)
                out[row:after, bit] = _SCALE * sums / (count + LITTLE) + self.weights[-1, bit]
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the nearest codeword, its share, by how much its loss is the smaller one)."""
        losses = np.zeros((len(margins), len(self.languages)))
        for k, code in enumerate(self.codes):
            losses[:, k] = (np.logaddexp(0.0, -code * margins) * self.worth).sum(axis=1)
        nearest = losses.argmin(axis=1)
        if len(self.languages) == 1:
            return nearest, np.ones(len(margins)), np.full(len(margins), np.inf)
        ordered = np.sort(losses, axis=1)
        return nearest, 1.0 / np.exp(ordered[:, :1] - ordered).sum(axis=1), ordered[:, 1] - ordered[:, 0]


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model from ``labelled`` (lang, text), or None without a labelled text."""
    known = labelled.where(F.col("lang").isNotNull())
    each = sample // max(1, known.select("lang").distinct().count())
    known = known.where(has_letter(F.col("text"))).withColumn("order", F.xxhash64("text"))
    # Equal texts count once. Hashes are spread evenly, so the smallest ones of a large language are known by
    # its size, and its rows never meet in one task to be cut there.
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("order").alias("size"))
    share = F.col("order") / F.lit(2.0**64) + 0.5
    # One row a language, fewer than the model has that is broadcast below.
    few = known.select("lang", "order").join(F.broadcast(sizes), "lang").where(share * F.col("size") <= 1.5 * max(1, each) + 100).select("lang", "order")
    first = Window.partitionBy("lang").orderBy("order")
    keys = few.distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= max(1, each))
    picked = known.join(F.broadcast(keys.drop("place")), ["lang", "order"]).dropDuplicates(["lang", "order"])
    # Bounded by `sample` rows of at most DIMENSIONS features.
    found = picked.select("lang", "text").mapInArrow(_sample_features, "lang string, at binary, value binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["value"])))
    languages = sorted({r["lang"] for r in found})
    if not languages:
        return None
    codes = codewords(len(languages))
    if len(languages) == 1:
        return Model(languages, codes, np.zeros((DIMENSIONS + 1, codes.shape[1]), np.float32), np.ones(codes.shape[1]))
    features = np.zeros((len(found), DIMENSIONS), np.float32)
    for i, r in enumerate(found):
        features[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["value"], np.float32)
    sides = codes[[languages.index(r["lang"]) for r in found]]
    checks = np.arange(len(found)) % CHECKS == CHECKS - 1
    weights = fit(features[~checks], sides[~checks])
    worth = np.ones(codes.shape[1])
    if checks.any():
        margin = sides[checks] * (features[checks] @ weights[:-1] + weights[-1])
        worth = np.maximum(0.05, 1.0 - np.logaddexp(0.0, -np.clip(margin, -30, 30)).mean(axis=0) / np.log(2.0))
    return Model(languages, codes, weights, worth)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def languages(
    docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, margin: float = MARGIN, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``ambiguous`` of each row; ``labelled``: (lang, text) to learn from."""
    plain = docs.select(docs[doc_id].alias("doc_id"), text_of(docs, text).alias("text"))
    model = train(labelled.select(labelled["lang"].cast("string").alias("lang"), text_of(labelled).alias("text")), sample)
    if model is None:
        return plain.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    # Fixed size: DIMENSIONS weights a bit, and the languages with their codewords.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred string, score double, ambiguous boolean>")
    def decode(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        nearest, score, ahead = own.decode(own.margins(pa.array(texts, pa.large_string(), from_pandas=True)))
        return pd.DataFrame({"lang_pred": np.array(own.languages, object)[nearest], "score": score, "ambiguous": ahead < margin})

    scored = plain.select("doc_id", has_letter(F.col("text")).alias("letter"), decode("text").alias("found"))
    return scored.select(
        "doc_id",
        F.when(F.col("letter"), F.col("found.lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col("letter"), F.col("found.score")).otherwise(0.0).alias("score"),
        (F.col("found.ambiguous") | ~F.col("letter")).alias("ambiguous"),
    )
