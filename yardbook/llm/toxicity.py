"""Toxicity by two class-conditional Kneser-Ney language models.

Each class gets an interpolated bigram model. Its highest order are discounted bigram counts, below it
discounted continuation counts (in how many different contexts a word follows), and below that one
distribution that both classes share: in how many documents of the whole corpus a word stands. Counts of
one, two and more have discounts of their own, estimated from how many counts there are of one to four; a
bigram that was seen once is left to the lower orders.

A text's score compares the length-normalised log-likelihoods of the two models: the mean difference per
word with its context and without, over the whole text, and without context over its most toxic words (the
first, the first two and the first three), so that a few expressions in a long text are seen. A logistic
calibration, fitted on labelled rows that gave no counts, turns these into a score.

At most ``sample`` labelled rows of each class give counts (smallest hash of the identifier first); the
class tables are bounded by them. The shared counts come from all documents, and all documents are
scored, whole. Words reach the model as 64-bit hashes of their lower-cased form without signs around.

Defined results: null and empty texts have no evidence and get the score of two zero differences;
labels without a document or class are ignored, repeated ones count once, toxic if any says so; if one
class has no rows all scores are 0; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, text_of, text_slices, words

SAMPLE = 4000
PEAKS = 3
_SLICE = 1 << 18
CALIBRATION = 4  # every fourth sampled row gives no counts


def _tokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, signs counted as white space."""
    plain = data.copy()
    plain[(data < 128) & ~_WORD_BYTES[data]] = 32
    hashes, _, _, upto = words(plain, ends)
    return hashes.view(np.int64), upto


_WORD_BYTES = np.zeros(256, bool)
for _low, _high in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _WORD_BYTES[_low : _high + 1] = True


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """Keys of the bigrams (word i - 1, word i) for i > 0."""
    with np.errstate(over="ignore"):
        return mix(mix(hashes[:-1].view(np.uint64)) + hashes[1:].view(np.uint64)).view(np.int64)


def _count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, context, word, key): the different bigrams of each text."""
    for batch in batches:
        classes, contexts, followers = [], [], []
        row_class = batch.column(0).to_numpy()
        for row, _, data, ends in text_slices(batch.column(1), _SLICE):
            hashes, upto = _tokens(data, ends)
            begin = 0
            for i, end in enumerate(upto):
                own = hashes[begin:end]
                if len(own):
                    pair = np.unique(np.stack([np.concatenate([[0], own[:-1]]), own], axis=1), axis=0)
                    classes.append(np.full(len(pair), row_class[row + i]))
                    contexts.append(pair[:, 0])
                    followers.append(pair[:, 1])
                begin = end
        if classes:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (classes, contexts, followers)], names=["toxic", "context", "word"]
            )


def shared_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents of the corpus that hold each word of the sorted ``vocabulary``; sum over all words."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocabulary)

    def count(batches):
        table = known.value
        found, total = np.zeros(len(table), np.int64), 0
        for batch in batches:
            for _, _, data, ends in text_slices(batch.column(0), _SLICE):
                hashes, upto = _tokens(data, ends)
                begin = 0
                for end in upto:
                    own = np.unique(hashes[begin:end])
                    total += len(own)
                    at = np.searchsorted(table, own)
                    at = at[at < len(table)] if len(table) else at[:0]
                    own = own[: len(at)]
                    found[at[table[at] == own]] += 1
                    begin = end
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([some, [-1]])), pa.array(np.concatenate([found[some], [total]]))], names=["at", "n"]
        )

    rows = docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary), np.int64)
    total = 0
    for r in rows:
        if r["at"] < 0:
            total = r["n"]
        else:
            out[r["at"]] = r["n"]
    return out, total


class Model:
    """Tables of log-likelihood differences, sorted by word and by bigram key."""

    def __init__(self, vocabulary, difference, shift, unknown, keys, pair_difference):
        self.vocabulary, self.difference, self.shift, self.unknown = vocabulary, difference, shift, unknown
        self.keys, self.pair_difference = keys, pair_difference
        self.seen = np.zeros(1 << 22, bool)
        self.seen[keys & ((1 << 22) - 1)] = True

    def evidence(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(word | toxic) - log P(word | ordinary), given the context and without; ``first``: no context."""
        if len(self.vocabulary) == 0 or len(hashes) == 0:
            return (np.full(len(hashes), self.unknown),) * 2
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == hashes
        alone = np.where(hit, self.difference[at], self.unknown)
        out = alone.copy()
        shift = np.where(hit, self.shift[at], 0.0)[:-1]
        shift[first[1:]] = 0.0
        out[1:] += shift
        if len(self.keys):
            pairs = _pairs(hashes)
            some = np.flatnonzero(self.seen[pairs & ((1 << 22) - 1)] & ~first[1:])
            place = np.minimum(np.searchsorted(self.keys, pairs[some]), len(self.keys) - 1)
            right = self.keys[place] == pairs[some]
            out[some[right] + 1] = self.pair_difference[place[right]]
        return out, alone

    def measures(self, column: pa.Array) -> np.ndarray:
        """(texts, 2 + PEAKS): mean differences of the whole text and of its 1, 2, ... most toxic words."""
        out = np.zeros((len(column), 2 + PEAKS))
        for row, _, data, ends in text_slices(column, _SLICE):
            hashes, upto = _tokens(data, ends)
            begins = np.concatenate([[0], upto[:-1]])
            first = np.zeros(len(hashes), bool)
            first[begins[begins < len(hashes)]] = True
            joint, alone = self.evidence(hashes, first)
            for i, (begin, end) in enumerate(zip(begins, upto)):
                if end > begin:
                    own = alone[begin:end]
                    top = np.zeros(PEAKS)
                    size = min(PEAKS, end - begin)
                    top[:size] = np.sort(np.partition(own, end - begin - size)[end - begin - size :])[::-1]
                    out[row + i] = joint[begin:end].mean(), own.mean(), *(np.cumsum(top) / np.arange(1, PEAKS + 1))
        return out


def discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """What is taken off counts of one, two and more, from how many counts are one, two, three and four."""
    if not (ones and twos and threes):
        return 0.5, 0.75, 0.75  # too few counts to estimate from
    y = ones / (ones + 2 * twos)
    found = 1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes
    return tuple(min(max(d, 0.1), k + 0.9) for k, d in enumerate(found))


def _estimated(counts: DataFrame) -> dict[int, tuple[float, float, float]]:
    """Discounts of each class from rows (toxic, n)."""
    rows = counts.where("n <= 4").groupBy("toxic", "n").count().collect()  # at most four a class
    found = {(r["toxic"], r["n"]): r["count"] for r in rows}
    return {c: discounts(*(found.get((c, k), 0) for k in (1, 2, 3, 4))) for c in (0, 1)}


def _kept(n, taken: tuple[float, float, float]):
    """Counts less their discounts, for numbers."""
    n = np.asarray(n, float)
    return np.maximum(n - np.select([n <= 1, n <= 2], taken[:2], taken[2]), 0.0)


def _kept_column(taken: dict[int, tuple[float, float, float]]) -> Column:
    """The same for the columns ``toxic`` and ``n``."""
    n, out = F.col("n"), F.lit(0.0)
    for c, (one, two, more) in taken.items():
        off = F.when(n <= 1, one).when(n <= 2, two).otherwise(more)
        out = F.when(F.col("toxic") == c, F.greatest(n - off, F.lit(0.0))).otherwise(out)
    return F.sum(out)


def build(docs: DataFrame, sampled: DataFrame) -> Model | None:
    """The model from sampled rows (toxic, text) and the shared counts of ``docs`` (text)."""
    bigrams = sampled.mapInArrow(_count_bigrams, "toxic long, context long, word long")
    counted = cut(bigrams.groupBy("toxic", "context", "word").agg(F.count("*").alias("n")))
    by_word = cut(counted.groupBy("toxic", "word").agg(F.count("*").alias("n")))
    word_off, pair_off = _estimated(by_word), {c: (1.0, *d[1:]) for c, d in _estimated(counted).items()}
    sums = by_word.groupBy("toxic").agg(F.sum("n").cast("double").alias("held"), _kept_column(word_off).alias("kept"))
    totals = {r.toxic: (r.held, r.kept) for r in sums.collect()}
    if set(totals) != {0, 1}:
        return None
    # All tables below are bounded by the sample: its words, and the bigrams that are in more than one of its rows.
    sides = [F.coalesce(F.sum(F.when(F.col("toxic") == c, F.col("n"))), F.lit(0)).alias(str(c)) for c in (0, 1)]
    frame = by_word.groupBy("word").agg(*sides).toPandas().sort_values("word").reset_index(drop=True)
    vocabulary = frame["word"].to_numpy(np.int64)
    holders, all_holders = shared_counts(docs, vocabulary)
    shared = (holders + 1.0) / (all_holders + len(vocabulary) + 1.0)
    floor = {c: 1.0 - totals[c][1] / totals[c][0] for c in (0, 1)}
    lower = {c: _kept(frame[str(c)], word_off[c]) / totals[c][0] + floor[c] * shared for c in (0, 1)}
    by_context = counted.groupBy("toxic", "context").agg(F.sum("n").cast("double").alias("held"), _kept_column(pair_off).alias("kept"))
    contexts = by_context.where("kept > 0").toPandas()
    weight, held = ({c: np.full(len(vocabulary), x) for c in (0, 1)} for x in (1.0, 0.0))
    for c in (0, 1):
        own = contexts[(contexts["toxic"] == c) & contexts["context"].isin(vocabulary)]
        place = np.searchsorted(vocabulary, own["context"].to_numpy(np.int64))
        weight[c][place], held[c][place] = 1.0 - own["kept"] / own["held"], own["held"]
    both = counted.where(F.col("context") != 0).groupBy("context", "word").pivot("toxic", [0, 1]).agg(F.first("n")).fillna(0)
    pairs = both.where(F.greatest("0", "1") > 1).toPandas()
    pairs = pairs[pairs["context"].isin(vocabulary)]
    left, right = (np.searchsorted(vocabulary, pairs[c].to_numpy(np.int64)) for c in ("context", "word"))
    logs = []
    for c in (1, 0):
        own = _kept(pairs[str(c)], pair_off[c]) / np.maximum(held[c][left], 1.0)
        logs.append(np.log(own + weight[c][left] * lower[c][right]))
    with np.errstate(over="ignore"):
        keys = mix(mix(pairs["context"].to_numpy(np.int64).view(np.uint64)) + pairs["word"].to_numpy(np.int64).view(np.uint64)).view(np.int64)
    order = np.argsort(keys)
    return Model(
        vocabulary,
        np.log(lower[1]) - np.log(lower[0]),
        np.log(weight[1]) - np.log(weight[0]),
        float(np.log(floor[1]) - np.log(floor[0])),
        keys[order],
        (logs[0] - logs[1])[order] if len(pairs) else np.zeros(0),
    )


def calibrate(measures: np.ndarray, toxic: np.ndarray, importance: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Logistic weights (constant first), fitted on standardised measures, given for the plain ones."""
    centre, spread = measures.mean(axis=0), measures.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(measures)), (measures - centre) / spread])
    ridge = np.array([0.0, *np.ones(measures.shape[1])])
    beta = np.zeros(len(ridge))
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (importance * (p - toxic)) + penalty * ridge * beta
        curve = (x * (importance * p * (1 - p))[:, None]).T @ x + penalty * np.diag(ridge + 1e-6)
        beta -= np.linalg.solve(curve, slope)
    out = beta / np.concatenate([[1.0], spread])
    out[0] = beta[0] - (beta[1:] * centre / spread).sum()
    return out


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of each row; ``labels``: (doc_id, toxic) to learn from."""
    spark = docs.sparkSession
    plain = docs.select(docs[doc_id].alias("doc_id"), text_of(docs, text).alias("text"))
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = None
    for value in (0, 1):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    # Bounded by `sample` rows of each class.
    picked = picked.withColumn("checks", F.pmod(F.xxhash64(F.lit("check"), "doc_id"), F.lit(CALIBRATION)) == 0)
    sampled = cut(plain.join(F.broadcast(picked), "doc_id"))
    model = build(plain.select("text"), sampled.where("not checks").select("toxic", "text")) if set(sizes) == {0, 1} else None
    if model is None:
        return plain.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = spark.sparkContext.broadcast(model)

    names = ["mean", "alone", *(f"peak{k}" for k in range(1, PEAKS + 1))]

    @F.pandas_udf(", ".join(f"{name} double" for name in names))
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.measures(pa.array(texts, pa.large_string(), from_pandas=True)), columns=names)

    checks = sampled.where("checks").select("toxic", measure("text").alias("m")).select("toxic", "m.*").toPandas()
    checks = checks.sort_values(["toxic", *names])
    y = checks["toxic"].to_numpy(float)
    importance = np.array([sizes[int(v)] / max(1, (y == v).sum()) for v in y]) * len(y) / max(1, sum(sizes.values()))
    beta = calibrate(checks[names].to_numpy(), y, importance) if len(set(y)) == 2 else np.array([-1.0, *np.ones(len(names))])
    inner = F.lit(float(beta[0]))
    for name, slope in zip(names, beta[1:]):
        inner = inner + F.col(f"m.{name}") * float(slope)
    score = 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), inner))))
    scored = plain.select("doc_id", measure("text").alias("m")).select("doc_id", score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
