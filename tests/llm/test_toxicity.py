import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from yardbook.llm import queries, toxicity

LARGER = "/root/testdata/sf0.1"


def plain_discounts(counts):
    """Discounts of counts of one, two and more."""
    n = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
    if 0 in n[:3]:
        return 0.5, 0.75, 0.75
    y = n[0] / (n[0] + 2 * n[1])
    found = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return tuple(min(max(d, 0.1), k + 0.9) for k, d in enumerate(found))


def plain_model(texts, corpus):
    """The same two models with dictionaries of words."""
    grams, followers = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    for label, text in texts:
        w = text.split()
        for pair in {*zip([None, *w], w)}:
            grams[label][pair] += 1
    for label in (0, 1):
        followers[label].update(w for _, w in grams[label])
    known = {w for c in followers.values() for w in c}
    holders = Counter(w for t in corpus for w in set(t.split()))
    shared = {w: (holders[w] + 1) / (sum(holders.values()) + len(known) + 1) for w in known}
    word_off = {c: plain_discounts(followers[c].values()) for c in (0, 1)}
    pair_off = {c: (1.0, *plain_discounts(grams[c].values())[1:]) for c in (0, 1)}

    def less(n, off):
        return max(n - off[min(n, 3) - 1], 0) if n else 0

    def alone(label, word):
        held = sum(followers[label].values())
        kept = sum(less(n, word_off[label]) for n in followers[label].values())
        return less(followers[label][word], word_off[label]) / held + (1 - kept / held) * shared[word]

    def chance(label, before, word):
        low, context = alone(label, word), {w: n for (v, w), n in grams[label].items() if v == before}
        kept = sum(less(n, pair_off[label]) for n in context.values())
        if before is None or not kept:
            return low
        total = sum(context.values())
        return less(context.get(word, 0), pair_off[label]) / total + (1 - kept / total) * low

    return known, alone, chance


def test_model_matches_plain_counts(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(25)] + [f"rare{i}" for i in range(40)]
    weights = [20] * 25 + [1] * 40
    texts = [(i % 2, " ".join(rng.choices(words[i % 2 :], weights[i % 2 :], k=rng.randrange(5, 40)))) for i in range(60)]
    corpus = [t for _, t in texts] + [" ".join(rng.choices(words + ["other"], k=30)) for _ in range(40)]
    known, alone, chance = plain_model(texts, corpus)
    assert any(0 < d < 1 for d in plain_discounts(Counter(w for _, t in texts for w in t.split()).values()))
    model = toxicity.build(
        spark.createDataFrame([(t,) for t in corpus], "text string"), spark.createDataFrame(texts, "toxic long, text string")
    )
    for text in corpus:
        w = [x for x in text.split() if x in known]
        want = [math.log(chance(1, v, x) / chance(0, v, x)) for v, x in zip([None, *w], w)]
        plain = [math.log(alone(1, x) / alone(0, x)) for x in w]
        data = " ".join(w).encode()
        hashes, _ = toxicity._tokens(np.frombuffer(data, np.uint8), np.array([len(data)]))
        got = model.evidence(hashes, np.arange(len(hashes)) == 0)
        assert np.allclose(got[0], want) and np.allclose(got[1], plain)
        top = sorted([*plain, 0.0, 0.0, 0.0][: max(3, len(plain))], reverse=True)
        measures = [np.mean(want), np.mean(plain), top[0], np.mean(top[:2]), np.mean(top[:3])]
        assert np.allclose(model.measures(pa.array([" ".join(w)]))[0], measures)


def test_discounts():
    assert toxicity.discounts(100, 40, 20, 10) == plain_discounts([1] * 100 + [2] * 40 + [3] * 20 + [4] * 10)
    assert toxicity.discounts(0, 5, 5, 5) == (0.5, 0.75, 0.75)
    one, two, more = toxicity.discounts(1000, 300, 150, 90)
    assert 0 < one < 1 < two < 2 and more < 3


def test_held_out_labels(spark):
    got = queries.toxicity_scores(spark, LARGER)
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    assert got.count() == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.toxic for r in rows]) > 0.98
    assert np.mean([r.predicted for r in rows if r.toxic]) > 0.82 and np.mean([r.predicted for r in rows if not r.toxic]) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.collect())


def test_odd_rows(spark, docs_frame):
    rows = [(i, "plain words here " * 5 + ("bad insult word " * 2 if i % 2 else "nice kind word " * 2)) for i in range(60)]
    odd = [(100, None), (101, ""), (102, "... !!"), (None, "bad insult word"), (1, rows[1][1]), (103, "plain words here " * 60_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    frame = docs_frame(rows + odd).withColumns({"score": F.lit("x"), "m": F.lit(1), "toxic": F.lit(1)})
    got = defaultdict(set)
    for r in toxicity.toxicity(frame, labels).collect():
        got[r.doc_id].add(r.predicted)
    assert all(got[i] == {i % 2} for i in range(60)) and got[None] == {1} and got[103] == {0}
    assert got[100] == got[101] == got[102] and len(got[100]) == 1
    one = toxicity.toxicity(frame, labels.where("toxic = 0")).collect()
    assert {(r.score, r.predicted) for r in one} == {(0.0, 0)} and len(one) == len(rows + odd)
    assert toxicity.toxicity(docs_frame([]), labels).count() == 0
