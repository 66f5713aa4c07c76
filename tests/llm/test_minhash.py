import random

import pytest
from brute import near_links, shingle_set, smallest_reachable
from pyspark.sql import functions as F

from yardbook.llm import minhash, queries
from yardbook.llm.components import components


def expected(rows, n):
    sets = {i: shingle_set(t, n) for i, t in rows}
    return {i: (len(sets[i]), c) for i, c in smallest_reachable(sets, near_links(sets)).items()}


def near_copies(rng, base, count, changes):
    for _ in range(count):
        words = base[:]
        for _ in range(rng.randrange(changes)):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        yield " ".join(words)


@pytest.mark.parametrize("n", [2, 5])
def test_groups_match_brute_force(docs_frame, n):
    rng = random.Random(n)
    texts = []
    for size in (3, 6, 12, 40, 150):
        for _ in range(4):
            base = [f"w{rng.randrange(400)}" for _ in range(size)]
            texts += near_copies(rng, base, 12, 2 + size // 12)
    line = " ".join(f"common{i}" for i in range(12))
    texts += [line + " " + " ".join(f"w{rng.randrange(9999)}" for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    texts += ["", None, " \n", "one", "ONE", "Two words", "two  WORDS", "É", "é", "long " * 30_000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = minhash.near_groups(docs_frame(rows), n, wide=5).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected(rows, n)
    assert all(r.kept == (r.doc_id == r.component_id) == r.stays for r in got)


def test_null_and_repeated_identifiers(docs_frame):
    rows = [(None, "a b c"), (None, "a b c"), (3, "d e f"), (3, "d e f"), (4, "a b c"), (None, None), (5, "")]
    got = minhash.near_groups(docs_frame(rows), 2).collect()
    assert sorted([(r.doc_id, r.component_id, r.kept) for r in got], key=repr) == sorted(
        [(None, 4, False), (None, 4, False), (3, 3, True), (3, 3, True), (4, 4, True), (None, None, True), (5, 5, True)], key=repr
    )
    frame = docs_frame(rows).withColumns({"_row": F.lit(1), "size": F.lit("x"), "component": F.lit(2)})
    kept = minhash.keep_one(frame, 2)
    assert kept.columns == frame.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted(
        [(3, "d e f"), (4, "a b c"), (None, None), (5, "")], key=repr
    )


def test_empty_table(docs_frame):
    assert minhash.near_groups(docs_frame([])).count() == 0
    assert minhash.keep_one(docs_frame([])).count() == 0


def test_components_of_chains_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(1000, 1300)] + [(7, 7), (1, 9), (9, 1), (None, 3)]
    got = components(spark.createDataFrame(links, "a long, b long"))
    plain = [(a, b) for a, b in links if a is not None and a != b]
    assert {r.node: r.component for r in got.collect()} == smallest_reachable({x for e in plain for x in e}, plain)


def test_query_matches_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.near_dedup(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected(rows, 2)


def test_signatures_refuse_no_similar_pair(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from yardbook.llm.common import differ_little, parities

    random, words = np.random.default_rng(6), minhash.BITS // 64
    rows, true = [], []
    for _ in range(600):
        pool = np.unique(random.integers(-(2**63), 2**63 - 1, int(random.integers(1, 900))))
        keep = random.random(len(pool)) < random.uniform(0.3, 1.0)
        other = np.unique(np.concatenate([pool[keep], random.integers(-(2**63), 2**63 - 1, int(random.integers(0, len(pool) // 4 + 1)))]))
        if len(other):
            common = len(np.intersect1d(pool, other))
            true.append(common / (len(pool) + len(other) - common))
            both = parities(np.concatenate([pool, other]), np.array([0, len(pool)]), minhash.BITS)
            rows.append((len(true) - 1, len(pool), len(other), *both[0].tolist(), *both[1].tolist()))
    names = ["k", "m", "n", *(f"a{k}" for k in range(words)), *(f"b{k}" for k in range(words))]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    near = differ_little("a", "b", F.col("m"), F.col("n"), words, 80)
    passed = {r.k: r.ok for r in frame.select("k", near.alias("ok")).collect()}
    assert sum(j >= 0.8 for j in true) > 50 and all(passed[k] for k, j in enumerate(true) if j >= 0.8)
    far = [k for k, j in enumerate(true) if j < 0.7]
    assert len(far) > 50 and sum(passed[k] for k in far) < 0.1 * len(far)
    # Bits one by one, and sets without values.
    values = np.unique(random.integers(-(2**63), 2**63 - 1, 300))
    found = parities(values, np.array([0, 0, 300]), minhash.BITS).view(np.uint64)
    assert found.shape == (3, words) and not found[0].any() and not found[2].any()
    bits = [(int(w) >> k) & 1 for w in found[1] for k in range(64)]
    for at in range(minhash.BITS):
        assert bits[at] == sum((int(v) % 2**64 >> 16) % minhash.BITS == at for v in values) % 2


def test_thresholds_follow_from_the_binomial_distribution(docs_frame):
    import math

    import pytest

    for k, percent in ((24, 80), (48, 80), (24, 60), (48, 95)):
        least, p = minhash.least_shared(k, percent), percent / 100
        chance = sum(math.comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(least))
        assert chance <= minhash.RARE < chance + math.comb(k, least) * p**least * (1 - p) ** (k - least)
    with pytest.raises(ValueError, match="too few"):
        minhash.near_groups(docs_frame([(1, "a")]), percent=40)


def test_sketches_go_once_the_classes_are_stored(docs_frame, monkeypatch):
    """Sketches of all rows stayed on disk beside those of the classes until the end."""
    from yardbook.llm.common import Scratch

    held, store, drop = {}, Scratch.store, Scratch.drop
    monkeypatch.setattr(Scratch, "store", lambda self, df, name: held.update({name: df.columns}) or store(self, df, name))
    monkeypatch.setattr(Scratch, "drop", lambda self, name="": held.pop(name) and drop(self, name))
    got = minhash.near_groups(docs_frame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y")]), words_per_shingle=2).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(1, True), (2, False), (3, True)]
    assert held and not [name for name, columns in held.items() if "sketch" in columns]
