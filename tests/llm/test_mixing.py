import re
from collections import defaultdict

import numpy as np

from yardbook.llm import mixing, queries


def brute_targets(sizes, weights=(3, 1, 2), total=1.5, cap=2.0):
    """Share, cap and reshare by hand."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    wanted, capped = total * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in capped]
        rest = wanted - sum(capped.values())
        level = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = [s for s in open_ if level[s] > cap * sizes[s]]
        if not above:
            return capped | level
        capped |= {s: cap * sizes[s] for s in above}


def check(rows, got, tolerance):
    want = defaultdict(int)
    for _, text, source in rows:
        want[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    targets = brute_targets(want)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == want[r.source] and abs(r.target - targets[r.source]) <= 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    for s in want:
        assert abs(taken[s] - targets[s]) <= tolerance, s


def test_moves_keep_both_totals():
    rng = np.random.default_rng(2)
    sizes, chances = rng.integers(0, 5000, 3000).astype(float), rng.random(3000)
    flown = mixing.fly(sizes, chances)
    assert ((flown > 0) & (flown < 1)).sum() <= 2
    assert abs(flown @ sizes - chances @ sizes) < 1e-3 and abs(flown.sum() - chances.sum()) < 1e-5
    assert sum(0 < p < 1 for p in mixing.fly(np.ones(4), np.full(4, 0.5))) <= 2


def test_targets_totals_and_reruns(docs_frame):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 90)), "ab"[i % 7 == 0] if i % 11 else None) for i in range(3000)]
    rows += [(5000, None, "c"), (5001, "", "c"), (5002, "one two", "d")] + [(7, "same row", "a")] * 300
    frame = docs_frame(rows)
    got = mixing.mix(frame, block=64).collect()
    assert len(got) == len(rows)
    check(rows, got, 60)
    again = mixing.mix(docs_frame(rows, 5), block=64).collect()
    assert sorted([(r.doc_id, r.size, r.taken) for r in again]) == sorted([(r.doc_id, r.size, r.taken) for r in got])


def test_documents_total_is_balanced(docs_frame):
    rows = [(i, "w " * (1 + i * 37 % 200), "a") for i in range(2000)] + [(9000 + i, "w " * 50, "b") for i in range(2000)]
    got = mixing.mix(docs_frame(rows), block=128).collect()
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.copies for r in mine) - len(mine) * mine[0].target / mine[0].source_size) < 5


def test_clashing_names_and_empty_tables(docs_frame):
    from pyspark.sql import functions as F

    frame = docs_frame([(1, "a b", "s"), (2, "c", "s")]).withColumns({"size": F.lit("x"), "key": F.lit(3), "_key": F.lit(4), "place": F.lit(1)})
    got = mixing.mix(frame)
    assert sorted((r.doc_id, r.size, r["key"], r["_key"]) for r in got.collect()) == [(1, 2, 3, 4), (2, 1, 3, 4)]
    assert mixing.mix(docs_frame([])).count() == 0
    assert [r.taken for r in mixing.mix(docs_frame([(1, None, None)])).collect()] == [0]


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    source = {r[0]: r[2] for r in rows}
    got = queries.mix_sources(spark, sf_dir).collect()
    assert len(got) == len(rows)
    sums = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        entry = sums[source[r.doc_id]]
        entry[0], entry[1], entry[2] = entry[0] + r.taken, r.target, max(entry[2], r.size)
        assert r.taken <= 2 * r.size
    assert all(abs(t - target) <= most for t, target, most in sums.values())


def best_possible(sizes, target):
    """Nearest sum of words that whole copies, at most two of each document, can give."""
    sums = 1
    for size in sizes:
        sums |= sums << size | sums << 2 * size
    top = sum(sizes) * 2
    return min(abs(k - target) for k in range(max(0, int(target) - top), min(top, int(target) + top) + 1) if sums >> k & 1)


def test_every_source_of_the_query_comes_near_its_target(spark, sf_dir):
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sums, sizes = defaultdict(lambda: [0, 0.0]), defaultdict(list)
    for r in queries.mix_sources(spark, sf_dir).collect():
        entry = sums[source[r.doc_id]]
        entry[0], entry[1] = entry[0] + r.taken, r.target
        sizes[source[r.doc_id]].append(r.size)
    for s, (taken, target) in sums.items():
        assert abs(taken - target) <= max(0.01 * target, best_possible(sizes[s], target) + 1), (s, taken, target)


def test_a_heavy_document_is_levelled_by_light_ones(docs_frame):
    rows = [(0, "w " * 4000, "a")] + [(1 + i, "w " * (20 + i % 50), "a") for i in range(160)] + [(900, "w " * 90_000, "b"), (901, "w", "b")]
    got = mixing.mix(docs_frame(rows), total=0.7, cap=0.9).collect()
    mine = [r for r in got if r.source == "a"]
    assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.01 * mine[0].target


def test_heaviest_first_and_landing_keep_the_words():
    rng = np.random.default_rng(5)
    sizes, chances = np.concatenate([[9000.0, 4000.0], rng.integers(1, 300, 400).astype(float)]), np.full(402, 0.4)
    decided = mixing.decide_heaviest(sizes, chances)
    assert set(decided[:2]) <= {0.0, 1.0} and abs(decided @ sizes - chances @ sizes) < 1e-6
    assert (decided >= 0).all() and (decided <= 1).all()
    kept = mixing.last_ones(sizes, decided)
    assert len(set(kept)) == mixing.LAST and ((decided[kept] > 0) & (decided[kept] < 1)).all()
    few = np.array([5.0, 3.0, 9.0, 2.0])
    best = min(abs(sum(few[list(pick)]) - 11.2) for pick in ((0, 1), (2, 3), (0, 1, 3), (2,), (0, 1, 2)))
    assert abs(mixing.land(few, np.full(4, 0.5), 11.2, 0.0) @ few - 11.2) == best
    assert list(mixing.land(np.zeros(3), np.full(3, 0.5), 0.0)).count(1.0) in (1, 2)
