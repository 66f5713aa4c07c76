"""What the pipeline's stages hold and plan in the driver."""

import tracemalloc

import numpy as np
import pyarrow as pa

from yardbook.llm import components as linking
from yardbook.llm import minhash, quality


def test_fit_widens_a_block_at_a_time():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, quality.DIMENSIONS, 500)).astype(np.int32) for _ in range(4000)]
    values = [rng.random(len(r)).astype(np.float32) for r in rows]
    entries = sum(map(len, rows))
    tracemalloc.start()
    quality.fit(rows, values, np.arange(len(rows)) % 3, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * entries + 8e6


def test_joined_classes_take_no_rounds_again(spark, monkeypatch):
    words = [f"w{n}" for n in range(200)]
    # Each text shares most words with the next one only, so the first links form a chain.
    texts = [(n, " ".join(words[6 * n : 6 * n + 60])) for n in range(20)]
    docs = spark.createDataFrame([*texts, (99, "another text of a few words only"), (None, ""), (3, texts[3][1])], "doc_id long, text string")
    rounds, calls, step = [], minhash.components, linking._larger_to_smallest

    def counted(links):
        rounds.append(0)
        return calls(links)

    def one_more(edges):
        rounds[-1] += 1
        return step(edges)

    monkeypatch.setattr(minhash, "components", counted)
    monkeypatch.setattr(linking, "_larger_to_smallest", one_more)
    found = minhash.near_groups(docs, 2, 80).select("doc_id", "component_id", "stays").collect()
    assert sorted({r.component_id for r in found if r.doc_id not in (None, 99)}) == [0]
    assert sum(r.stays for r in found) == 3
    assert len(rounds) == 3 and rounds[0] > 2 and rounds[1] == 1  # no new links


def test_stars_take_no_round_to_be_recognised(spark, monkeypatch):
    rounds, step = [], linking._larger_to_smallest
    monkeypatch.setattr(linking, "_larger_to_smallest", lambda edges: rounds.append(edges) or step(edges))
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (9, 9), (None, 2), (8, 7)], "a long, b long")
    found = {(r.node, r.component) for r in linking.components(links).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)}
    assert len(rounds) == 1


def test_a_round_of_linking_shuffles_little(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (3, 1)], "a long, b long").localCheckpoint()
    plan = linking._smaller_to_smallest(linking._larger_to_smallest(edges))._jdf.queryExecution().sparkPlan().toString()
    # Both ends of a link come out of one scan, not of a union of two.
    assert "Union" not in plan
    assert linking.components(edges.limit(0)).count() == 0


def test_large_groups_give_short_chains():
    n = 300
    sketch = np.tile(np.arange(minhash.KEEP, dtype=np.int64), (n, 1))
    sketch[:, -1] = 1000 + np.arange(n)
    batches = [
        pa.RecordBatch.from_arrays([pa.array(range(k, k + 100)), pa.array(list(sketch[k : k + 100]), pa.list_(pa.int64()))], names=["cls", "part"])
        for k in (0, 100, 200)
    ]
    around: dict[int, set[int]] = {k: set() for k in range(n)}
    for batch in minhash._close_neighbours(iter(batches), 9):
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            assert a < b
            around[a].add(b)
            around[b].add(a)
    steps, seen, edge = 0, {0}, {0}
    while edge:
        edge = {y for x in edge for y in around[x]} - seen
        seen |= edge
        steps += bool(edge)
    assert len(seen) == n and steps <= 40  # 150 with links to the two before only
    assert sum(map(len, around.values())) <= 4 * n
