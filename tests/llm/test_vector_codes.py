import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from yardbook.llm import queries, vector_codes
from yardbook.llm.vector_codes import Balls, _anchors, _squares

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("salt", T.StringType()),
    ]
)


def plain(rows, parts, entries, rounds=2):
    """The rule word for word on (id, vector) rows."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort()
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        away = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in book]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        for p, book in enumerate(books):
            owned = [nearest(c[p], book)[0] for c in cut]
            books[p] = [
                [sum(col) // len(col) for col in zip(*(c[p] for c, o in zip(cut, owned) if o == e))] if e in owned else old
                for e, old in enumerate(book)
            ]
    out = []
    for (i, _), c in zip(kept, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("kind", ["spread", "copies", "line", "large"])
def test_balls_agree_with_every_pair(kind):
    random = np.random.default_rng(3)
    points = {
        "spread": random.integers(-300, 300, (1500, 3)),
        "copies": np.repeat(random.integers(-5, 5, (4, 3)), 300, axis=0),
        "line": np.stack([np.arange(700), np.zeros(700, int), np.zeros(700, int)], axis=1) // 2,
        "large": random.integers(-(1 << 27), 1 << 27, (500, 3)),
    }[kind].astype(np.int64)
    book = np.concatenate([points[random.integers(0, len(points), 30)], points[:2], points[:2] + 1])
    tree = Balls.load(Balls.build(points).dump())
    owner, sums, counts = tree.assign(book)
    expected = _squares(points, book).argmin(axis=1)
    assert (np.sort(tree.order) == np.arange(len(points))).all()
    assert (owner == expected[tree.order]).all()
    for entry in range(len(book)):
        assert counts[entry] == (expected == entry).sum()
        assert (sums[entry] == points[expected == entry].sum(axis=0)).all()


def test_balls_cache_what_they_hold():
    points = np.random.default_rng(4).integers(-50, 50, (400, 2)).astype(np.int64)
    tree = Balls.build(points)
    assert len(tree.first) > 10
    for node in range(len(tree.first)):
        own = tree.points[tree.first[node] : tree.after[node]]
        assert (tree.sums[node] == own.sum(axis=0)).all()
        assert (np.sqrt(((own - tree.centre[node]) ** 2).sum(axis=1)) <= tree.radius[node] + 1e-9).all()
    owned = _anchors(points.astype(float))
    assert sorted(np.concatenate(owned)) == list(range(400)) and len(owned) == 20


def test_whole_balls_are_owned_without_their_points():
    near = np.random.default_rng(5).integers(0, 9, (200, 2)).astype(np.int64)
    points = np.concatenate([near, near + 10_000])
    tree = Balls.build(points)
    tree.points = np.full_like(tree.points, 1 << 20)  # looked at only if a ball is not owned
    owner, sums, counts = tree.assign(np.array([[4, 4], [10_004, 10_004]]))
    assert list(counts) == [200, 200] and (sums == [near.sum(axis=0), (near + 10_000).sum(axis=0)]).all()
    assert (owner == (tree.order >= 200)).all()


def frame(spark, rows, partitions=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def test_query_agrees_with_the_rule(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    expected, sha = plain(rows, 16, 64)
    found = queries.QUERIES["op12_vector_codes"](spark, sf_dir).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in found) == expected
    assert {r.codebooks_sha256 for r in found} == {sha}
    assert found[0].asDict().keys() == {"vec_id", "code", "error", "label_error", "codebooks_sha256"}


def test_edges(spark):
    nan = float("nan")
    rows = [(i, [float(i % 3), 0.1 * i, -1.0, 0.5], i % 2 or None, "x", "y") for i in range(40)]
    rows += [(7, [9.0, 9.0, 9.0, 9.0], 1, None, None), (7, [9.0, 9.0, 9.0, 9.0], 1, None, None)]
    bad = [(90, None, 1, None, None), (91, [nan, 0.0, 0.0, 0.0], 1, None, None), (92, [float("inf")] * 4, 1, None, None)]
    bad += [(93, [None, 0.0, 0.0, 0.0], None, None, None), (94, [], 1, None, None), (95, [1.0], 1, None, None)]
    coded, books = vector_codes.vector_codes(frame(spark, rows + bad), parts=2, entries=8)
    found = vector_codes.with_label_error(coded).collect()
    expected, sha = plain([r[:2] for r in rows], 2, 8)
    assert sorted((r.vec_id, r.code, r.error) for r in found) == sorted(expected)
    assert vector_codes.digest(books) == sha
    sums = {}
    for r in found:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in found) and None in sums


def test_null_identifiers_come_last_and_few_rows_give_short_books(spark):
    rows = [(None, [1.0, 1.0], 1, None, None), (5, [2.0, 2.0], 1, None, None)]
    coded, books = vector_codes.vector_codes(frame(spark, rows), parts=2, entries=64)
    assert [b.tolist() for b in books] == [[[512], [256]]] * 2
    assert sorted((r.vec_id or 0, r.code, r.error) for r in coded.collect()) == [(0, "0101", 0), (5, "0000", 0)]


def test_empty_and_refused(spark):
    coded, books = vector_codes.vector_codes(frame(spark, []), parts=2)
    assert vector_codes.with_label_error(coded).collect() == [] and [b.shape for b in books] == [(0, 1), (0, 1)]
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.vector_codes(frame(spark, [(1, [1.0] * 3, 1, None, None)]), parts=2)
    with pytest.raises(Exception, match="beyond"):
        vector_codes.vector_codes(frame(spark, [(1, [1e9] * 2, 1, None, None)]), parts=2)
