"""Compression of vectors to codes, one byte a part, by exact k-means over anchors-hierarchy ball trees.

A vector is cut into equal parts, every part position has a codebook. Assignment and replacement of the
entries run on metric trees: the vectors of a Spark partition are taken in blocks of at most ``BLOCK``
rows, and each part position of a block gets one tree, built once and stored, read again in each round.

*Middle-out.* About sqrt(n) anchors are placed, each new one at the point farthest from the anchor of the
largest radius, and every point belongs to its nearest anchor. Anchors with many points are built alike
below; upwards the two balls with the smallest common ball are joined until one is left. Each ball
caches its centre, radius, count and componentwise sum.

*Shrinking lists.* A ball inherits the candidate entries of the ball above it and drops those that are
farther from all its points than some other one, by the triangle inequality: ``d(c, far) - radius >
d(c, near) + radius``, strictly, so that ties are left to the exact comparison. A ball with one candidate
is wholly owned: its cached sum and count go to the entry and its points are not looked at. In a leaf the
remaining candidates are compared with each point in whole numbers, ties to the lower index.

Only sums and counts of entries (``parts * entries`` rows) and the codebooks reach the driver; both are of fixed
size. Codes and errors are written by the tasks that hold the vectors.

Defined results: vectors that are null, empty or hold null or non-finite components are dropped; so are
those whose length is not that of the row with the smallest identifier, and if that length is no
multiple of ``parts`` nothing can be cut, which is an error. Repeated rows are ordinary rows, rows that
repeat an identifier follow by their components, null identifiers come last. With fewer rows than
entries the codebooks are shorter. Components beyond +-2**27 after scaling are an error: their squares would
leave 64-bit integers. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, cut

BLOCK, LEAF = 2048, 48
_LIMIT = 1 << 27
_SALTS = 32


class Balls:
    """The tree of one part of a block: points in leaf order, and balls over ranges of them."""

    def __init__(self, order, points, first, after, children, centre, radius, sums):
        self.order, self.points, self.first, self.after = order, points, first, after
        self.children, self.centre, self.radius, self.sums = children, centre, radius, sums

    @classmethod
    def build(cls, points: np.ndarray) -> Balls:
        """The tree over ``points`` (n, d), whole numbers."""
        floats = points.astype(float)
        balls: list[tuple[np.ndarray, int, int, np.ndarray, float]] = []

        def ball(rows: np.ndarray, left: int, right: int) -> int:
            centre = floats[rows].mean(axis=0)
            radius = float(np.sqrt(((floats[rows] - centre) ** 2).sum(axis=1).max()))
            balls.append((rows, left, right, centre, radius))
            return len(balls) - 1

        def grow(rows: np.ndarray) -> int:
            owned = _anchors(floats[rows]) if len(rows) > LEAF else [np.arange(len(rows))]
            if len(owned) == 1:
                return ball(rows, -1, -1)
            tops = [grow(rows[own]) for own in owned]
            centres, radii = np.array([balls[t][3] for t in tops]), np.array([balls[t][4] for t in tops])
            size = np.sqrt(((centres[:, None] - centres) ** 2).sum(axis=2)) + radii[:, None] + radii
            np.fill_diagonal(size, np.inf)
            for _ in range(len(tops) - 1):
                a, b = divmod(int(size.argmin()), len(tops))
                tops[a] = ball(np.concatenate([balls[tops[a]][0], balls[tops[b]][0]]), tops[a], tops[b])
                centres[a], radii[a] = balls[tops[a]][3], balls[tops[a]][4]
                size[b] = size[:, b] = np.inf
                open_ = np.isfinite(size[a])
                size[a, open_] = size[open_, a] = (np.sqrt(((centres[open_] - centres[a]) ** 2).sum(axis=1)) + radii[open_] + radii[a])
            return tops[a]

        root = grow(np.arange(len(points)))
        # A ball's rows are those of its left ball and then of its right one, so ranges follow from the top.
        first = np.zeros(len(balls), np.int32)
        for at in range(root, -1, -1):
            _, left, right, _, _ = balls[at]
            if left >= 0:
                first[left], first[right] = first[at], first[at] + len(balls[left][0])
        order = balls[root][0].astype(np.int32)
        running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order], axis=0, dtype=np.int64)])
        after = first + np.array([len(b[0]) for b in balls], np.int32)
        children = np.array([b[1:3] for b in balls], np.int32)
        centre, radius = np.array([b[3] for b in balls]), np.array([b[4] for b in balls])
        return cls(order, points[order], first, after, children, centre, radius, running[after] - running[first])

    def dump(self) -> bytes:
        head = np.array([*self.points.shape, len(self.first)], np.int64)
        columns = (self.order, self.points.astype(np.int32), self.first, self.after, self.children, self.centre, self.radius, self.sums)
        return b"".join(np.ascontiguousarray(x).tobytes() for x in (head, *columns))

    @classmethod
    def load(cls, data: bytes) -> Balls:
        n, d, m = (int(x) for x in np.frombuffer(data, np.int64, 3))
        at, out = 24, []
        for shape, kind in (((n,), "i4"), ((n, d), "i4"), ((m,), "i4"), ((m,), "i4"), ((m, 2), "i4"), ((m, d), "f8"), ((m,), "f8"), ((m, d), "i8")):
            size = int(np.prod(shape))
            out.append(np.frombuffer(data, kind, size, at).reshape(shape))
            at += size * int(kind[1])
        return cls(*out)

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry of each point in leaf order, sums of each entry's points, their counts)."""
        entries = book.astype(float)
        owner = np.zeros(len(self.points), np.int64)
        sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
        # The root is the last ball that was made.
        nodes, lists = np.array([len(self.first) - 1]), np.ones((1, len(book)), bool)
        while len(nodes):
            away = np.sqrt(((self.centre[nodes][:, None] - entries) ** 2).sum(axis=2))
            reach = self.radius[nodes]
            least = np.where(lists, away, np.inf).min(axis=1) + reach
            # The slack covers rounding; it can only keep a candidate.
            lists = lists & (away - reach[:, None] <= (least * (1 + 1e-9) + 1e-6)[:, None])
            single = lists.sum(axis=1) == 1
            only = lists.argmax(axis=1)
            for node, entry in zip(nodes[single], only[single]):
                owner[self.first[node] : self.after[node]] = entry
            np.add.at(sums, only[single], self.sums[nodes[single]])
            np.add.at(counts, only[single], (self.after - self.first)[nodes[single]])
            leaf = ~single & (self.children[nodes, 0] < 0)
            for node, left in zip(nodes[leaf], lists[leaf]):
                candidates = np.flatnonzero(left)
                for low in range(self.first[node], self.after[node], 4 * BLOCK):
                    high = min(low + 4 * BLOCK, self.after[node])
                    points = self.points[low:high].astype(np.int64)
                    found = candidates[_squares(points, book[candidates]).argmin(axis=1)]
                    owner[low:high] = found
                    np.add.at(sums, found, points)
                    np.add.at(counts, found, 1)
            split = ~single & ~leaf
            nodes, lists = self.children[nodes[split]].ravel(), np.repeat(lists[split], 2, axis=0)
        return owner, sums, counts


def _squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(points, entries): squared distances in whole numbers."""
    out = np.zeros((len(points), len(book)), np.int64)
    for k in range(points.shape[1]):
        out += (points[:, k, None] - book[None, :, k]) ** 2
    return out


def _anchors(points: np.ndarray) -> list[np.ndarray]:
    """The points of each of about sqrt(n) anchors; fewer if points coincide."""
    wanted = int(np.ceil(np.sqrt(len(points))))
    owner, away = np.zeros(len(points), np.int64), ((points - points[0]) ** 2).sum(axis=1)
    radii = np.array([away.max()])
    while len(radii) < wanted and radii.max() > 0:
        widest = int(radii.argmax())
        mine = np.flatnonzero(owner == widest)
        new = ((points - points[mine[away[mine].argmax()]]) ** 2).sum(axis=1)
        closer = new < away
        owner[closer], away[closer] = len(radii), new[closer]
        radii = np.zeros(len(radii) + 1)
        np.maximum.at(radii, owner, away)
    groups = (np.flatnonzero(owner == k) for k in range(len(radii)))
    return [g for g in groups if len(g)]


def _whole(column: pa.Array, length: int, scale: int) -> np.ndarray:
    """(rows, length) whole numbers floor(scale * x)."""
    scaled = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length) * float(scale))
    if scaled.size and np.abs(scaled).max() > _LIMIT:
        raise OverflowError(f"a component is beyond +-{_LIMIT} after scaling")
    return scaled.astype(np.int64)


def _trees(vectors: DataFrame, length: int, parts: int, scale: int) -> DataFrame:
    """(ids, labels, trees) of each block of ``vectors`` (id, label, vector)."""
    width = length // parts

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole = _whole(batch.column(2), length, scale)
        trees = [Balls.build(whole[:, p * width : (p + 1) * width]).dump() for p in range(parts)]
        ends = pa.array([0, batch.num_rows], pa.int32())
        columns = [pa.ListArray.from_arrays(ends, batch.column(k)) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([trees], pa.list_(pa.binary()))], names=["ids", "labels", "trees"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK - rows)
                held.append(part)
                rows += part.num_rows
                batch = batch.slice(part.num_rows)
                if rows == BLOCK:
                    yield block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, rows = [], 0
        if rows:
            yield block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    kinds = {f.name: f.dataType for f in vectors.schema}
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(kinds["id"])),
            T.StructField("labels", T.ArrayType(kinds["label"])),
            T.StructField("trees", T.ArrayType(T.BinaryType())),
        ]
    )
    return vectors.mapInArrow(scan, schema)


def _replaced(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry the floored mean of its points."""
    shared = trees.sparkSession.sparkContext.broadcast(books)  # fixed size: one number a part, entry and component

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, np.int64) for b in shared.value]
        counts = [np.zeros(len(b), np.int64) for b in shared.value]
        for batch in batches:
            for row in batch.column(0):
                for p, tree in enumerate(row):
                    _, own, n = Balls.load(tree.as_buffer()).assign(shared.value[p])
                    sums[p] += own
                    counts[p] += n
        for p, (own, n) in enumerate(zip(sums, counts)):
            used, at = np.nonzero(np.repeat(n[:, None] > 0, own.shape[1], axis=1))
            columns = np.full(len(used), p), used, at, n[used], own[used, at]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "at", "n", "total"])

    found = trees.select("trees").mapInArrow(total, "part long, entry long, at long, n long, total long")
    exact = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "total")]
    out = [b.copy() for b in books]
    for r in found.groupBy("part", "entry", "at").agg(*exact).collect():  # parts * entries * components of a part
        out[r["part"]][r["entry"], r["at"]] = int(r["total"]) // int(r["n"])
    return out


def _coded(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, label, code, error) of every vector."""
    shared = trees.sparkSession.sparkContext.broadcast(books)
    digits = np.array([f"{k:02x}" for k in range(256)], "S2")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, row in zip(batch.column(0), batch.column(1), batch.column(2)):
                n = len(ids.values)
                codes, errors = np.zeros((n, len(row)), np.int64), np.zeros(n, np.int64)
                for p, tree in enumerate(row):
                    balls, book = Balls.load(tree.as_buffer()), shared.value[p]
                    owner, _, _ = balls.assign(book)
                    codes[balls.order, p] = owner
                    errors[balls.order] += ((balls.points - book[owner]) ** 2).sum(axis=1)
                text = np.ascontiguousarray(digits[codes]).view(f"S{2 * len(row)}").ravel().astype(str)
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels.values, pa.array(text.tolist(), pa.string()), pa.array(errors)], names=["id", "label", "code", "error"]
                )

    kinds = {f.name: f.dataType.elementType for f in trees.schema}
    fields = [T.StructField("id", kinds["ids"]), T.StructField("label", kinds["labels"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    return trees.mapInArrow(code, T.StructType(fields))


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def vector_codes(
    df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
    vector: str = "embedding", vec_id: str = "vec_id", label: str = "label",
) -> tuple[DataFrame, list[np.ndarray]]:
    """(one row per kept vector: ``vec_id``, ``label``, ``code``, ``error``; the codebook of each part)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = df.sparkSession
    plain = df.select(df[vec_id].alias("id"), df[label].alias("label"), df[vector].cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = plain.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    order = F.col("id").asc_nulls_last(), F.col("vector")
    top = kept.orderBy(*order).limit(1).select(F.size("vector").alias("n")).first()
    length = top["n"] if top else parts
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    kept = kept.where(F.size("vector") == length)
    # At most `entries` vectors.
    seeds = [r["vector"] for r in kept.orderBy(*order).limit(entries).select("vector").collect()]
    whole = _whole(pa.array(seeds, pa.list_(pa.float64())), length, scale)
    books = [np.ascontiguousarray(b) for b in np.split(whole, parts, axis=1)]
    trees = Scratch(spark, "vector-codes").store(_trees(kept, length, parts, scale), "trees")
    for _ in range(rounds if seeds else 0):
        books = _replaced(trees, books)
    coded = _coded(trees, books)
    return coded.select(F.col("id").alias("vec_id"), "label", "code", "error"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: the error summed over equal labels, nulls together.

    Sums are taken before the join, and each label's total stands once for each of a few salts, so that a
    label that a third of the rows share is spread over them.
    """
    stored = cut(coded)
    totals = stored.groupBy("label").agg(F.sum("error").alias("label_error"))
    totals = totals.select(F.col("label").alias("l"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("s"))
    salted = stored.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(_SALTS)).cast("int"))
    met = F.col("label").eqNullSafe(F.col("l")) & (F.col("salt") == F.col("s"))
    return salted.join(totals, met).drop("salt", "s", "l")
