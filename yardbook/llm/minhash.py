"""Near-duplicates by bottom-k sketches from one hash function.

Every text becomes the set of its word shingles as 64-bit hashes; its sketch is the ``k`` smallest.
Texts with equal sets are one class, and only classes are compared.

*Neighbours.* Sketches are sorted, as they are and from their second and third value on, and each is
compared with the two before it and the first of its block. Close neighbours are confirmed and joined to first
components, so that a large group of near copies costs a few rows per member in what follows. Nothing
relies on it.

*Lists.* Each retained value is an inverted list of the classes that retain it, kept apart by set
size (linked sets differ by at most the threshold's ratio). First one class of each component in a list
is paired with those of the others, and components are joined; then all classes of components that are
still different.

Linked sets share at least some (see below) of their ``KEEP`` smallest union values, so it is enough that
each class stands in its shortest lists, all but that number less one of those it shares with anyone (prefix filtering, shortest list
first). Lists of more than ``wide`` components - common phrases and lines - are left out, and counted
as shared wherever a class has one; classes that stand mostly in such lists are paired through them as
well, among themselves.

*Estimates.* Each list entry carries a parity signature cut from the same hash function: some bits of a value choose
one of ``BITS`` bits, which it turns. Two sets differ in no fewer values than their signatures in bits, and the
join that pairs a list asks that this leaves room for the threshold: pairs far below it are never written, and
none that reaches it is lost. Pairs that pass have to share enough of the 48 smallest values of the union of their
sketches (or the smallest possible intersection, where that is smaller).

How many values have to be shared follows from the threshold and the binomial distribution (9 of 24 and 24 of
48 at 0.8): a pair at the threshold fails the lists or the estimate with a probability of about 1e-6 each; nothing
else is missed. Thresholds too low for lists of this length are refused.

*Exact.* Pairs that pass are confirmed on the full sets: ``100 * |A n B| >= percent * |A u B|``.

Defined results: null and empty texts have an empty set and are linked with nothing; a text with
fewer words than a shingle is one shingle; equal sets are linked; null identifiers take no part in
minima; repeated rows are linked; an empty table gives an empty result; texts are used whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, cut, differ_little, free_name, parities, shingles, small, text_of, text_slices, words
from .components import components

KEEP = 24
SKETCH = 48
BITS = 1024
RARE = 1e-6
TURNS = 3
WIDE = 24
BLOCK = 32
_SLICE = 1 << 18
_BROADCAST_ROWS = 2_000_000


def least_shared(k: int, percent: int) -> int:
    """How many of the ``k`` smallest union values a pair at the threshold shares, but for a chance of ``RARE``."""
    p, below = percent / 100, 0.0
    for shared in range(k + 1):
        below += math.comb(k, shared) * p**shared * (1 - p) ** (k - shared)
        if below > RARE:
            return shared
    return k


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    for _, _, data, ends in text_slices(column, _SLICE):
        hashes, _, _, upto = words(data, ends)
        begin = 0
        for end in upto:
            yield np.unique(shingles(hashes[begin:end], n).view(np.int64))
            begin = end


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)))


def _opens(parts: list[np.ndarray]) -> np.ndarray:
    """Where each part begins when they lie one after another."""
    return np.concatenate([[0], np.cumsum([len(p) for p in parts])])[: len(parts)].astype(np.int64)


def _fingerprint(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sketches(df: DataFrame, n: int, keep: int, text: str, doc_id: str) -> DataFrame:
    """(id, at, size, print, sketch, sign) of each row; ``print`` names the full set."""

    def sketch(batches):
        for batch in batches:
            sets = list(_sets(batch.column(2), n))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_fingerprint(s) for s in sets], pa.binary()),
                    _list_array([s[:keep] for s in sets]),
                    _list_array(list(parities(np.concatenate([*sets, np.zeros(0, np.int64)]), _opens(sets), BITS))),
                ],
                names=["id", "at", "size", "print", "sketch", "sign"],
            )

    rows = df.select(df[doc_id].alias("id"), F.monotonically_increasing_id().alias("at"), text_of(df, text).alias("text"))
    schema = T.StructType(
        [
            T.StructField("id", df.schema[doc_id].dataType),
            T.StructField("at", T.LongType()),
            T.StructField("size", T.LongType()),
            T.StructField("print", T.BinaryType()),
            T.StructField("sketch", T.ArrayType(T.LongType())),
            T.StructField("sign", T.ArrayType(T.LongType())),
        ]
    )
    return rows.mapInArrow(sketch, schema)


def _full_sets(df: DataFrame, wanted: DataFrame, n: int, text: str, doc_id: str) -> DataFrame:
    """(print, members) of the texts whose identifier is in ``wanted`` (id)."""

    def build(batches):
        for batch in batches:
            sets = list(_sets(batch.column(0), n))
            yield pa.RecordBatch.from_arrays(
                [pa.array([_fingerprint(s) for s in sets], pa.binary()), _list_array(sets)], names=["print", "members"]
            )

    ids = small(wanted, _BROADCAST_ROWS)
    texts = df.select(df[doc_id].alias("id"), text_of(df, text).alias("text"))
    texts = texts.join(ids.withColumnRenamed("id", "w"), F.col("id").eqNullSafe(F.col("w")), "left_semi")
    return texts.select("text").mapInArrow(build, "print binary, members array<long>")


def _entries(classes: DataFrame, percent: int, keep: int) -> DataFrame:
    """(value, tier, cls, bucket, rank): a class stands in its own tier of set sizes and in the one below."""
    bucket = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    return (
        classes.select("*", bucket.alias("bucket"), F.posexplode(F.slice("sketch", 1, keep)).alias("rank", "value"))
        .drop("sketch")
        .withColumn("tier", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)))
    )


def _close_neighbours(batches: Iterator[pa.RecordBatch], enough: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of sorted sketches that share enough values with the one before them, and with the first of their block or the second one before, whichever is closer.

    The first of a block shortens the chains that a large group gives, and so the rounds in which they are joined.
    """
    ids, table = np.zeros(0, np.int64), np.zeros((0, KEEP), np.int64)
    lengths = np.zeros(0, np.int64)
    for batch in batches:
        sketch = batch.column(1)
        own = np.diff(sketch.offsets.to_numpy())
        rows = np.zeros((len(own), KEEP), np.int64)
        rows[np.arange(KEEP) < own[:, None]] = sketch.flatten().to_numpy()
        ids = np.concatenate([ids[-2:], batch.column(0).to_numpy()])
        table, lengths = np.concatenate([table[-2:], rows]), np.concatenate([lengths[-2:], own])
        valid = np.arange(KEEP) < lengths[:, None]
        at = np.arange(len(ids))

        def shared(other: np.ndarray) -> np.ndarray:
            """How many values each sketch shares with that at ``other``, -1 if they are too few or that place is not an earlier one."""
            same = (table[:, :, None] == table[other, None, :]) & valid[:, :, None] & valid[other, None, :]
            values = same.any(axis=2).sum(axis=1)
            return np.where((other < at) & (values >= np.minimum(enough, np.minimum(lengths, lengths[other]))), values, -1)

        one, two, first = np.maximum(at - 1, 0), np.maximum(at - 2, 0), at // BLOCK * BLOCK
        of_first, of_two = shared(first), shared(two)
        second = np.where(of_first >= of_two, first, two)
        found = [(one, shared(one) >= 0), (second, np.maximum(of_first, of_two) >= 0)]
        a, b = (np.concatenate(part) for part in ([ids[other][kept] for other, kept in found], [ids[kept] for _, kept in found]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _neighbours(classes: DataFrame, enough: int) -> DataFrame:
    turn = F.explode(F.sequence(F.lit(1), F.least("kept_values", F.lit(TURNS))))
    turned = classes.select("cls", "sketch", turn.alias("turn")).select("cls", F.slice("sketch", F.col("turn"), KEEP).alias("part"))
    ordered = turned.repartitionByRange("part", "cls").sortWithinPartitions("part", "cls")
    close = ordered.mapInArrow(partial(_close_neighbours, enough=enough), "a long, b long")
    return close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of pairs that share enough of the smallest values of the union of their sketches."""
    sketch = classes.select("cls", "size", "sketch")
    both = pairs.join(sketch.select(F.col("cls").alias("a"), F.col("size").alias("m"), F.col("sketch").alias("x")), "a").join(
        sketch.select(F.col("cls").alias("b"), F.col("size").alias("n"), F.col("sketch").alias("y")), "b"
    )
    # The smallest values of both sketches are the smallest of the union.
    union = F.slice(F.sort_array(F.array_union("x", "y")), 1, SKETCH)
    common = F.size(F.array_intersect(union, F.array_intersect("x", "y")))
    return both.where(common >= F.least(F.lit(least_shared(SKETCH, percent)), _least_common(F.col("m"), F.col("n"), percent))).select("a", "b")


def _least_common(m: Column, n: Column, percent: int) -> Column:
    """The smallest intersection of linked sets of sizes m and n."""
    return F.ceil((m + n) * percent / (100 + percent)).cast("int")


def _confirmed(pairs: DataFrame, classes: DataFrame, df: DataFrame, n: int, percent: int, text: str, doc_id: str, scratch: Scratch, step: str) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    pairs = cut(pairs)
    nodes = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    needed = cut(classes.join(nodes, "cls").select("cls", "id", "print"))
    full = _full_sets(df, needed.select("id").distinct(), n, text, doc_id)
    full = full.dropDuplicates(["print"]).join(needed.select("cls", "print"), "print").select("cls", "members")
    full = scratch.store(full, f"sets-{step}")
    left = pairs.join(full.select(F.col("cls").alias("a"), F.col("members").alias("x")), "a")
    both = left.join(full.select(F.col("cls").alias("b"), F.col("members").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    union = F.size("x") + F.size("y") - common
    found = cut(both.where(common * 100 >= union * percent).select("a", "b").distinct())
    scratch.drop(f"sets-{step}")
    return found


def near_groups(
    df: DataFrame, words_per_shingle: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", wide: int = WIDE
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``stays``.

    ``component_id`` is the smallest identifier that can be reached over links. Exactly one row of each
    group has ``stays`` set, also where identifiers repeat or are null; a text without words stays.
    """
    spark, n = df.sparkSession, words_per_shingle
    enough = least_shared(KEEP, percent)
    if enough < 2:
        raise ValueError(f"{KEEP} retained values are too few for a threshold of {percent} percent")
    scratch = Scratch(spark, "minhash")
    rows = scratch.store(sketches(df, n, SKETCH, text, doc_id), "rows")
    filled = rows.where("size > 0")
    classes = filled.groupBy("print").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("sign").alias("sign"))
    classes = scratch.store(
        classes.withColumns({"cls": F.monotonically_increasing_id(), "kept_values": F.least(F.size("sketch"), F.lit(KEEP))}), "classes"
    )
    # The sketches are with the classes now.
    members = scratch.store(rows.drop("sketch", "sign"), "members")
    scratch.drop("rows")

    def confirm(pairs: DataFrame, step: str) -> DataFrame:
        return _confirmed(pairs, classes, df, n, percent, text, doc_id, scratch, step)

    links = confirm(_neighbours(classes, enough), "neighbours")

    # Pairs of different components in the shortest lists of each class.
    first = components(links).withColumnRenamed("node", "cls")
    placed = classes.join(first, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    entries = _entries(cut(placed.select("cls", "size", "kept_values", "sketch", "component")), percent, KEEP)
    widths = entries.groupBy("value", "tier", "component").agg(F.count("*").alias("n")).groupBy("value", "tier")
    widths = widths.agg(F.count("*").alias("width")).where("width > 1")
    own = Window.partitionBy("cls", "tier")
    # At least so many values a linked class shares with this one, of which `hidden` may be in wide lists.
    least = F.least(F.lit(enough), _least_common(F.col("size"), F.col("size") * percent / 100, percent))
    ranked = (
        entries.join(widths, ["value", "tier"])
        .withColumn("wide", F.col("width") > wide)
        .withColumn("place", F.row_number().over(own.orderBy("width", "value")))
        .withColumns({"lists": F.count("*").over(own), "hidden": F.sum(F.col("wide").cast("int")).over(own)})
        .withColumn("mostly", F.col("hidden") > least - 2)
    )
    visible = F.col("lists") - F.col("hidden") - F.greatest(least - F.col("hidden"), F.lit(1)) + 1
    narrow = ~F.col("wide") & (F.col("place") <= visible)
    broad = F.col("mostly") & (F.col("place") <= F.col("lists") - least + 1)
    rest = cut(ranked.where(narrow | broad).select("value", "tier", "cls", "component", "bucket", "wide"))

    signs = classes.select("cls", "size", *(F.get("sign", F.lit(k)).alias(f"s{k}") for k in range(BITS // 64)))

    def across(lists: DataFrame) -> DataFrame:
        lists = lists.join(signs, "cls")
        x, y = lists.alias("x"), lists.alias("y")
        met = (F.col("x.value") == F.col("y.value")) & (F.col("x.tier") == F.col("y.tier"))
        other = (F.col("x.cls") < F.col("y.cls")) & (F.col("x.component") != F.col("y.component"))
        lowest = F.least("x.bucket", "y.bucket") == F.col("x.tier")
        near = differ_little("x.s", "y.s", F.col("x.size"), F.col("y.size"), BITS // 64, percent)
        pairs = x.join(y, met & other & lowest & near).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
        return _possible(pairs.distinct(), classes, percent)

    def with_links(found: DataFrame, more: DataFrame) -> DataFrame:
        """Components of links that gave ``found`` and of ``more``: what is joined already enters as stars and takes no rounds."""
        return components(found.toDF("a", "b").unionByName(more))

    one_each = rest.groupBy("value", "tier", "component", "bucket").agg(F.min("cls").alias("cls"))
    second = with_links(first, confirm(across(one_each), "first"))
    joined = second.withColumnRenamed("node", "cls").withColumnRenamed("component", "joined")
    rest = rest.join(joined, "cls", "left").withColumn("component", F.coalesce("joined", "component"))
    final = cut(with_links(second, confirm(across(cut(rest.drop("joined"))), "rest"))).withColumnRenamed("node", "cls")
    named = classes.join(final, "cls", "left").select("cls", "print", "id", F.coalesce("component", "cls").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = cut(named.join(least, "component").select("print", "component", "component_id"))
    scratch.drop("classes")
    out = members.join(named, "print", "left")
    first_row = out.where("component is not null").groupBy("component").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "at")).alias("best")
    )
    out = out.join(first_row, "component", "left")
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("size").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("id") == F.col("component_id"), F.col("component").isNull() | (F.col("at") == F.col("best.at"))).alias("kept"),
        (F.col("component").isNull() | (F.col("at") == F.col("best.at"))).alias("stays"),
        "at",
    )


def keep_one(
    df: DataFrame, words_per_shingle: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", row_key: str | None = None
) -> DataFrame:
    """The rows of ``df`` with one document of each near-duplicate group; columns stay as they are, but for ``row_key``, which goes.

    ``row_key`` names a column that tells all rows apart and is the same in every pass. Without one rows are
    numbered and stored with their numbers: also a plain read of files is split anew in every pass, by the
    cores that are there at that moment.
    """
    key, numbered = row_key, df
    if key is None:
        key = free_name(df, "_row")
        numbered = Scratch(df.sparkSession, "minhash-keep").store(df.withColumn(key, F.monotonically_increasing_id()), "docs")
    texts = numbered.select(F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col(key).alias("at")).alias("id"), F.col(text).alias("text"))
    stay = near_groups(texts, words_per_shingle, percent, "text", "id").where("stays").select(F.col("doc_id.at").alias(key))
    return numbered.join(stay, key, "left_semi").select(*[c for c in df.columns if c != key])
