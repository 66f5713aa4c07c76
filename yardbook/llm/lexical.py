"""Ranked lexical search: items as queries against all documents, by dense blocked products.

Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, as 64-bit hashes.

*Blocks of items.* Items are taken in blocks whose matrix - items by different terms - has at most ``CELLS``
cells; each block is one pass over all documents. (A benchmark is one block.) The pass reads every text
once and stores, for each document with a term, its length and the block's terms in it with their counts.

*Weights.* One pass over the stored counts gives the number of documents, their terms, and in how many
documents each term of the block stands, summed within the tasks first.

*Tiles.* A block's matrix is cut into vocabulary tiles of at most ``COLUMNS`` terms; a tile of documents
becomes a dense matrix of term impacts over the columns that stand in it, and the product of both is one
BLAS call in float64. An impact is below a million, so a vocabulary tile ends where an item's weights would
reach 2**53 / 1,000,000 (a term repeated more often than that is spread over several tiles): all
partial sums are whole numbers below 2**53 and exact. Tiles are added in 64-bit integers.

*Ranks.* From each document tile an item takes all documents that reach its k-th best score, ties
included, and the best ``k`` so far by (score, identifier) go on. A task ends with ``k`` rows an item;
these are ranked in two steps, so that an item's rows of all tasks never meet in one.

Defined results: null texts and texts without a term hold none, match nothing and are not counted; an
item without a term, or whose terms are nowhere, has no rows; scores of 0 are left out; equal scores are
ranked by identifier, null identifiers last; repeated rows are ranked each, of items as of documents; empty
tables give an empty result; texts are used whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, text_of, text_slices, words

CELLS = 1 << 22
ITEMS = 1024
COLUMNS = 2048
DOCUMENTS = 512
IMPACT = 1_000_000
_SLICE = 1 << 18
_SALTS = 64

# The bytes of terms in UTF-8, that is digits, letters and all bytes of non-ASCII characters.
_TERM_BYTES = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _TERM_BYTES[_low : _high + 1] = True


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after, term hashes, terms up to each row's end) of runs of texts."""
    for row, after, data, ends in text_slices(column, _SLICE):
        hashes, _, _, upto = words(np.where(_TERM_BYTES[data], data, np.uint8(32)), ends)
        yield row, after, hashes.view(np.int64), upto


def _lists(at: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    """One list a row of ``values``, which belong to the ascending rows ``at``."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(rows + 1)).astype(np.int32)), pa.array(values))


def _item_blocks(items: DataFrame) -> DataFrame:
    """(block, nr, item_id, terms, counts): ``block`` numbers sets of items of bounded size."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, width = TaskContext.get().partitionId() << 32, 0, 0, 0
        number = 0
        for batch in batches:
            for row, after, hashes, upto in _terms(batch.column(1)):
                begin = 0
                for i, end in enumerate(upto):
                    found, counts = np.unique(hashes[begin:end], return_counts=True)
                    begin = end
                    if held and (held + 1) * (width + len(found)) > CELLS:
                        block, held, width = block + 1, 0, 0
                    held, width, number = held + 1, width + len(found), number + 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part + block]), pa.array([part + number]), batch.column(0).slice(row + i, 1),
                            _lists(np.zeros(len(found)), found, 1), _lists(np.zeros(len(found)), counts.astype(np.int64), 1),
                        ],
                        names=["block", "nr", "item_id", "terms", "counts"],
                    )

    kind = items.schema["item_id"].dataType
    lists = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("terms", "counts")]
    fields = [T.StructField("block", T.LongType()), T.StructField("nr", T.LongType()), T.StructField("item_id", kind), *lists]
    return items.mapInArrow(scan, T.StructType(fields))


def _term_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(id, n, at, tf) of every document with a term: its length, and the places of ``vocabulary`` in it."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most CELLS terms

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            for row, after, hashes, upto in _terms(batch.column(1)):
                sizes = np.diff(upto, prepend=0)
                place = np.minimum(np.searchsorted(table, hashes), max(len(table) - 1, 0))
                hit = table[place] == hashes if len(table) else np.zeros(len(hashes), bool)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                pairs, counts = np.unique(owner[hit] * max(len(table), 1) + place[hit], return_counts=True)
                holder, at = np.divmod(pairs, max(len(table), 1))
                columns = [batch.column(0).slice(row, after - row), pa.array(sizes)]
                columns += [_lists(holder, at.astype(np.int32), after - row), _lists(holder, counts.astype(np.int32), after - row)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "at", "tf"]).filter(pa.array(sizes > 0))

    whole = T.ArrayType(T.IntegerType())
    fields = [T.StructField("id", docs.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("at", whole), T.StructField("tf", whole)]
    return docs.mapInArrow(scan, T.StructType(fields))


def _statistics(counted: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """(documents, their terms, documents that hold each term of the vocabulary)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(terms, np.int64)
        documents = length = 0
        for batch in batches:
            documents, length = documents + batch.num_rows, length + int(pc.sum(batch.column(0)).as_py() or 0)
            found += np.bincount(batch.column(1).flatten().to_numpy(), minlength=terms)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([some, [-1, -2]])), pa.array(np.concatenate([found[some], [documents, length]]))], names=["at", "n"]
        )

    rows = counted.select("n", "at").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    totals = {r["at"]: r["n"] for r in rows}  # a row a term of the vocabulary
    holders = np.zeros(terms, np.int64)
    for at, n in totals.items():
        if at >= 0:
            holders[at] = n
    return totals.get(-1, 0), totals.get(-2, 0), holders


def weights(documents: int, holders: np.ndarray) -> np.ndarray:
    return np.floor(1000.0 * np.log((2.0 * documents + 2.0) / (2.0 * holders + 1.0))).astype(np.int64)


def vocabulary_tiles(matrix: np.ndarray, columns: int = COLUMNS, most: int = 2**53 // IMPACT - 1) -> list[tuple[int, int, np.ndarray]]:
    """(first column, column after, float64 tile) of an integer matrix, each row of a tile summing to ``most`` at most."""
    tiles, begin = [], 0
    while begin < matrix.shape[1]:
        sums = np.cumsum(matrix[:, begin : begin + columns], axis=1).max(axis=0, initial=0)
        after = begin + max(1, int(np.searchsorted(sums, most, "right")))
        rest = matrix[:, begin:after]
        while rest.any():  # once, but for a single column of larger numbers
            part = np.minimum(rest, most)
            tiles.append((begin, after, part.astype(float)))
            rest = rest - part
        begin = after
    return tiles


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Whole-number impacts of counts ``tf`` in documents of ``n`` terms."""
    sizes, where = np.unique(n, return_inverse=True)
    # In Python's integers, which do not overflow.
    m = np.array([25 + 75 * int(x) * documents // max(length, 1) for x in sizes], np.int64)[where]
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _best(pool: pa.Table, k: int) -> pa.Table:
    """The first ``k`` rows of each item by (score, identifier)."""
    pool = pool.take(pc.sort_indices(pool, [("nr", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end"))
    nr = pool.column("nr").to_numpy()
    opens = np.flatnonzero(np.diff(nr, prepend=-1)) if len(nr) else np.zeros(0, int)
    place = np.arange(len(nr)) - np.repeat(opens, np.diff(opens, append=len(nr)))
    return pool.filter(pa.array(place < k))


def _top(counted: DataFrame, matrix: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(nr, score, id): the best documents of each row of ``matrix``, ``k`` a task."""
    items = len(matrix)
    shared = counted.sparkSession.sparkContext.broadcast(vocabulary_tiles(matrix))  # at most CELLS numbers

    def scores(n: np.ndarray, opens: np.ndarray, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """(documents of a tile, items)."""
        owner = np.repeat(np.arange(len(n)), np.diff(opens))
        value = impacts(tf.astype(np.int64), n[owner], documents, length).astype(float)
        out = np.zeros((len(n), items), np.int64)
        for first, after, tile in shared.value:
            inside = (at >= first) & (at < after)
            present, column = np.unique(at[inside], return_inverse=True)
            if len(present):
                dense = np.zeros((len(n), len(present)))
                dense[owner[inside], column] = value[inside]
                out += (dense @ tile[:, present - first].T).astype(np.int64)
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = None
        least = np.ones(items, np.int64)
        for batch in batches:
            kind = batch.schema.field(0).type
            if pool is None:
                pool = pa.table({"nr": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "id": pa.array([], kind)})
            for first in range(0, batch.num_rows, DOCUMENTS):
                tile = batch.slice(first, DOCUMENTS)
                opens = tile.column(2).offsets.to_numpy().astype(np.int64)
                found = scores(tile.column(1).to_numpy(), opens - opens[0], tile.column(2).flatten().to_numpy(), tile.column(3).flatten().to_numpy())
                at_least = least
                if len(found) > k:
                    at_least = np.maximum(least, np.partition(found, len(found) - k, axis=0)[len(found) - k])
                row, nr = np.nonzero(found >= at_least)
                if len(row):
                    own = pa.table({"nr": pa.array(nr), "score": pa.array(found[row, nr]), "id": tile.column(0).take(pa.array(row))})
                    pool = _best(pa.concat_tables([pool, own]), k).combine_chunks()
                    held, worst = pool.column("nr").to_numpy(), pool.column("score").to_numpy()
                    ends = np.flatnonzero(np.diff(held, append=-1))
                    full = np.diff(ends, prepend=-1) == k
                    least[held[ends[full]]] = worst[ends[full]]
        if pool is not None:
            yield from pool.to_batches()

    schema = T.StructType([T.StructField("nr", T.LongType()), T.StructField("score", T.LongType()), T.StructField("id", counted.schema["id"].dataType)])
    return counted.mapInArrow(scan, schema)


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` documents of the highest score for each item."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    asked = items.select(items[item_id].alias("item_id"), text_of(items, item_text).alias("text"))
    parts = -(-asked.count() // ITEMS)
    asked = scratch.store(_item_blocks(asked.coalesce(max(1, parts))), "items")
    plain = docs.select(docs[doc_id].alias("id"), text_of(docs, text).alias("text"))
    found = None
    for row in asked.select("block").distinct().orderBy("block").collect():  # a number a block of up to CELLS cells
        block = asked.where(F.col("block") == row["block"]).orderBy("nr").collect()
        flat = np.concatenate([np.array(r["terms"], np.int64) for r in block])
        vocabulary, column = np.unique(flat, return_inverse=True)
        counted = scratch.store(_term_counts(plain, vocabulary), f"counts-{row['block']}")
        documents, length, holders = _statistics(counted, len(vocabulary))
        matrix = np.zeros((len(block), len(vocabulary)), np.int64)
        matrix[np.repeat(np.arange(len(block)), [len(r["terms"]) for r in block]), column] = [c for r in block for c in r["counts"]]
        matrix *= weights(documents, holders)
        numbers = F.array(*[F.lit(r["nr"]) for r in block])
        best = _top(counted, matrix, documents, length, k).withColumn("nr", F.get(numbers, F.col("nr").cast("int")))
        found = best if found is None else found.unionByName(best)
    if found is None:
        kinds = (plain.schema["id"].dataType.simpleString(), asked.schema["item_id"].dataType.simpleString())
        return spark.createDataFrame([], f"item_id {kinds[1]}, rank int, doc_id {kinds[0]}, score long")
    found = scratch.store(found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS))), "found")
    best_first = F.col("score").desc(), F.col("id").asc_nulls_last()
    for by in (("nr", "salt"), ("nr",)):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best_first))).where(F.col("rank") <= k)
    names = asked.select("nr", "item_id")
    return found.join(names, "nr").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
