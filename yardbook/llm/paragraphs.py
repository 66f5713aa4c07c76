"""Repeated passages: paragraph MinHash banding, exact Jaccard, components; repeated runs of words.

*Paragraphs* are the lines of a text; with ``join_lines`` lines of fewer than ``least_words`` words that follow
one another are one, so that wrapped text counts however it is wrapped. One of more than ``LONG`` words is cut before words
where the two words before have the smallest hash for ``REACH`` words either way, so that a passage inside a
longer line is cut alike wherever it stands and no part is short. What has fewer than ``least_words`` words even so is no paragraph.

A paragraph is the set of its five-word shingles. ``BANDS`` bands of ``ROWS`` MinHash values each put
it into buckets: a pair at the threshold of 0.8 misses all of them with a probability of 2e-4, one at
0.9 with 2e-7. Equal paragraphs are one class. In each bucket first one class of every component meets
the others, components are joined, and then all classes of components that are still different meet,
so a passage that very many documents share is never expanded into pairs. Each class has a signature of
parities, and the join of a bucket refuses pairs whose signatures differ in more bits than similar sets do in
shingles, so that pairs below the threshold are hardly ever written and none at it is lost. Pairs are confirmed by exact
Jaccard similarity of the full sets, which are computed again from the texts of one occurrence of each class.
Of each component the first paragraph (smallest document, then place) stays, and only that one: rows with
the same or no identifier are told apart by their texts, and of rows that are repeated whole one is chosen.

*Runs* are repeated word for word and do not depend on lines: each word of a span of ``least_run`` words
that stands anywhere else, in lines of any length and across their ends, is in a run. A span belongs to
the smallest hash of the shorter spans in it; the neighbouring spans that one such place owns are a block,
so equal spans have equal owners and nothing is sampled. Blocks whose owner stands once are left; equal
blocks are one class; where an owner has several classes their spans are counted one by one. The first
occurrence of a span (smallest document, then place) stays. Runs are whole; what a removed paragraph
covers already is left out of a run, and so is what a kept one covers of a run that stays. A kept
paragraph inside a run that goes is not kept. A run with a changed word is two runs, each found only with
``least_run`` words of its own. Its ``passage_id`` is the smallest hash of its spans and ``copies`` the
occurrences of its most frequent one, so copies that extend differently may have different ids.

Defined results: null and empty texts have no paragraphs; null identifiers come last in the choice of
what stays; repeats inside a document and repeated rows count; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, cut, differ_little, mix, parities, powers, shingles, small, text_of, text_slices, words
from .components import components

BANDS, ROWS, LONG, REACH = 12, 3, 100, 20
# Odd multipliers: each permutes the 64-bit numbers, and shingle hashes are spread evenly already.
_SEEDS = np.random.default_rng(17).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
BITS = 256
_BROADCAST_ROWS = 2_000_000
_SLICE = 1 << 18


class _Slice:
    """The paragraphs of a run of whole texts: text, first word and word after of each, as arrays."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, least_words: int, join_lines: bool = False):
        self.hashes, starts, stops, upto = words(data, ends)
        n = len(self.hashes)
        self.begins = np.concatenate([[0], upto[:-1]])
        if n == 0:
            self.text = self.first = self.after = np.zeros(0, np.int64)
            return
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        new_line = np.ones(n, bool)
        new_line[1:] = lines[starts[1:]] != lines[stops[:-1]]
        new_line[self.begins[self.begins < n]] = True
        opens = np.flatnonzero(new_line)
        short = (np.diff(opens, append=n) < least_words) & join_lines
        owner = np.searchsorted(upto, opens, "right")
        follows = np.zeros(len(opens), bool)
        follows[1:] = short[1:] & short[:-1] & (owner[1:] == owner[:-1])
        opens = np.unique(np.concatenate([opens[~follows], _anchors(self.hashes, opens[~follows], least_words)]))
        closes = np.append(opens[1:], n)
        whole = closes - opens >= least_words
        self.first, self.after = opens[whole], closes[whole]
        self.text = np.searchsorted(upto, self.first, "right")

    def prints(self) -> np.ndarray:
        """A hash of the word sequence of each paragraph."""
        up, down = powers(len(self.hashes))
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(self.hashes * up[: len(self.hashes)])])
            whole = (sums[self.after] - sums[self.first]) * down[self.first]
            return mix(mix(whole) + (self.after - self.first).astype(np.uint64)).view(np.int64)

    def shingles(self, n: int, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of the paragraphs (or of ``some``), one after another, and where each begins."""
        first, after = (self.first, self.after) if some is None else (self.first[some], self.after[some])
        counts = after - first - n + 1
        opens = np.cumsum(counts) - counts
        at = np.arange(counts.sum()) + np.repeat(first - opens, counts)
        return shingles(self.hashes, n)[at] if len(at) else np.zeros(0, np.uint64), opens

    def bands(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(paragraphs, BANDS) hashes of ROWS MinHash values each, the signatures, and the sizes of the sets."""
        values, opens = self.shingles(n)
        out = np.zeros((len(opens), BANDS), np.uint64)
        with np.errstate(over="ignore"):
            for k, seed in enumerate(_SEEDS if len(opens) else ()):
                band = k // ROWS
                before = out[:, band] if k % ROWS else np.uint64(band)
                out[:, band] = mix(before + np.minimum.reduceat(values * seed, opens))
        # Shingles that a paragraph repeats count once.
        owner = np.repeat(np.arange(len(opens)), np.diff(opens, append=len(values)))
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        once = np.ones(len(values), bool)
        once[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        sizes = np.bincount(owner[once], minlength=len(opens))
        return out.view(np.int64), parities(values[once], np.cumsum(sizes) - sizes, BITS), sizes


def _anchors(hashes: np.ndarray, opens: np.ndarray, least_words: int) -> np.ndarray:
    """Where lines of more than ``LONG`` words are cut: at words before which stands the smallest hash of two
    neighbours for ``REACH`` words either way. So cuts are as far apart at least, and hang on the words around."""
    n = len(hashes)
    sizes = np.diff(opens, append=n)
    if not (sizes > LONG).any():
        return np.zeros(0, np.int64)
    pair = np.full(n + 2 * REACH, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        pair[REACH + 2 : REACH + n] = mix(hashes[:-2] ^ mix(hashes[1:-1]))
    least = _first_least(pair, 2 * REACH + 1) == np.arange(n) + REACH
    at = np.flatnonzero(least)
    line = np.searchsorted(opens, at, "right") - 1
    far = (at - opens[line] >= least_words) & (opens[line] + sizes[line] - at >= least_words)
    return at[(sizes[line] > LONG) & far]


def _lists(table: np.ndarray) -> pa.Array:
    """The rows of a table as lists."""
    offsets = np.arange(0, table.size + 1, table.shape[1], dtype=np.int32) if table.size else np.zeros(1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.ravel()))


def _rows(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Identifier, text and a hash of both, which tells rows with one identifier apart."""
    return df.select(df[doc_id].alias("id"), text_of(df, text).alias("text"), F.xxhash64(df[doc_id], F.lit("|"), text_of(df, text)).alias("row"))


def _scan(df: DataFrame, n: int, least_words: int, join_lines: bool, text: str, doc_id: str) -> DataFrame:
    """(id, row, first, after, print, size, bands, sign, at) of every paragraph; ``at`` is a number of its own."""

    def scan(batches):
        for batch in batches:
            for row, _, data, ends in text_slices(batch.column(1), _SLICE):
                found = _Slice(data, ends, least_words, join_lines)
                at = pa.array(row + found.text)
                begins = found.begins[found.text]
                bands, signs, sizes = found.bands(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        batch.column(2).take(at),
                        pa.array(found.first - begins),
                        pa.array(found.after - begins),
                        pa.array(found.prints()),
                        pa.array(sizes),
                        *(_lists(x) for x in (bands, signs)),
                    ],
                    names=["id", "row", "first", "after", "print", "size", "bands", "sign"],
                )

    fields = [T.StructField("id", df.schema[doc_id].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("row", "first", "after", "print", "size")]
    schema = T.StructType([*fields, *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("bands", "sign"))])
    return _rows(df, text, doc_id).mapInArrow(scan, schema).withColumn("at", F.monotonically_increasing_id())


def _asked(df: DataFrame, wanted: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(text, asked): the texts of the rows in ``wanted`` (row, value) with their values."""
    lists = wanted.groupBy("row").agg(F.collect_list("value").alias("asked"))  # at most a row's own paragraphs
    return _rows(df, text, doc_id).join(small(lists, _BROADCAST_ROWS), "row").select("text", "asked")


def _members(df: DataFrame, wanted: DataFrame, n: int, least_words: int, join_lines: bool, text: str, doc_id: str) -> DataFrame:
    """(print, members): the full shingle sets of the paragraphs in ``wanted`` (row, print)."""

    def build(batches):
        for batch in batches:
            asked = batch.column(1)
            for row, after, data, ends in text_slices(batch.column(0), _SLICE):
                found = _Slice(data, ends, least_words, join_lines)
                own = asked.slice(row, after - row).flatten().to_numpy()
                prints = found.prints() if len(found.text) else np.zeros(0, np.int64)
                some = np.flatnonzero(np.isin(prints, own))
                values, opens = found.shingles(n, some)
                sets = [np.unique(v.view(np.int64)) for v in np.split(values, opens[1:])] if len(some) else []
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints[some]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["print", "members"]
                )

    asked = _asked(df, wanted.select("row", F.col("print").alias("value")), text, doc_id)
    return asked.mapInArrow(build, "print long, members array<long>").dropDuplicates(["print"])


def _first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value of each ``width`` neighbours."""
    place, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = place[:-step], place[step:]
        place, span = np.where(values[b] < values[a], b, a), span + step
    return place


class _Spans:
    """Every span of ``size`` words of a run of whole texts, in blocks: neighbours with the same place of the
    smallest shorter span."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, size: int):
        short = max(1, size * 2 // 5)
        hashes, _, _, upto = words(data, ends)
        n = len(hashes)
        owner = np.repeat(np.arange(len(upto)), np.diff(upto, prepend=0))[: max(0, n - size + 1)]
        spans = np.flatnonzero(np.arange(len(owner)) + size <= upto[owner])
        if not len(spans):
            none = np.zeros(0, np.int64)
            self.text = self.start = self.counts = self.prints = self.owners = self.least = self.opens = self.full = none
            return
        up, down = powers(n)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up[:n])])
            parts, full = (mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1]) for k in (short, size))
            place = _first_least(parts, size - short + 1)[spans]
            # Spans of two texts are never in one block.
            self.opens = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(owner[spans], prepend=-1) != 0))
            self.counts = np.diff(self.opens, append=len(spans))
            first = spans[self.opens]
            whole = (sums[first + self.counts - 1 + size] - sums[first]) * down[first]
            self.prints = mix(mix(whole) + self.counts.astype(np.uint64)).view(np.int64)
        self.full = full[spans].view(np.int64)
        self.text = owner[first]
        self.start = first - np.concatenate([[0], upto[:-1]])[self.text]
        self.owners = parts[place[self.opens]].view(np.int64)
        self.least = np.minimum.reduceat(self.full, self.opens)


def _blocks(df: DataFrame, size: int, text: str, doc_id: str) -> DataFrame:
    """(id, row, start, spans, print, owner, least) of every block of spans."""

    def scan(batches):
        for batch in batches:
            for row, _, data, ends in text_slices(batch.column(1), _SLICE):
                found = _Spans(data, ends, size)
                at = pa.array(row + found.text)
                longs = found.start, found.counts, found.prints, found.owners, found.least
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(2).take(at), *(pa.array(x, pa.int64()) for x in longs)],
                    names=["id", "row", "start", "spans", "print", "owner", "least"],
                )

    fields = [T.StructField("id", df.schema[doc_id].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("row", "start", "spans", "print", "owner", "least")]
    return _rows(df, text, doc_id).mapInArrow(scan, T.StructType(fields))


def _span_hashes(df: DataFrame, wanted: DataFrame, size: int, text: str, doc_id: str) -> DataFrame:
    """(print, hashes): the spans of the blocks in ``wanted`` (row, print)."""

    def build(batches):
        for batch in batches:
            asked = batch.column(1)
            for row, after, data, ends in text_slices(batch.column(0), _SLICE):
                found = _Spans(data, ends, size)
                some = np.flatnonzero(np.isin(found.prints, asked.slice(row, after - row).flatten().to_numpy()))
                counts = found.counts[some]
                offsets = np.concatenate([[0], np.cumsum(counts)])
                at = np.arange(offsets[-1]) + np.repeat(found.opens[some] - offsets[:-1], counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.prints[some]), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found.full[at]))],
                    names=["print", "hashes"],
                )

    asked = _asked(df, wanted.select("row", F.col("print").alias("value")), text, doc_id)
    return asked.mapInArrow(build, "print long, hashes array<long>").dropDuplicates(["print"])


def _merged(spans: DataFrame, *by: str) -> DataFrame:
    """Spans of a row that overlap or touch, as one."""
    own = Window.partitionBy("row", *by).orderBy("first", "after")
    before = F.max("after").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("opens", F.coalesce((F.col("first") > before).cast("int"), F.lit(1)))
    numbered = marked.withColumn("number", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    facts = F.first("id").alias("id"), F.max("times").alias("times"), F.min("first").alias("first"), F.max("after").alias("after")
    return numbered.groupBy("row", *by, "number").agg(*facts, F.max("copies").alias("copies"), F.min("passage").alias("passage")).drop("number")


def _repeated_runs(df: DataFrame, size: int, scratch: Scratch, text: str, doc_id: str) -> DataFrame:
    """(row, goes, id, times, first, after, copies, passage) of the runs of repeated spans; ``times``: equal rows."""
    blocks = scratch.store(_blocks(df, size, text, doc_id), "blocks")
    owners = blocks.groupBy("owner").agg(F.count("*").alias("n")).where("n > 1").select("owner")
    shared = scratch.store(blocks.join(owners, "owner", "left_semi"), "shared")
    scratch.drop("blocks")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "start", "row")
    prints = shared.groupBy("print", "owner", "spans", "least").agg(F.count("*").alias("n"), F.min(order).alias("best"))
    prints = cut(prints.withColumn("kinds", F.count("*").over(Window.partitionBy("owner"))))
    alike = prints.where("kinds = 1").select(
        "print", "best", F.lit(True).alias("own"), F.lit(0).cast("long").alias("low"), (F.col("spans") - 1).alias("high"),
        F.col("n").alias("copies"), F.col("least").alias("passage"),
    )
    wanted = cut(prints.where("kinds > 1").select("print", "n", "best"))
    each = _span_hashes(df, wanted.select("best.row", "print"), size, text, doc_id).join(wanted, "print")
    each = scratch.store(each.select("print", "n", "best", F.posexplode("hashes").alias("at", "hash")), "spans")
    place = F.struct(F.col("best.no_id").alias("no_id"), F.col("best.id").alias("id"), (F.col("best.start") + F.col("at")).alias("start"), F.col("best.row").alias("row"))
    counts = each.groupBy("hash").agg(F.sum("n").alias("copies"), F.min(place).alias("origin")).where("copies > 1")
    known = each.join(counts, "hash").withColumn("own", place.eqNullSafe(F.col("origin")))
    known = known.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("print", "own").orderBy("at")))
    apart = known.groupBy("print", "best", "own", "run").agg(
        F.min("at").cast("long").alias("low"), F.max("at").cast("long").alias("high"), F.max("copies").alias("copies"), F.min("hash").alias("passage")
    )
    runs = cut(alike.unionByName(apart.drop("run")))
    rows = shared.groupBy("id", "row", "start", "print").agg(F.count("*").alias("times")).join(runs, "print")
    same = F.col("own") & F.col("id").eqNullSafe(F.col("best.id")) & (F.col("start") == F.col("best.start")) & (F.col("row") == F.col("best.row"))
    spans = rows.select(
        "id", "row", "times", (~same).alias("goes"), (F.col("start") + F.col("low")).alias("first"),
        (F.col("start") + F.col("high") + size).alias("after"), "copies", "passage",
    )
    merged = cut(_merged(spans, "goes"))
    for name in ("shared", "spans"):
        scratch.drop(name)
    return merged


def _inside_runs(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """``lines`` with ``kept`` false for those that a run that goes covers."""
    gone = runs.where("goes").select("row", F.col("first"), F.col("after").alias("reach"))
    both = lines.withColumn("line", F.lit(1)).unionByName(gone.withColumn("line", F.lit(0)), allowMissingColumns=True)
    reach = F.max("reach").over(Window.partitionBy("row").orderBy("first", "line").rowsBetween(Window.unboundedPreceding, 0))
    inside = F.coalesce(reach >= F.col("after"), F.lit(False))
    return both.withColumn("kept", F.col("kept") & ~inside).where("line = 1").drop("line", "reach")


def _outside_lines(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """The parts of runs that repeated paragraphs do not state already, in the form of ``lines``."""
    fact = F.struct("id", "times", "copies", "passage")
    spans = runs.select("row", "first", "after", F.when(F.col("goes"), "goes").otherwise("stays").alias("kind"), fact.alias("fact"))
    kinds = F.when(F.col("kept"), "line").otherwise("cleared")
    spans = spans.unionByName(lines.join(runs.select("row").distinct(), "row", "left_semi").select("row", "first", "after", kinds.alias("kind")), allowMissingColumns=True)
    ends = spans.select("row", "kind", F.explode(F.array(
        F.struct(F.col("first").alias("at"), F.lit(1).alias("step"), "fact"), F.struct(F.col("after").alias("at"), F.lit(-1).alias("step"), F.lit(None).cast(spans.schema["fact"].dataType).alias("fact"))
    )).alias("e")).select("row", "kind", "e.*")
    names = "goes", "stays", "line", "cleared"
    steps = [F.sum(F.when(F.col("kind") == k, F.col("step")).otherwise(0)).alias(k) for k in names]
    facts = [F.max(F.when(F.col("kind") == k, F.col("fact"))).alias(f"{k}_fact") for k in names[:2]]
    own = Window.partitionBy("row").orderBy("at")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    swept = ends.groupBy("row", "at").agg(*steps, *facts).withColumn("after", F.lead("at").over(own))
    swept = swept.withColumns({k: F.sum(k).over(upto) for k in names} | {f"{k}_fact": F.last(f"{k}_fact", True).over(upto) for k in names[:2]})
    goes = (F.col("goes") > 0) & (F.col("cleared") == 0)
    stays = (F.col("goes") == 0) & (F.col("stays") > 0) & (F.col("line") == 0) & (F.col("cleared") == 0)
    parts = swept.where(goes | stays).select(
        "row", F.col("at").alias("first"), "after", stays.alias("kept"), F.when(stays, F.col("stays_fact")).otherwise(F.col("goes_fact")).alias("fact")
    )
    parts = _merged(parts.select("row", "first", "after", "kept", "fact.*"), "kept")
    # Of rows repeated with their identifier the first one keeps what stays.
    parts = parts.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return parts.withColumn("kept", F.col("kept") & (F.col("time") == 1)).drop("times", "time")


def repeated_paragraphs(
    df: DataFrame, words_per_shingle: int = 5, percent: int = 80, least_words: int = 20, text: str = "text", doc_id: str = "doc_id",
    least_run: int = 50, join_lines: bool = False,
) -> DataFrame:
    """One row per paragraph that is repeated and per part of a repeated run outside such paragraphs:
    ``doc_id``, ``first_word``, ``after_word``, ``passage_id``, ``copies``, ``kept``. Words are counted
    from 0; removing the spans with ``kept`` false leaves each passage once.
    """
    n, least_words = words_per_shingle, max(least_words, words_per_shingle)
    scratch = Scratch(df.sparkSession, "paragraphs")
    found = scratch.store(_scan(df, n, least_words, join_lines, text, doc_id), "found")
    classes = found.groupBy("print").agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("bands", "sign", "size")))
    classes = scratch.store(classes, "classes")
    # Bands and signatures are with the classes now.
    places = scratch.store(found.drop("bands", "sign", "size"), "places")
    scratch.drop("found")
    signs = classes.select("print", "size", *(F.get("sign", F.lit(k)).alias(f"s{k}") for k in range(BITS // 64)))
    buckets = classes.select("print", F.explode("bands").alias("bucket"))
    # A class is in a bucket once, as the number of the band is part of it.
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    lists = cut(buckets.join(shared, "bucket"))

    def confirm(pairs: DataFrame, step: str) -> DataFrame:
        pairs = cut(pairs.distinct())
        wanted = pairs.select(F.col("a").alias("print")).union(pairs.select("b")).distinct()
        wanted = cut(wanted.join(classes.select("print", "row"), "print"))
        full = scratch.store(_members(df, wanted, n, least_words, join_lines, text, doc_id), step)
        both = pairs.join(full.select(F.col("print").alias("a"), F.col("members").alias("x")), "a")
        both = both.join(full.select(F.col("print").alias("b"), F.col("members").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y")).cast("long")
        close = cut(both.where(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b"))
        scratch.drop(step)
        return close

    def alike(x: DataFrame, y: DataFrame, apart: Column) -> DataFrame:
        """Pairs of a bucket that may be similar by their signatures; the others are never written."""
        x, y = x.join(signs, "print").alias("x"), y.join(signs, "print").alias("y")
        near = differ_little("x.s", "y.s", F.col("x.size"), F.col("y.size"), BITS // 64, percent)
        met = (F.col("x.bucket") == F.col("y.bucket")) & apart & near
        return x.join(y, met).select(F.col("x.print").alias("a"), F.col("y.print").alias("b"))

    def meet(rows: DataFrame) -> DataFrame:
        return alike(rows, rows, (F.col("x.print") < F.col("y.print")) & (F.col("x.label") != F.col("y.label")))

    least = lists.groupBy("bucket").agg(F.min("print").alias("print"))
    links = confirm(alike(least, lists, F.col("x.print") < F.col("y.print")), "stars")

    def labelled(rows: DataFrame) -> DataFrame:
        nodes = components(links).withColumnRenamed("node", "print").withColumnRenamed("component", "label")
        return cut(rows.join(nodes, "print", "left").withColumn("label", F.coalesce("label", "print")))

    marked = labelled(lists)
    one_each = marked.groupBy("bucket", "label").agg(F.min("print").alias("print"))
    links = cut(links.unionByName(confirm(meet(one_each), "first")))
    marked = labelled(lists)
    links = cut(links.unionByName(confirm(meet(marked), "rest")))
    named = components(links).withColumnRenamed("node", "print")
    scratch.drop("classes")
    placed = places.join(named, "print", "left").withColumn("passage", F.coalesce("component", "print"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "first", "after", "row", "at")
    groups = placed.groupBy("passage").agg(F.count("*").alias("copies"), F.min(order).alias("best")).where("copies > 1")
    same = F.col("at") == F.col("best.at")
    lines = placed.join(groups, "passage").select("id", "row", "first", "after", "passage", "copies", same.alias("kept"))
    runs = _repeated_runs(df, least_run, scratch, text, doc_id)
    lines = cut(_inside_runs(lines, runs))
    scratch.drop("places")
    out = lines.unionByName(_outside_lines(runs, lines))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("first").alias("first_word"),
        F.col("after").alias("after_word"),
        F.col("passage").alias("passage_id"),
        "copies",
        "kept",
    )
