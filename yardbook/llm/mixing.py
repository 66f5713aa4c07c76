"""Mixing sources to target word shares by balanced sampling (the cube method).

Every source gets a target: its weight's share of all words to take, at most ``cap`` times what it
holds, the excess shared anew by weight. A document's expected number of copies is its source's
target over its source's size. The whole part is taken outright; the fraction is an inclusion
probability. These probabilities are moved inside the null space of two constraints - words and
documents taken - until all but a few are 0 or 1, so both totals stay what they were.

The moves run in rounds. A round deals the undecided documents of each source into blocks of bounded
size and works each block on its own; at most two documents of a block stay undecided and go to the
next round with what is left of their probability. When a source has one block left, the landing
decides its last two so that the words taken come nearest to the target.

Defined results: null text has size 0; documents of size 0 count as documents only; null sources form
one source, last in order; repeated rows are documents of their own; if all words are 0 all targets
are 0; an empty table gives an empty result. Reruns agree: blocks and moves depend on the rows alone.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, cut, free_name, text_of

BLOCK = 4096
HEAVY = 16
LAST = 14


def words_in(df: DataFrame, text: str = "text") -> Column:
    return F.regexp_count(text_of(df, text), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], total: float, cap: float) -> DataFrame:
    """Targets of (source, source_size, documents) rows; ``total``: times all words to take.

    Sources are numbered in code point order by range partitions; the rounds of resharing fetch one
    row of sums each.
    """
    # One row per source and no text, numbered through the counts of the sorted partitions.
    sorted_ = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("slot", F.monotonically_increasing_id())
    slotted = cut(sorted_.withColumn("part", F.shiftright("slot", 33)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = slotted.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    number = F.col("start") + F.col("slot").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (number % len(weights) + 1).cast("int"))
    # Size bound of the broadcast: one row per range partition.
    weighted = cut(slotted.join(F.broadcast(starts), "part").select("source", "source_size", "documents", weight.alias("weight")))
    most = F.col("source_size") * F.lit(float(cap))
    sums = weighted.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    wanted = float(total) * (sums["size"] or 0)
    level = wanted / sums["weight"] if sums["weight"] else 0.0
    while True:  # each round fetches one row of exact sums
        full = most < F.col("weight") * F.lit(level)
        held, open_ = weighted.agg(
            F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))
        ).first()
        after = (wanted - float(cap) * (held or 0)) / open_ if open_ else level
        if after <= level * (1 + 1e-12):
            break
        level = after
    return weighted.withColumn("target", F.least(most, F.col("weight") * F.lit(level)))


def fly(sizes: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Move probabilities along null vectors of (words, documents) until at most two are open.

    Three open documents at a time: a vector orthogonal to both constraints, followed to the nearer
    face of the cube. The direction is the one that needs the shorter step, the first one on a tie.
    """
    chances = chances.astype(float).tolist()
    scale = float(max(np.max(sizes, initial=0.0), 1.0))
    sizes = (np.asarray(sizes, float) / scale).tolist()
    waiting = iter([i for i, p in enumerate(chances) if 0.0 < p < 1.0])
    held = list(itertools.islice(waiting, 3))
    while len(held) == 3:
        a, b, c = (sizes[i] for i in held)
        way = (b - c, c - a, a - b)
        if not any(way):
            way = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, w in zip(held, way):
            p = chances[i]
            if w > 0:
                up, down = min(up, (1.0 - p) / w), min(down, p / w)
            elif w < 0:
                up, down = min(up, p / -w), min(down, (1.0 - p) / -w)
        step = up if up <= down else -down
        left = []
        for i, w in zip(held, way):
            p = chances[i] + step * w
            p = 0.0 if p < 1e-9 else 1.0 if p > 1.0 - 1e-9 else p
            chances[i] = p
            if 0.0 < p < 1.0:
                left.append(i)
        held = left + list(itertools.islice(waiting, 3 - len(left)))
    return np.array(chances)


def decide_heaviest(sizes: np.ndarray, chances: np.ndarray, most: int = HEAVY) -> np.ndarray:
    """Move the heaviest open documents to 0 or 1 along null vectors of the words alone.

    What a document gains in words all lighter open ones lose in equal shares of their sizes, as far as the
    shorter way allows; one that the lighter ones cannot level stays open.
    """
    chances = chances.astype(float)
    order = np.argsort(-sizes, kind="stable")
    order = order[(chances[order] > 0) & (chances[order] < 1)]
    for place, i in enumerate(order[:most]):
        lighter = order[place + 1 :]
        weight = sizes[lighter].sum()
        if not weight:
            break
        room_up, room_down = chances[lighter].min(), 1.0 - chances[lighter].max()
        ways = [(1.0 - chances[i], 1.0, room_up), (chances[i], -1.0, room_down)]
        for way, sign, room in sorted(ways, key=lambda w: w[0]):
            shift = way * sizes[i] / weight
            if shift < room:
                chances[lighter] -= sign * shift
                chances[i] = 1.0 if sign > 0 else 0.0
                break
    return chances


def last_ones(sizes: np.ndarray, chances: np.ndarray, most: int = LAST) -> np.ndarray:
    """Places of at most ``most`` open documents, spread evenly over the order of sizes."""
    open_ = np.flatnonzero((chances > 0) & (chances < 1))
    ordered = open_[np.argsort(sizes[open_], kind="stable")]
    return ordered if len(ordered) <= most else ordered[np.arange(most) * len(ordered) // most]


def land(sizes: np.ndarray, chances: np.ndarray, missing: float, near: float = 1.0) -> np.ndarray:
    """Decide the open documents so that their words differ least from ``missing``, or by ``near`` at most; of
    these choices one with the expected number of documents."""
    open_ = np.flatnonzero((chances > 0) & (chances < 1))
    picks = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = np.maximum(np.abs(picks @ sizes[open_] - missing), near)
    count = np.abs(picks.sum(axis=1) - chances[open_].sum())
    out = chances.astype(float)
    out[open_] = picks[np.lexsort((count, off))[0]]
    return out


_STATE = "key long, source string, size long, place long, chance double"


def _fly_block(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("place", kind="mergesort")
    frame["chance"] = fly(frame["size"].to_numpy(float), frame["chance"].to_numpy(float))
    return frame[["key", "source", "size", "place", "chance"]]


def _land_source(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("place", kind="mergesort")
    sizes, start = frame["size"].to_numpy(float), frame["chance"].to_numpy(float)
    open_ = int(((start > 0) & (start < 1)).sum())
    levelled = decide_heaviest(sizes, start, min(HEAVY, max(0, open_ - LAST)))
    kept = last_ones(sizes, levelled)
    moving = levelled.copy()
    moving[kept] = 0.0
    flown = fly(sizes, moving)
    flown[kept] = levelled[kept]
    wanted = float(np.dot(sizes, start))
    frame["chance"] = land(sizes, flown, wanted - float(np.dot(sizes, flown == 1.0)), max(1.0, wanted / 2000))
    return frame[["key", "source", "size", "place", "chance"]]


def mix(
    df: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    total: float = 1.5,
    cap: float = 2.0,
    size: Column | None = None,
    source: str = "source",
    block: int = BLOCK,
    row_key: str | None = None,
) -> DataFrame:
    """All rows and columns of ``df`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``size``: words of a row, by default those of its ``text``. Where ``df`` has columns of the added
    names, the mix's replace them. ``row_key`` names a column that tells all rows apart and is the same in
    every pass; it is not returned, and without it the rows are stored with a number.
    """
    key, own_size, group, spread, one = (free_name(df, n) for n in ("_key", "_size", "_source", "_spread", "_one"))
    hashable = [df[f.name] for f in df.schema if f.name != row_key and "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    rows = df.withColumns(
        {
            own_size: F.coalesce(size if size is not None else words_in(df), F.lit(0)).cast("long"),
            group: df[source].cast("string"),
            spread: F.xxhash64(*hashable),
            key: df[row_key] if row_key else F.monotonically_increasing_id(),
        }
    )
    narrow = F.col(key).alias("key"), F.col(group).alias("source"), F.col(own_size).alias("size"), F.col(spread).alias("spread")
    scratch = Scratch(df.sparkSession, "mix")
    if row_key is None:
        # Stored once, because the keys must name the same rows in every later step.
        rows = scratch.store(rows, "rows")
        sized = rows.select(*narrow)
    else:
        sized = scratch.store(rows.select(*narrow), "sizes")
    equal_rows = Window.partitionBy("spread").orderBy("key")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    targets = cut(source_targets(sources, weights, total, cap))
    rate = F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(0.0)
    # A place depends on the row's values alone; equal rows are told apart by their number.
    state = (
        sized.withColumn("place", F.xxhash64("spread", F.row_number().over(equal_rows)))
        .alias("d")
        .join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("d.key", "d.source", "d.size", "d.place", (rate - F.floor(rate)).alias("chance"), F.col("t.documents").alias("open"))
    )
    state = cut(state.where("chance > 0"))
    taken_once, rounds = [], 0
    while not state.where(F.col("open") > block).isEmpty():
        dealt = state.withColumn("block", F.pmod(F.xxhash64("place", F.lit(rounds)), F.ceil(F.col("open") / block)))
        moved = cut(dealt.groupBy("source", "block").applyInPandas(_fly_block, _STATE))
        taken_once.append(moved.where("chance = 1").select("key"))
        left = moved.where("chance > 0 and chance < 1")
        counts = left.groupBy("source").agg(F.count("*").alias("open"))
        left = left.alias("l").join(counts.alias("c"), F.col("l.source").eqNullSafe(F.col("c.source")))
        state = cut(left.select("l.*", "c.open"))
        rounds += 1
    landed = cut(state.groupBy("source").applyInPandas(_land_source, _STATE))
    extra = landed.where("chance = 1").select("key")
    for more in taken_once:
        extra = extra.unionByName(more)
    added = ("size", "source_size", "target", "copies", "taken")
    copies = (F.floor(rate) + F.coalesce(F.col(f"e.{one}"), F.lit(0))).cast("long")
    # All is decided on rows without texts, so the rows themselves are shuffled once, to meet their numbers.
    decided = (
        sized.alias("s")
        .join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .join(extra.select("key", F.lit(1).alias(one)).alias("e"), F.col("s.key") == F.col("e.key"), "left")
        .select("s.key", "s.size", "t.source_size", "t.target", copies.alias("copies"), (copies * F.col("s.size")).alias("taken"))
    )
    own = [c for c in df.columns if c.lower() not in added and c != row_key]
    rows = (rows if row_key is None else df).select(F.col(row_key or key).alias(key), *[F.col(f"`{c}`") for c in own])
    return (
        rows.alias("r")
        .join(decided.alias("d"), F.col(f"r.{key}") == F.col("d.key"))
        .select(*[F.col(f"r.`{c}`") for c in own], *[F.col(f"d.{c}") for c in added])
    )
