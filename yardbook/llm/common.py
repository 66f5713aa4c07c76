"""Helpers shared by the text operators: stored intermediates, bounded broadcasts, whole-text words.

Intermediate tables go to the folder that the session names in ``spark.checkpoint.dir``, which all
executors share, so a lost executor costs a re-read and no recomputation. Nothing here uses a folder
of the driver's machine unless the session runs on one machine and names no folder itself.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The white space that separates words.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"

_SLICE_BYTES = 1 << 21


def shared_folder(spark: SparkSession) -> str:
    """The folder for stored intermediates; set beside the warehouse only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared folder and cut its lineage; Spark removes the files with the frame.

    Shuffle files of the steps before are kept only as long as the driver holds their plans, so plans
    that nothing refers to any more are collected here.
    """
    shared_folder(df.sparkSession)
    stored = df.checkpoint()
    release(df.sparkSession)
    return stored


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are no longer in use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Parquet tables in the shared folder, for intermediates worth storing by column."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        """Delete one table, or all, once nothing reads it any more."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def file_rows(df: DataFrame) -> tuple[DataFrame, str]:
    """``df``, a plain read of Parquet files, with a number for each row, and the name of that column.

    The number is the row's file and its place in it, so it is the same in every pass, however the files are
    split, and nothing has to be stored for it. Rows that do not come from files are stored with their numbers.
    """
    key, path = free_name(df, "_row"), free_name(df, "_file")
    try:
        placed = df.withColumns({path: df.metadataColumn("_metadata")["file_path"], key: df.metadataColumn("_metadata")["row_index"]})
    except AnalysisException:
        return Scratch(df.sparkSession, "numbered").store(df.withColumn(key, F.monotonically_increasing_id()), "rows"), key
    # One row per file, so the window and the broadcast are bounded by the number of files.
    files = placed.select(path).distinct().withColumn(f"{path}_number", F.row_number().over(Window.orderBy(path)).cast("long"))
    numbered = placed.join(F.broadcast(cut(files)), path)
    return numbered.withColumn(key, F.shiftleft(f"{path}_number", 40) + F.col(key)).select(*df.columns, key), key


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``rows`` rows (counted), else unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. Workers on this machine are told where this package is."""
    home, known = str(Path(__file__).parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{known}:{home}".strip(":")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# ---------------------------------------------------------------------------------------------------
# Words of whole texts as 64-bit hashes, one numpy pass over the bytes of a batch.


def _byte_table() -> np.ndarray:
    """A random 64-bit number for each byte, with A-Z as a-z."""
    table = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
    table[65:91] = table[97:123]
    return table


_BYTES = _byte_table()
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown when a longer text comes."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _BASE, np.uint64))])
                inverse = np.uint64(pow(_BASE, -1, 2**64))
                self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, inverse, np.uint64))])
        return self.up, self.down


_POWERS = _Powers()
powers = _POWERS.get


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie one after another in ``data`` (UTF-8 bytes) and end at ``ends``.

    Gives the 64-bit hash of each lower-cased (A-Z) word, its first byte, the byte after it, and for
    each text the number of words up to its end.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(ends), np.int64)
    solid = ~_IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cuts = ends[(ends > 0) & (ends < n)]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _POWERS.get(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * up[:n])])
        hashes = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    return hashes, starts, stops, np.searchsorted(starts, ends)


def text_slices(column: pa.Array, size: int = _SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after, bytes, ends) of runs of whole texts of about ``size`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        after = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        after = min(after, len(column))
        yield row, after, data[offsets[row] : offsets[after]], offsets[row + 1 : after + 1] - offsets[row]
        row = after


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n``-word shingles of one text; with fewer words, of the whole sequence."""
    size = min(n, len(hashes))
    if size == 0:
        return hashes[:0]
    with np.errstate(over="ignore"):
        out = hashes[: len(hashes) - size + 1].copy()
        for k in range(1, size):
            out = mix(out) + hashes[k : len(hashes) - size + 1 + k]
        return mix(out + np.uint64(size))


# ---------------------------------------------------------------------------------------------------
# Parity signatures of sets: a bit for each bin, set if an odd number of values is in it.


def parities(values: np.ndarray, opens: np.ndarray, bits: int) -> np.ndarray:
    """(sets, bits / 64) packed numbers; the distinct ``values`` of the sets, each set beginning at ``opens``."""
    owner = np.repeat(np.arange(len(opens)), np.diff(opens, append=len(values)))
    at = owner * bits + ((values.view(np.uint64) >> np.uint64(16)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(opens) * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8").reshape(len(opens), bits // 64).view(np.int64)


def differ_little(x: str, y: str, m: Column, n: Column, words_: int, percent: int) -> Column:
    """Whether sets of ``m`` and ``n`` values can be similar by their signatures, the columns ``x0``, ``x1``, ... and ``y0``, ...

    Every value that only one set has turns one bit, so no more bits differ than values do. Sets at the
    threshold differ in at most ``(m + n) * (1 - p) / (1 + p)`` values: a similar pair is never refused.
    """
    other = reduce(Column.__add__, [F.bit_count(F.col(f"{x}{k}").bitwiseXOR(F.col(f"{y}{k}"))) for k in range(words_)])
    return other * (100 + percent) <= (m + n) * (100 - percent)
