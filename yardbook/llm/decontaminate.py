"""Benchmark passages in documents: SimHash of item-sized windows, then exact similarity.

Only DataFrame functions are used. Words are split at ASCII white space, A-Z lower-cased; a shingle is
five words (a shorter item is one shingle).

*Where windows stand.* Windows of an item's size in a document all have the same number of shingles, so
their similarity grows only where a shingle that the item has comes in at the end. Of the best windows
the first therefore ends with a shared shingle or stands at the start of the document, and a window is
placed there for every occurrence of an item's shingle, in any order and at any distance. Left out are
only windows that hold fewer shared shingles than ``similarity`` needs. All documents are searched, whole.

*Fingerprints.* Windows and items get a 64-bit SimHash of their weighted shingles (weight: number of
occurrences). Fingerprints are cut into ``radius + 1`` blocks; fingerprints that differ in at most
``radius`` bits agree in one block at least, so a join on blocks finds all of them.

*Exact similarity.* Candidates are confirmed by the weighted Jaccard similarity of their shingles, the
sum of smaller weights over the sum of larger ones, at ``similarity`` or more. At 0.8 the fingerprints
of equal-sized windows differ in 10 bits on average with a deviation of 3; the default radius of 26
loses less than one in a million.

Defined results: null and empty texts and items match nothing; a document shorter than the item is
one window; rows repeated with identifier and text give one result; several windows of an item in one document give one
row, the best and then first; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, free_name, small, text_of

_BROADCAST_ROWS = 500_000


def _words(df: DataFrame, text: str) -> Column:
    lowered = F.translate(text_of(df, text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # Through a generator, so that the split is not written into every use of its result.
    return F.explode(F.array(F.split(F.trim(F.regexp_replace(lowered, f"[{SPACE}]+", " ")), " ")))


def _shingle_hashes(words: str, size: int) -> Column:
    """Hashes of the shingles of the array column, in order; empty if it has too few words."""
    each = F.transform(
        F.sequence(F.lit(0), F.size(words) - F.lit(size)), lambda i: F.xxhash64(*[F.get(F.col(words), i + F.lit(k)) for k in range(size)])
    )
    enough = (F.size(words) >= size) & (F.get(F.col(words), F.lit(0)) != "")
    return F.when(enough, each).otherwise(F.array().cast("array<bigint>"))


def _fingerprint(hash_: Column, weight: Column) -> list[Column]:
    """64 sums, one for each bit."""
    return [
        F.sum(F.when(F.shiftright(hash_, bit).bitwiseAND(F.lit(1)) == 1, weight).otherwise(-weight)).alias(f"bit{bit}")
        for bit in range(64)
    ]


def _packed() -> Column:
    """The fingerprint as one number: a bit is set where its sum is positive."""
    parts = [F.when(F.col(f"bit{bit}") > 0, F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(F.lit(0)) for bit in range(64)]
    out = parts[0].cast("bigint")
    for part in parts[1:]:
        out = out.bitwiseOR(part.cast("bigint"))
    return out


def _blocks(print_: Column, radius: int) -> Column:
    """Array of (block, its bits) structs."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("block"),
                F.shiftrightunsigned(print_, low).bitwiseAND(F.lit((1 << (high - low)) - 1)).alias("bits"),
            )
            for i, (low, high) in enumerate(zip(cuts, cuts[1:]))
        ]
    )


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    shingle: int = 5,
    similarity: float = 0.8,
    radius: int = 26,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
) -> DataFrame:
    """One row per document and item found in it: ``doc_id``, ``item_id``, ``start`` (word), ``n_words``,
    ``distance`` (bits), ``similarity`` and ``print`` (a hash of identifier and text)."""
    if not 0 <= radius <= 63:
        raise ValueError("radius must be between 0 and 63")
    items = benchmark.select(benchmark[item_id].alias("item"), _words(benchmark, item_text).alias("words"))
    items = items.withColumns({"length": F.size("words"), "k": F.least(F.size("words"), F.lit(shingle)), "number": F.xxhash64("item", "words")})
    items = cut(items.where("words[0] <> ''"))
    sizes = sorted(r.k for r in items.select("k").distinct().collect())  # at most `shingle` numbers
    found = None
    for k in sizes:
        part = _leaks_of_size(docs, items.where(F.col("k") == k), k, similarity, radius, text, doc_id)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = _leaks_of_size(docs.limit(0), items, shingle, similarity, radius, text, doc_id)
    best = found.groupBy("doc_id", "print", "item_id", "number").agg(
        F.max(F.struct("similarity", -F.col("start"), "n_words", -F.col("distance"))).alias("b")
    )
    return best.select(
        "doc_id", "item_id", (-F.col("b.col2")).alias("start"), F.col("b.n_words").alias("n_words"),
        (-F.col("b.col4")).alias("distance"), F.col("b.similarity").alias("similarity"), "print",
    )


def _document_print(docs: DataFrame, text: str, doc_id: str) -> Column:
    return F.xxhash64(docs[doc_id], F.lit("|"), docs[text].cast("string"))


def _leaks_of_size(
    docs: DataFrame, items: DataFrame, k: int, similarity: float, radius: int, text: str, doc_id: str
) -> DataFrame:
    shingled = docs.select(docs[doc_id].alias("doc_id"), _document_print(docs, text, doc_id).alias("print"), _words(docs, text).alias("words"))
    shingled = shingled.select("doc_id", "print", F.size("words").alias("n"), _shingle_hashes("words", k).alias("hashes"))
    item_rows = items.select(
        "item", "number", "length", F.posexplode(_shingle_hashes("words", k)).alias("at", "hash")
    )
    # Occurrences of item shingles place the windows that end with them.
    places = shingled.select("doc_id", "print", "n", F.posexplode("hashes").alias("pos", "hash"))
    met = places.join(small(item_rows.select("number", "length", "hash").distinct(), _BROADCAST_ROWS), "hash")
    met = met.groupBy("doc_id", "print", "n", "number", "length").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    last = F.col("length") - k
    totals = F.least("length", "n") + F.col("length") - 2 * (k - 1)
    least = F.greatest(F.lit(1), F.ceil(totals * (similarity / (1 + similarity)) - 1e-6)).cast("int")
    met = met.withColumns({"last": last, "least": least}).where(F.size("places") >= F.col("least"))

    def enough(pos: Column, i: Column) -> Column:
        before = F.get("places", i - F.col("least") + 1) >= pos - F.col("last")
        return F.when(pos >= F.col("last"), before).otherwise(F.get("places", F.col("least") - 1) <= F.col("last"))

    starts = F.transform(F.filter("places", enough), lambda pos: F.greatest(F.lit(0), pos - F.col("last")))
    windows = cut(met.select("doc_id", "print", "number", "length", F.explode(F.array_distinct(starts)).alias("start")))
    # The shingles of each window, from the documents that have one.
    wanted = small(windows.select("doc_id", "print").distinct(), _BROADCAST_ROWS).alias("w")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.print") == F.col("w.print"))
    hit = cut(shingled.alias("d").join(wanted, same, "left_semi").dropDuplicates(["doc_id", "print"]))
    again = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.print") == F.col("w.print"))
    shingles = (
        windows.alias("w")
        .join(hit.alias("d"), again)
        .select(
            "w.doc_id", "w.print", "w.number", "w.start", "w.length",
            F.least(F.col("w.length"), F.col("d.n")).alias("n_words"),
            F.explode(F.slice("d.hashes", F.col("w.start") + 1, F.col("w.length") - k + 1)).alias("hash"),
        )
    )
    window = ["doc_id", "print", "number", "start", "length", "n_words"]
    weighted = cut(shingles.groupBy(*window, "hash").agg(F.count("*").alias("weight")))
    windows = weighted.groupBy(*window).agg(*_fingerprint(F.col("hash"), F.col("weight")), F.sum("weight").alias("total"))
    windows = cut(windows.select(*window, "total", _packed().alias("window_print")))
    item_weights = item_rows.groupBy("number", "hash").agg(F.count("*").alias("item_weight"))
    item_prints = item_weights.groupBy("number").agg(
        *_fingerprint(F.col("hash"), F.col("item_weight")), F.sum("item_weight").alias("item_total")
    )
    item_prints = cut(item_prints.select("number", "item_total", _packed().alias("item_print")))
    # Multi-index: windows of an item meet it in every block they agree in.
    left = windows.withColumn("b", F.explode(_blocks(F.col("window_print"), radius)))
    right = item_prints.withColumn("b", F.explode(_blocks(F.col("item_print"), radius)))
    near = left.join(right, ["number", "b"]).withColumn("distance", F.bit_count(F.col("window_print").bitwiseXOR(F.col("item_print"))))
    near = near.where(F.col("distance") <= radius).select(*window, "total", "item_total", "distance").distinct()
    # Exact weighted similarity of the candidates.
    overlap = weighted.join(item_weights, ["number", "hash"]).groupBy(*window).agg(F.sum(F.least("weight", "item_weight")).alias("common"))
    n, o = near.alias("n"), overlap.alias("o")
    equal = F.col("n.doc_id").eqNullSafe(F.col("o.doc_id"))
    for name in window[1:]:
        equal &= F.col(f"n.{name}") == F.col(f"o.{name}")
    ratio = F.col("o.common") / (F.col("n.total") + F.col("n.item_total") - F.col("o.common"))
    close = n.join(o, equal).withColumn("similarity", ratio).where(F.col("similarity") >= similarity)
    named = items.select("number", F.col("item").alias("item_id")).dropDuplicates(["number"])
    return close.select("n.doc_id", "n.print", "n.number", "n.start", "n.n_words", "distance", "similarity").join(named, "number")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents in which no item is found; columns stay as they are."""
    mark = free_name(docs, "_print")
    found = leaks(docs, benchmark, text=text, doc_id=doc_id, **options).select(F.col("print").alias(mark)).distinct()
    found = small(cut(found), _BROADCAST_ROWS)
    marked = docs.withColumn(mark, _document_print(docs, text, doc_id))
    return marked.join(found, mark, "left_anti").drop(mark)
