import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from yardbook.llm import lexical, queries

from brute import lower

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k):
    """The ranking word for word: (item, rank, doc, score)."""
    texts = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    texts = [(i, c) for i, c in texts if c]
    n_docs, n_terms = len(texts), sum(sum(c.values()) for _, c in texts)
    holders = Counter(term for _, c in texts for term in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in texts:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for term in TERM.findall(lower(text)):
                if c[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[term] + 1)))
                    score += w * ((1000000000 * c[term]) // (1000 * c[term] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, place, doc, -score) for place, (score, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def rows(frame):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=key)


def test_query_agrees_with_the_rule(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = queries.QUERIES["op11_lexical_search"](spark, sf_dir)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(found) == sorted(plain(docs, items, 10), key=key)


ITEMS = [(1, "One two, TWO thrée 4"), (2, None), (3, "..."), (None, "two"), (5, "absent words"), (5, "one"), (6, "rare " * 3000)]


@pytest.fixture(scope="module")
def small_tables(spark, docs_frame):
    random = np.random.default_rng(1)
    vocabulary = ["one", "two", "thrée", "4", "Four", "five-six", "x_y", "rare\x00", " ", "漢字"]
    docs = [(int(i) // 2, " ".join(random.choice(vocabulary, random.integers(0, 30)))) for i in range(80)]
    docs += [(200 + i, "two one two") for i in range(30)]  # ties
    docs += [(None, "two one two"), (7, None), (8, "?! \n"), (9, "one " * 100_000), (9, "rare")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({"nr": F.lit("a"), "doc_id": F.lit(5), "block": F.lit(None)})
    return docs, docs_frame(docs, 5).withColumns({"score": F.lit("x"), "rank": F.lit(1), "id": F.lit(None), "at": F.lit(2)}), items


@pytest.mark.parametrize("k", [1, 10, 200])
def test_ties_nulls_repeats_and_long_texts(small_tables, k):
    docs, frame, items = small_tables
    assert rows(lexical.ranked(frame, items, k)) == sorted(plain(docs, ITEMS, k), key=key)


def test_small_tiles_and_blocks_give_the_same(spark, small_tables, monkeypatch):
    docs, frame, items = small_tables
    for name, value in (("CELLS", 12), ("ITEMS", 2), ("DOCUMENTS", 3)):
        monkeypatch.setattr(lexical, name, value)
    blocks = lexical._item_blocks(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).coalesce(1)).collect()
    assert len({r["block"] for r in blocks}) > 1
    assert rows(lexical.ranked(frame, items, 3)) == sorted(plain(docs, ITEMS, 3), key=key)


def test_vocabulary_tiles_stay_below_the_bound():
    matrix = np.random.default_rng(2).integers(0, 50, (4, 37))
    matrix[1, 5] = 10_000
    tiles = lexical.vocabulary_tiles(matrix, columns=8, most=300)
    assert all(tile.sum(axis=1).max() <= 300 and after - first <= 8 for first, after, tile in tiles)
    again = np.zeros_like(matrix)
    for first, after, tile in tiles:
        again[:, first:after] += tile.astype(int)
    assert (again == matrix).all()
    assert lexical.impacts(np.array([10**9]), np.array([1]), 1, 1).max() < lexical.IMPACT
    assert (2**53 // lexical.IMPACT) * lexical.IMPACT <= 2**53


def test_impacts_do_not_overflow():
    n, documents, length = 10**9, 10**12, 10**15
    m = 25 + 75 * n * documents // length
    assert lexical.impacts(np.array([7]), np.array([n]), documents, length)[0] == 7 * 10**9 // (7000 + 8 * m)


def test_empty_tables(small_tables):
    _, frame, items = small_tables
    assert lexical.ranked(frame.where("false"), items).collect() == []
    empty = lexical.ranked(frame, items.where("false"))
    assert empty.collect() == [] and empty.columns == ["item_id", "rank", "doc_id", "score"]
