import random
from collections import Counter
from itertools import accumulate

from brute import WORD, lower
from pyspark.sql import functions as F

from yardbook.llm import decontaminate, queries


def expected(docs, items, n=5, least=0.8):
    """Best similarity of every window of the item's size, by hand."""
    out = {}
    for d, text in docs:
        w = WORD.findall(lower(text))
        for i, passage in items:
            p = WORD.findall(lower(passage))
            k = min(n, len(p))
            if not p or len(w) < k:
                continue
            want = Counter(tuple(p[x : x + k]) for x in range(len(p) - k + 1))
            shared = [tuple(w[x : x + k]) in want for x in range(len(w) - k + 1)]
            sums = [0, *accumulate(shared)]
            for s in range(max(1, len(w) - len(p) + 1)):
                own = w[s : s + len(p)]
                if sums[s + len(own) - k + 1] - sums[s] < least * (len(p) - k + 1):
                    continue
                have = Counter(tuple(own[x : x + k]) for x in range(len(own) - k + 1))
                close = sum((want & have).values()) / sum((want | have).values())
                if close >= least:
                    out[d, i] = max(out.get((d, i), 0), close)
    return out


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_all_windows_are_found(spark, docs_frame):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(8, 60)))) for i in range(12)]
    items += [(50, "Only three words"), (51, ""), (52, None), (53, "the the the the the the the the the the")]
    docs = []
    for d in range(160):
        words = rng.choices(vocabulary, k=rng.randrange(0, 120))
        own = rng.choice(items[:12])[1].split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(2))
        at = rng.randrange(len(words) + 1)
        docs.append((d, " ".join(words[:at] + [x.upper() if d % 3 else x for x in own] + words[at:])))
    docs += [(900, None), (901, ""), (902, "only\tTHREE  words"), (903, "the " * 4_000), (904, items[0][1]), (904, items[0][1])]
    got = decontaminate.leaks(docs_frame(docs), bench(spark, items)).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {
        k: round(v, 9) for k, v in expected(docs, items).items()
    }
    assert all(0 <= r.distance <= 26 for r in got) and len(got) > 40


def test_reordered_and_two_ended_edits_are_found(spark, docs_frame):
    rng = random.Random(4)

    def fresh(n):
        return [f"u{rng.randrange(10**6)}" for _ in range(n)]

    items, docs = [], []
    for i in range(6):
        own = fresh(60)
        items.append((i, " ".join(own)))
        at = rng.randrange(20, 41)
        swapped = own[at:] + own[:at]
        ends = own[2:30] + fresh(rng.randrange(1, 3)) + own[30:-2]
        for words in (swapped, own[20:40] + own[:20] + own[40:], ends, own[3:-3], own[:25] + own[26:]):
            docs.append((len(docs), " ".join(fresh(40) + words + fresh(40))))
            docs.append((len(docs), " ".join(words + fresh(9))))
    got = decontaminate.leaks(docs_frame(docs), bench(spark, items)).collect()
    want = expected(docs, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert (0, 0) in want and len(want) > 30


def test_main_path_has_no_python(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    words = docs.select(decontaminate._words(docs, "text").alias("words"))
    plan = words.select(decontaminate._shingle_hashes("words", 5))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert items.count() > 0


def test_clean_documents_stay(spark, docs_frame):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, passage), (2, "before " + passage + " after"), (3, "clean words"), (3, "clean words"), (None, passage), (None, None)]
    frame = docs_frame(rows).withColumns({"print": F.lit(1), "words": F.lit("x"), "_print": F.lit(2)})
    kept = decontaminate.without_leaks(frame, bench(spark, [(7, passage)]))
    assert kept.columns == frame.columns
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == [3, 3, None]


def test_empty_tables(spark, docs_frame):
    docs = docs_frame([(1, "a b c d e f")])
    assert decontaminate.leaks(docs, bench(spark, [])).count() == 0
    assert decontaminate.without_leaks(docs, bench(spark, [])).count() == 1
    assert decontaminate.leaks(docs_frame([]), bench(spark, [(1, "a b c d e f")])).count() == 0


def test_query_matches_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.decontamination(spark, sf_dir).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(expected(docs, items))
