import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from yardbook.llm import content_sort, queries

from compare import sql_connection

def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for body, members in groups.items():
        keep = min(members)[3]
        for m in members:
            out.append((m[3], keep, len(members), hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups_match_brute_force_and_span_partitions(docs_frame):
    rows = [(i, "a b" if i % 3 else "ab ") for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t\x0b"), (None, "solo"), (7, "ab"), (7, "ab"), (2000, "é x"), (2001, "éx ")]
    rows += [(3000, "long " * 50_000), (3001, "long" * 50_000)]
    got = content_sort.exact_groups(docs_frame(rows), partitions=16)
    stored = got.collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in stored], key=repr) == brute(rows)
    assert sum(r.stays for r in stored) == len({r.text_sha256 for r in stored})
    assert all(r.kept == (r.doc_id == r.keep_id) for r in stored if r.doc_id is not None)


def test_keep_first_keeps_one_whole_row_of_each_group(docs_frame):
    rows = [(1, "x y"), (1, "x y"), (2, "xy"), (None, "z"), (None, "z")]
    frame = docs_frame(rows).withColumn("_row", F.lit("own")).withColumn("id", F.lit(9))
    kept = content_sort.keep_first(frame)
    assert kept.columns == frame.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == [(1, "x y"), (None, "z")]


def test_empty_table(docs_frame):
    assert content_sort.exact_groups(docs_frame([])).count() == 0
    assert content_sort.keep_first(docs_frame([])).count() == 0


def test_query_matches_sql(spark, sf_dir):
    got = queries.exact_dedup(spark, sf_dir)
    want = sql_connection(sf_dir).sql(queries.ORACLE_SQL["op8_exact_dedup"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
