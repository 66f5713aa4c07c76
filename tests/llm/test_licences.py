import re

import pytest
from pyspark.sql import functions as F

from yardbook.llm import licences, queries


def bigrams(text):
    w = re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()
    return {*zip(w, w[1:])}


def held(line):
    """Families with a template of which the line holds at least 0.6, by hand."""
    own = bigrams(line)
    return {f for f, t in licences.TEMPLATES if len(bigrams(t) & own) >= 0.6 * len(bigrams(t))}


def test_families_and_unknown(docs_frame):
    rows = [(i, f"Plain words before.\n{t}. And some words after it\nlast") for i, (_, t) in enumerate(licences.TEMPLATES)]
    plain = ["This work is about the general public", "Permission is rarely granted", "the terms of the sale", "under the table", "", None, "one"]
    rows += [(100 + i, t) for i, t in enumerate(plain)] + [(200, "words and more words " * 50_000 + licences.TEMPLATES[0][1].upper())]
    frame = docs_frame(rows + rows[:2]).withColumns({"line": F.lit(7), "family": F.lit("x"), "print": F.lit(1)})
    got = licences.notices(frame).collect()
    found = {(r.doc_id, r.line): r.family for r in got}
    assert found == {(i, 1): f for i, (f, _) in enumerate(licences.TEMPLATES)} | {(200, 0): "Apache-2.0"}
    assert all(0 <= r.unknown < r.probability <= 1 and r.similarity >= 0.6 for r in got) and len(got) == len(found)


def test_empty_table_and_plan(spark, docs_frame):
    assert licences.notices(docs_frame([])).count() == 0
    plan = docs_frame([]).select(licences._bigrams(F.col("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_plain_search(spark, folder):
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        for i, line in enumerate((r.text or "").split("\n")):
            if re.search("licen[sc]e", line, re.I) and held(line):
                want.add((r.doc_id, i))
    got = {(r.doc_id, r.line): r.family for r in queries.license_scan(spark, folder).collect()}
    assert set(got) == want and want
