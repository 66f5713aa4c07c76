import re

from brute import near_links, shingle_set, smallest_reachable

import corpus_pipeline
from yardbook.llm import mixing, quality

from test_decontaminate import expected


def test_every_stage_against_plain_code(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, items = docs.columns, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage_input, before = docs, {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id for r in docs.collect()}
        sizes.append(len(after))
        assert docs.columns == columns or k == 4
        if name == "quality_classifier":
            graded = quality.scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), quality.ratings(spark.read.parquet(f"{sf_dir}/labels.parquet")))
            assert after == {r.doc_id for r in graded.collect() if r.keeps}
            right = [(i in after) == bool(q) for i, q in labels.items()]
            assert sum(right) / len(right) > 0.95
        elif name == "exact_dedup":
            best = {}
            for i, t in before.items():
                body = re.sub(r"[\x20\x09-\x0D]", "", t or "")
                best[body] = min(best.get(body, (1, 0)), (-len(t or ""), i))
            assert after == {i for _, i in best.values()}
        elif name == "minhash_near_dedup":
            sets = {i: shingle_set(t, 5) for i, t in before.items()}
            found = smallest_reachable(sets, near_links(sets))
            assert after == {i for i, c in found.items() if i == c}
        elif name == "benchmark_decontamination":
            assert after == set(before) - {d for d, _ in expected(before.items(), items)}
        else:
            mixed = {r.doc_id: r for r in mixing.mix(stage_input).collect()}
            assert after == {i for i, r in mixed.items() if r.copies > 0} < set(before) | {None}
            assert all(r.text == before[r.doc_id] and 0 <= r.taken == r.copies * r.size <= 2 * r.size for r in docs.collect())
    assert sizes[0] < 200 and sizes == sorted(sizes, reverse=True)


def test_run_gives_the_same_documents(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "source", "target", "taken"} <= set(got.columns) and got.count() > 50
    assert corpus_pipeline.run(spark, sf_dir).agg({"taken": "sum"}).first()[0] == got.agg({"taken": "sum"}).first()[0]


def test_near_copies_do_not_depend_on_file_splits(spark, tmp_path, docs_frame):
    rows = [(d, " ".join(f"w{d // 3}x{i}" for i in range(20 + d % 7))) for d in range(48)]
    docs_frame(rows).repartition(8, "doc_id").write.parquet(f"{tmp_path}/docs")
    sets = {d: shingle_set(text, 5) for d, text in rows}
    want = {d for d, first in smallest_reachable(sets, near_links(sets)).items() if d == first}
    setting, cores = "spark.sql.files.minPartitionNum", (1, 64)  # as if the number of cores changed
    try:
        spark.conf.set(setting, cores[0])
        docs = spark.read.parquet(f"{tmp_path}/docs")
        few = docs.rdd.getNumPartitions()
        kept = corpus_pipeline.without_near_copies(spark, docs, "")
        spark.conf.set(setting, cores[1])
        assert few < spark.read.parquet(f"{tmp_path}/docs").rdd.getNumPartitions()
        assert {r.doc_id for r in kept.collect()} == want and len(want) < 48
    finally:
        spark.conf.unset(setting)


def test_odd_rows_pass_all_stages(spark, tmp_path, sf_dir, docs_frame):
    """Nulls in any column, repeated rows, extra columns and an empty table."""
    from pyspark.sql import functions as F

    first = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = docs_frame([(None, None), (None, "a b c"), (9001, None), (9002, ""), (9002, ""), (9003, "word " * 50_000)])
    docs = first.unionByName(odd).unionByName(odd).withColumns({c: F.lit("x") for c in ("size", "_row", "at", "copies")})
    for name, rows in (("some", docs), ("none", docs.where("false"))):
        folder = f"{tmp_path}/{name}"
        rows.write.parquet(f"{folder}/documents.parquet")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").write.parquet(f"{folder}/{table}.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert bool(got) == (name == "some") and all(r.copies > 0 for r in got)


def test_no_stage_stores_the_texts_beside_its_input(spark, sf_dir, tmp_path, monkeypatch):
    """Stored copies of all texts stayed on disk through the later stages."""
    from yardbook.llm.common import Scratch

    stored, store = [], Scratch.store
    monkeypatch.setattr(Scratch, "store", lambda self, df, name: stored.append((name, df.columns)) or store(self, df, name))
    for k in (1, 2, 4):
        name, stage = corpus_pipeline.STAGES[k]
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        assert spark.read.parquet(f"{tmp_path}/{name}").columns[: len(docs.columns)] == docs.columns
    assert stored and not [name for name, columns in stored if "text" in columns]


def test_rows_of_files_keep_their_numbers(spark, tmp_path, docs_frame):
    from yardbook.llm.common import file_rows

    docs_frame([(1, "same")] * 500 + [(d, f"t{d}") for d in range(500)]).repartition(5).write.parquet(f"{tmp_path}/docs")
    setting, passes = "spark.sql.files.minPartitionNum", []
    try:
        for cores in (1, 64):  # as if the files were split in another way
            spark.conf.set(setting, cores)
            rows, key = file_rows(spark.read.parquet(f"{tmp_path}/docs"))
            passes.append(sorted((r[key], r.doc_id, r.text) for r in rows.collect()))
    finally:
        spark.conf.unset(setting)
    assert passes[0] == passes[1] and len({k for k, *_ in passes[0]}) == 1000
    rows, key = file_rows(docs_frame([(1, "same")] * 20, 3))  # not from files: stored with numbers
    assert len({r[key] for r in rows.collect()}) == 20
