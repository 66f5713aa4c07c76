"""The operators over the test tables with production parameters, and SQL for those it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import content_sort, decontaminate, html_blocks, language, lexical, licences, minhash, mixing, paragraphs, quality, token_counts, toxicity, vector_codes
from .common import read_table


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = content_sort.exact_groups(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_groups(read_table(spark, sf_dir, "documents"), words_per_shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.words_in(docs).alias("words"))
    mixed = mixing.mix(sized, size=sized["words"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("print")


def quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = quality.ratings(read_table(spark, sf_dir, "labels"))
    return quality.scored(read_table(spark, sf_dir, "documents"), labels)


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    def held_out(frame: DataFrame):
        return F.crc32(F.coalesce(frame["doc_id"].cast("string"), F.lit(""))) % 5 == 0

    labels = read_table(spark, sf_dir, "labels")
    found = toxicity.toxicity(read_table(spark, sf_dir, "documents"), labels.where(~held_out(labels)).select("doc_id", "toxic"))
    return found.select("doc_id", held_out(found).alias("held_out"), "score", "predicted")


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_text(read_table(spark, sf_dir, "pages"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(read_table(spark, sf_dir, "documents"), join_lines=True)


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.notices(read_table(spark, sf_dir, "documents"))


def compressed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.vector_codes(read_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    found = vector_codes.with_label_error(coded).withColumn("codebooks_sha256", F.lit(vector_codes.digest(books)))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def detected_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def held_out(frame: DataFrame):
        return F.crc32(F.coalesce(frame["doc_id"].cast("string"), F.lit(""))) % 4 == 2

    docs = read_table(spark, sf_dir, "documents")
    found = language.languages(docs, docs.where(~held_out(docs)).select("lang", "text"))
    return found.select("doc_id", held_out(found).alias("held_out"), "lang_pred", "score", "ambiguous")


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {
    "op11_lexical_search": lexical_search,
    "op13_language_id": detected_languages,
    "op12_vector_codes": compressed_vectors,
    "op7_license_scan": license_scan,
    "op4_substring_dedup": substring_dedup,
    "op9_html_extraction": html_extraction,
    "op2_toxicity": toxicity_scores,
    "op5_quality_classifier": quality_grades,
    "op10_benchmark_decontamination": decontamination,
    "op1_minhash_near_dedup": near_dedup,
    "op3_mix_sources": mix_sources,
    "op6_token_counts": count_tokens,
    "op8_exact_dedup": exact_dedup,
}

def _vector_codes_sql(rounds: int = 2) -> str:
    """Plain k-means on whole numbers: every part against every entry."""
    steps = [
        """kept AS (
            SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS nr,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pieces AS (
            SELECT nr, p, unnest(v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16]) AS x,
                   generate_subscripts(v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16], 1) AS k
            FROM kept, range(16) t(p)),
        book0 AS (SELECT p, nr - 1 AS entry, k, x AS c FROM pieces WHERE nr <= 64)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""
        away{r} AS (
            SELECT nr, p, entry, sum((x - c) * (x - c)) AS d FROM pieces JOIN book{r} USING (p, k) GROUP BY ALL),
        own{r} AS MATERIALIZED (
            SELECT nr, p, min(d) AS d, arg_min(entry, d * 64 + entry) AS entry FROM away{r} GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
        mean{r} AS (
            SELECT p, entry, k, floor(sum(x)::DECIMAL(38, 6) / count(*))::BIGINT AS c FROM pieces JOIN own{r} USING (nr, p) GROUP BY ALL),
        book{r + 1} AS MATERIALIZED (
            SELECT p, entry, k, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (p, entry, k))""")
    return f"""
        WITH {",".join(steps)},
        coded AS (
            SELECT nr, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
            FROM own{rounds} GROUP BY nr)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, entry, k)) FROM book{rounds}) AS codebooks_sha256
        FROM kept JOIN coded USING (nr)"""


ORACLE_SQL = {
    "op11_lexical_search": r"""
        WITH docs AS (
            SELECT doc_id, row_number() OVER () AS d,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        items AS (
            SELECT item_id, row_number() OVER () AS i,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM benchmark),
        wanted AS (SELECT i, term, count(*) AS q FROM (SELECT i, unnest(terms) AS term FROM items) GROUP BY ALL),
        counts AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY ALL),
        totals AS (SELECT count(*) AS docs_n, sum(len(terms))::BIGINT AS terms_n FROM docs WHERE len(terms) > 0),
        weighed AS (
            SELECT term, floor(1000 * ln((2 * any_value(docs_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM counts, totals GROUP BY term),
        lengths AS (SELECT d, doc_id, 25 + (75 * len(terms) * docs_n) // terms_n AS m FROM docs, totals WHERE len(terms) > 0),
        scores AS (
            SELECT i, d, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
            FROM wanted JOIN counts USING (term) JOIN weighed USING (term) JOIN lengths USING (d) GROUP BY ALL),
        placed AS (
            SELECT item_id, doc_id, score,
                   row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
            FROM scores JOIN items USING (i) JOIN docs USING (d) WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10""",
    "op12_vector_codes": _vector_codes_sql(),
    "op8_exact_dedup": r"""
        WITH texts AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
            FROM documents),
        grouped AS (
            SELECT doc_id, body,
                   first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
                   row_number() OVER (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST) AS place,
                   count(*) OVER (PARTITION BY body) AS group_size
            FROM texts)
        SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, place = 1) AS kept,
               sha256(body) AS text_sha256
        FROM grouped""",
}
