import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from yardbook.llm import queries
from yardbook.llm.token_counts import (
    FREE, Counter, character_classes, compose_prefixes, count_tokens, load_byte_bpe, pretoken_starts, symbols, token_counts,
)

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.fixture(scope="module")
def compiled():
    vocabulary, merges, special = load_byte_bpe(PATH)
    return Counter(vocabulary, merges, most=2_000), character_classes(), special


def test_random_texts_match_the_library(library, compiled):
    rng = random.Random(5)
    signs = [chr(c) for c in range(32, 127)] + list(" \n\t\r\x0b\x0c\x85\xa0\u3000'éßñ一가ⅷ½٣😀\u200d\u0301\ufeff")
    signs += ["'s", "'re", "'ll", " '", "<|endoftext|>"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(500)]
    texts += ["", None, "a" * 5000, " " * 3000, "-" * 700, "ab " * 900_000, "'", "it's'll", "\n\n \n x", "<|endoftext|>"]
    assert count_tokens(pa.array(texts), *compiled).tolist() == library(texts)


def test_scan_equals_one_state_at_a_time(compiled):
    from yardbook.llm.token_counts import _NEXT, _STARTS
    import numpy as np

    rng = random.Random(1)
    text = "".join(rng.choices("ab1 '\n.", k=5000))
    symbol = symbols(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([1700, 5000]), compiled[1])
    state, starts = FREE, []
    for i, s in enumerate(symbol):
        if _STARTS[s, state]:
            starts.append(i)
        state = _NEXT[s, state]
    assert pretoken_starts(symbol).tolist() == starts
    maps = np.array([rng.choices(range(8), k=8) for _ in range(37)], np.int8)
    want = np.arange(8)
    for i, m in enumerate(maps):
        want = m[want]
        assert compose_prefixes(maps)[i].tolist() == want.tolist()


def test_query_matches_the_library(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: n for r, n in zip(rows, library([r.text for r in rows]))}
    got = queries.count_tokens(spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    sizes = {r.doc_id: len(r.text.encode()) for r in rows}
    assert all(r.n_bytes == sizes[r.doc_id] and r.over_limit == (r.n_tokens > 1024) for r in got)


def test_nulls_repeats_and_empty_tables(docs_frame):
    got = token_counts(docs_frame([(None, None), (1, ""), (1, "a b"), (1, "a b")]), PATH, limit=1)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == sorted(
        [(None, 0, 0, False), (1, 0, 0, False), (1, 3, 2, True), (1, 3, 2, True)], key=repr
    )
    assert token_counts(docs_frame([]), PATH).count() == 0
