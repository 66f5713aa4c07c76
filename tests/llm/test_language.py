import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from yardbook.llm import language, queries
from yardbook.llm.common import mix, text_slices

WORDS = {"aa": ["tak", "kat", "takka"], "bb": ["olo", "lool", "oolo"], "cc": ["issi", "sis", "iss"]}


def text_in(lang, n=30):
    return " ".join(WORDS[lang][i % 3] for i in range(n))


def plain_grams(text):
    """Places of a text's n-grams, one at a time."""
    body = b" " + bytes(language._PLAIN[b] for b in text.encode()) + b" "
    out = []
    for n in language.ORDERS:
        for i in range(len(body) - n + 1):
            gram = body[i : i + n]
            if b" " not in gram[1:-1] and gram != b"  ":
                code = np.array([int.from_bytes(gram, "big") + (n << 40)], np.uint64)
                out.append(int(mix(code)[0] % np.uint64(language.DIMENSIONS)))
    return Counter(out)


def test_grams_of_several_texts():
    texts = ["Ab c", "", "  x--y  ", "Größe 7 Öl", "a", "—", "word " * 50]
    for _, _, data, ends in text_slices(pa.array(texts)):
        place, owner = language._grams(data, ends)
    for i, text in enumerate(texts):
        assert Counter(place[owner == i].tolist()) == plain_grams(text)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 30])
def test_codewords(n):
    codes = language.codewords(n)
    assert len(codes) == n and set(np.unique(codes)) <= {-1, 1}
    if n > 1:
        assert all(len(set(bit)) == 2 for bit in codes.T)
        assert len({tuple(b * b[0]) for b in codes.T}) == codes.shape[1]
        apart = min((codes[i] != codes[j]).sum() for i in range(n) for j in range(i))
        assert apart >= {2: 1, 3: 2, 4: 4, 5: 8}.get(n, codes.shape[1] // 4)


def test_a_wrong_bit_is_corrected_and_a_draw_is_ambiguous():
    codes = language.codewords(4)
    model = language.Model(list("abcd"), codes, np.zeros((1, 7)), np.ones(7))
    margins = codes[2] * 3.0
    margins[4] *= -1
    nearest, score, ahead = model.decode(margins[None])
    assert nearest[0] == 2 and ahead[0] > 0 and 0.5 < score[0] < 1
    nearest, score, ahead = model.decode(np.zeros((1, 7)))
    assert nearest[0] == 0 and score[0] == pytest.approx(0.25) and ahead[0] == 0


def test_bits_weigh_by_their_worth():
    codes = language.codewords(3)
    margins = np.where(np.arange(3) == 0, -codes[1], codes[1])[None] * 2.0
    sound = language.Model(list("abc"), codes, np.zeros((1, 3)), np.array([0.05, 1.0, 1.0]))
    assert sound.decode(margins)[0][0] == 1


def test_held_out_accuracy_of_the_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.QUERIES["op13_language_id"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert all(0 <= r.score <= 1 and (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", docs[r.doc_id].text or "")) for r in found)
    held = [r for r in found if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) > 0.98 * len(held) > 100
    again = queries.QUERIES["op13_language_id"](spark, sf_dir).collect()
    assert sorted(again, key=lambda r: r.doc_id) == sorted(found, key=lambda r: r.doc_id)


def test_edges(spark, docs_frame):
    rows = [(i, text_in(lang, 3 + i), lang) for i in range(20) for lang in WORDS]
    labelled = spark.createDataFrame([(lang, text) for _, text, lang in rows] + [(None, "olo olo"), ("dd", None), ("ee", "12")], "lang string, text string")
    asked = [(1, "TAKKA tak kat"), (2, None), (3, ""), (4, "12 -- 7\n"), (None, "olo lool oolo"), (6, "issi sis " * 200_000), (6, "issi sis " * 200_000)]
    docs = docs_frame(asked).withColumns({"letter": F.lit(1), "score": F.lit("x"), "lang_pred": F.lit(None)})
    found = sorted(((r.doc_id or 0, r.lang_pred, r.score, r.ambiguous) for r in language.languages(docs, labelled).collect()))
    assert [(i, lang) for i, lang, _, _ in found] == [(0, "bb"), (1, "aa"), (2, "und"), (3, "und"), (4, "und"), (6, "cc"), (6, "cc")]
    assert [score for _, lang, score, _ in found if lang == "und"] == [0.0] * 3
    assert all(score > 0.6 and not ambiguous for _, lang, score, ambiguous in found if lang != "und")
    assert language.languages(docs.where("false"), labelled).collect() == []
    nothing = language.languages(docs, labelled.where("lang is null")).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    one = language.languages(docs, labelled.where("lang = 'aa'")).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("und", 0.0), ("aa", 1.0)}


def test_equal_texts_are_learnt_once(spark):
    labelled = spark.createDataFrame([("aa", "tak kat")] * 50 + [("bb", text_in("bb", 5))] * 3 + [("aa", text_in("aa"))], "lang string, text string")
    model = language.train(labelled, sample=8)
    assert model.languages == ["aa", "bb"]
