import random

import numpy as np
from brute import WORD, lower, near_links, shingle_set, smallest_reachable

from yardbook.llm import paragraphs


def passages(rows, n=5, least=20):
    """Paragraphs of short lines, grouped by hand."""
    found = {}
    for d, text in rows:
        at = 0
        for line in (text or "").split("\n"):
            size = len(WORD.findall(line))
            if size >= least:
                found[d, at, at + size] = shingle_set(line, n)
            at += size
    group = smallest_reachable(found, near_links(found))
    counts = {g: list(group.values()).count(g) for g in group.values()}
    return {k: counts[g] for k, g in group.items() if counts[g] > 1}


def test_paragraphs_match_brute_force(docs_frame):
    rng = random.Random(6)
    pool = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 90))) for _ in range(12)]
    rows = []
    for d in range(120):
        lines = [" ".join(f"v{rng.randrange(9999)}" for _ in range(rng.randrange(1, 60))) for _ in range(3)]
        w = rng.choice(pool).split()
        for _ in range(rng.randrange(2)):
            w[rng.randrange(len(w))] = f"x{d}"
        lines.insert(rng.randrange(4), " ".join(w).upper() if d % 2 else "  ".join(w))
        rows.append((d, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, pool[0] + "\n" + pool[0])]
    got = paragraphs.repeated_paragraphs(docs_frame(rows)).collect()
    assert {(r.doc_id, r.first_word, r.after_word): r.copies for r in got} == passages(rows)
    kept = [r.passage_id for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.passage_id for r in got})


def test_passage_inside_long_lines_is_found(docs_frame):
    rng = random.Random(2)

    def text(n):
        return " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))

    passage = text(400)
    rows = [(d, f"{text(150)} {passage} {text(150)}") for d in range(4)] + [(9, text(900))]
    got = paragraphs.repeated_paragraphs(docs_frame(rows)).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3}
    assert sum(r.after_word - r.first_word for r in got if r.doc_id == 0) >= 200


def test_nulls_repeats_and_empty_tables(docs_frame):
    line = " ".join(f"w{i}" for i in range(30))
    got = paragraphs.repeated_paragraphs(docs_frame([(None, line), (3, line), (3, line)])).collect()
    assert sorted([(r.doc_id, r.copies, r.kept) for r in got], key=repr) == [(3, 3, False), (3, 3, True), (None, 3, False)]
    assert paragraphs.repeated_paragraphs(docs_frame([])).count() == 0
    assert len(np.unique(paragraphs._SEEDS)) == paragraphs.BANDS * paragraphs.ROWS and lower("A") == "a"


def test_passages_of_50_to_100_words_in_lines_of_every_length(docs_frame):
    rng = random.Random(11)

    def fresh(n):
        return [f"u{rng.randrange(10**6)}" for _ in range(n)]

    def lines(w, width):
        return "\n".join(" ".join(w[i : i + width]) for i in range(0, len(w), width))

    widths, rows, planted = [3, 13, 30, 90, 10**6], [], {}
    for size in (50, 55, 64, 77, 100):
        for _ in range(4):
            passage = fresh(size)
            for copy in range(3):
                before, width = rng.randrange(150), rng.choice(widths)
                planted[len(rows)] = (before, before + size, copy == 0)
                rows.append((len(rows), lines(fresh(before) + passage + fresh(rng.randrange(150)), width)))
    got = paragraphs.repeated_paragraphs(docs_frame(rows)).collect()
    for d, (first, after, stays) in planted.items():
        found = {w for r in got if r.doc_id == d for w in range(r.first_word, r.after_word)}
        gone = {w for r in got if r.doc_id == d and not r.kept for w in range(r.first_word, r.after_word)}
        assert found == set(range(first, after)) and gone == (set() if stays else found), d


def test_overlapping_runs_and_equal_rows(docs_frame):
    x, y, z = ([f"{k}{i}" for i in range(60)] for k in "xyz")
    rows = [(1, " ".join(x + y)), (2, " ".join(["a"] + y + z)), (3, "\n".join(x + y)), (4, "\n".join(y + z)), (4, "\n".join(y + z))]
    rows += [(5, " ".join(["the"] * 300)), (6, "\n".join(x[:49]))]
    got = paragraphs.repeated_paragraphs(docs_frame(rows)).collect()
    left = {}
    for d, text in dict(rows).items():
        gone = {w for r in got if r.doc_id == d and not r.kept for w in range(r.first_word, r.after_word)}
        left[d] = [w for i, w in enumerate(text.split()) if i not in gone]
    assert left[1] == x + y and set(left[2]) == {"a", *z} and left[3] == left[4] == [] and left[6] == x[:49]
    assert 0 < len(left[5]) < 100
    assert len([r for r in got if r.doc_id == 4]) % 2 == 0


def test_rows_without_or_with_one_identifier_are_told_apart(docs_frame):
    rng = random.Random(8)
    line = " ".join(f"w{i}" for i in range(30))
    run = " ".join(f"r{i}" for i in range(60))
    for ids in ((None, None, None), (5, 5, 5)):
        rows = [(i, f"{' '.join(f'x{rng.randrange(10**6)}' for _ in range(7))} {k}\n{line}\na {k} b {run} c") for k, i in enumerate(ids)]
        got = paragraphs.repeated_paragraphs(docs_frame(rows)).collect()
        assert len([r for r in got if r.kept and r.after_word - r.first_word == 30]) == 1
        assert len([r for r in got if r.after_word - r.first_word == 30]) == 3
        assert len([r for r in got if r.kept]) == 2 and len(got) == 6


def test_wrapped_edited_paragraphs_meet_whatever_their_lines(docs_frame):
    rng = random.Random(4)

    def wrapped(w, width):
        return "\n".join(" ".join(w[i : i + width]) for i in range(0, len(w), width))

    rows = []
    for k in range(6):
        w = [f"u{k}_{rng.randrange(10**6)}" for _ in range(95)]
        changed = list(w)
        changed[40] = "other"
        rows += [(2 * k, wrapped(w, 13)), (2 * k + 1, wrapped(changed, 9))]
    got = paragraphs.repeated_paragraphs(docs_frame(rows), least_run=10**6, join_lines=True).collect()
    assert sorted((r.doc_id, r.first_word, r.after_word, r.kept) for r in got) == [(d, 0, 95, d % 2 == 0) for d in range(12)]


def test_very_long_and_constant_texts(docs_frame):
    rng = random.Random(5)
    long = [f"u{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["x"] * 40_000)), (3, " ".join(long[20_000:20_200])), (4, "y" * 300_000)]
    got = paragraphs.repeated_paragraphs(docs_frame(rows)).collect()
    gone = sum(r.after_word - r.first_word for r in got if r.doc_id == 3 and not r.kept)
    assert gone == 200 and not [r for r in got if r.doc_id == 1 and not r.kept]


def test_extra_columns_with_clashing_names(docs_frame):
    from pyspark.sql import functions as F

    line = " ".join(f"w{i}" for i in range(30))
    docs = docs_frame([(1, line), (2, line)]).withColumns({c: F.lit("x") for c in ("id", "row", "print", "at", "asked", "first", "bands")})
    assert sorted((r.doc_id, r.kept) for r in paragraphs.repeated_paragraphs(docs).collect()) == [(1, True), (2, False)]


def test_bands_are_those_of_single_paragraphs():
    import pyarrow as pa

    from yardbook.llm.common import text_slices

    rng = random.Random(3)
    texts = ["\n".join(" ".join(f"w{rng.randrange(200)}" for _ in range(rng.randrange(1, 160))) for _ in range(6)) for _ in range(20)]
    for _, _, data, ends in text_slices(pa.array(texts)):
        found = paragraphs._Slice(data, ends, 20)
        (bands, _, _), prints = found.bands(5), found.prints()
    assert len(found.text) > 40 and (found.after - found.first >= 20).all()
    for k in range(len(found.text)):
        own = texts[found.text[k]].split()[found.first[k] - found.begins[found.text[k]] : found.after[k] - found.begins[found.text[k]]]
        for _, _, data, ends in text_slices(pa.array([" ".join(own)])):
            alone = paragraphs._Slice(data, ends, 20)
            alone.first, alone.after, alone.text = np.array([0]), np.array([len(own)]), np.array([0])
        assert (alone.bands(5)[0][0] == bands[k]).all() and alone.prints()[0] == prints[k]


def test_no_sets_have_no_signatures():
    from yardbook.llm.common import parities

    none = np.zeros(0, np.int64)
    assert parities(none, none, paragraphs.BITS).shape == (0, paragraphs.BITS // 64)


def test_bands_go_once_the_classes_are_stored(docs_frame, monkeypatch):
    """Bands and signatures of all paragraphs stayed on disk beside those of the classes until the end."""
    from yardbook.llm.common import Scratch

    steps, store, drop = [], Scratch.store, Scratch.drop
    monkeypatch.setattr(Scratch, "store", lambda self, df, name: steps.append((name, df.columns)) or store(self, df, name))
    monkeypatch.setattr(Scratch, "drop", lambda self, name="": steps.append((name, None)) or drop(self, name))
    line = " ".join(f"w{i}" for i in range(30))
    got = paragraphs.repeated_paragraphs(docs_frame([(1, line), (2, line), (3, "short")])).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(1, True), (2, False)]
    held = {}
    for name, columns in steps:
        if columns is None:
            held.pop(name)
        else:
            held[name] = columns
        if name == "blocks" and columns:
            assert not [n for n, c in held.items() if "bands" in c]
