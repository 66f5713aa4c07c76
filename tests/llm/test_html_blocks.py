import html

import numpy as np
import pytest

from yardbook.llm import html_blocks, queries
from yardbook.llm.html_blocks import blocks, fit, stated_label, vectors


def other_way(paragraphs, i):
    """The same article as another site would write it."""
    body = "".join(f"<p>{html.escape(x)}</p>" for x in paragraphs)
    return f"""<!doctype html><html><head><title>t</title><style>x</style></head><body><header class="site-header"><h1>Site</h1>
<ul class="menu"><li><a href=x>Home</a><li><a href=y>News</a></ul></header><div class="cookie-notice"><p>We use cookies.</p></div>
<div class="content"><h1>Title {i}</h1>{body}<div class="ad"><p>Buy now</p></div><form><p>Subscribe to it</p></form></div>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=z>More</a></li></ul></aside><section class="comments"><h2>Comments</h2>
<div class="comment"><p>{html.escape(paragraphs[0])}</p></div></section><footer><p>&copy; 2024</p></footer></body></html>"""


def plain(found):
    return [t for p, t, _ in found if stated_label(p)]


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]


def test_blocks_of_broken_markup():
    found = blocks("<p>a<p>b <i>c</i>d<br>e<div>f</div>g<script>x<p>y</script>h &amp; &#233;<!-- <p>no --><li>z &nbsp; w</ul> end<b")
    assert [t for _, t, _ in found] == ["a", "b cd e", "f", "gh & é", "z w", "end"]
    assert found[0][0] == found[1][0] == ("p",) and blocks("") == [] and blocks("<html><head><title>x</title></head></html>") == []
    assert [t for _, t, _ in blocks("<style>p{}</style><p>" + "long " * 200_000)] == [("long " * 200_000).strip()]


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    x, mask = html_blocks.padded([rng.standard_normal((n, html_blocks.INPUT)).astype(np.float32) for n in (3, 5)])
    y = (rng.random(mask.shape) > 0.5).astype(np.float32)
    model = html_blocks.Labeller()

    def loss():
        p = 1 / (1 + np.exp(-model.scores(x, mask).astype(float)))
        return -(np.where(y > 0, np.log(p), np.log(1 - p)) * mask).sum() / mask.sum()

    slopes = model.gradient(x, mask, y)
    for name, at in (("wf", (2, 5)), ("ub", (3, 40)), ("cb", (10,)), ("uf", (1, 20)), ("o", (4,))):
        model.p[name][at] += 1e-2
        up = loss()
        model.p[name][at] -= 2e-2
        down = loss()
        model.p[name][at] += 1e-2
        assert np.isclose((up - down) / 2e-2, slopes[name][at], rtol=0.03, atol=2e-5)


def test_held_out_pages_and_another_way_of_writing(pages):
    model = fit(pages[:160])
    held = [blocks(p) for p in pages[160:]]
    got = model.labels([vectors(b) for b in held])
    assert all([t for (_, t, _), m in zip(b, marks) if m] == plain(b) for b, marks in zip(held, got))
    right = 0
    for i, b in enumerate(held):
        own = blocks(other_way(plain(b), i))
        marks = model.labels([vectors(own)])[0]
        right += [t for (_, t, _), m in zip(own, marks) if m] == [f"Title {i}", *plain(b)]
    assert right >= 0.95 * len(held)


def test_query_and_odd_pages(spark, sf_dir, pages):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.html_extraction(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == "\n\n".join(plain(blocks(r.html))) and got[r.page_id].n_chars == len(got[r.page_id].text)
        assert got[r.page_id].url == r.url
    odd = [(i, f"u{i}", p) for i, p in enumerate(pages[:40])] + [(None, None, None), (50, "u", ""), (50, "u", ""), (51, "v", "<p>")]
    frame = spark.createDataFrame(odd, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    out = html_blocks.main_text(frame).collect()
    assert len(out) == len(odd) and all(r.text == "" and r.n_chars == 0 for r in out if r.page_id is None or r.page_id >= 50)
    assert html_blocks.main_text(frame.limit(0)).count() == 0
