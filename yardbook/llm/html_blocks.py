"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between block-level tags. A bidirectional LSTM
(numpy) reads the sequence; each block is a vector of its hashed tag path (tags, classes, roles), its
hashed words and a few measures (length, links, signs, place), and every label is decided with the
whole page as context. Blocks labelled as main text are joined by two line feeds.

The labeller is trained on at most ``sample`` pages (those with the smallest hash of the address). Pages
carry no labels, so markup that states its purpose gives them: what stands in article or main elements
is main text, what stands in navigation, header, footer, aside, form and in elements whose class names
a menu, notice, advert, sidebar or comments is not. So that the labeller does not depend on one way of
writing, each training page is also read in variants: containers renamed to plain ones with a telling
class, and further boilerplate blocks put in.

Defined results: null and empty pages, and pages without main text, give an empty text; broken markup
is read as browsers do roughly (unclosed elements end with their parent); scripts, styles, templates,
heads and comments in markup are never text; with no page to learn from all texts are empty; repeated
pages are labelled each; very long pages are labelled whole.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN = 160, 32, 8, 16
INPUT = PATH_SIZE + WORD_SIZE + MEASURES
SAMPLE = 200

# Element names of the HTML standard, by their role in reading a page.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody"
    " td tfoot th thead title tr ul".split()
)
HIDDEN_TEXT = frozenset("script style template noscript head title svg iframe object textarea select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
_CLOSES_P = BLOCK - {"html", "body"}
_ASIDE_NAME = re.compile(
    r"(^|[-_ ])(nav|menu|navbar|breadcrumbs?|header|masthead|footer|sidebar|aside|widget|related|ads?|advert\w*|banner|sponsor\w*|promo\w*"
    r"|cookies?|notice|consent|popup|modal|newsletter|subscribe|share|social|comments?|respond|replies|login|search)($|[-_ ])"
)
_MAIN_NAME = re.compile(r"(^|[-_ ])(article|content|post|entry|story|main|body-text|text)($|[-_ ])")
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<[a-zA-Z/!?][^<>]*$", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, share of the text in links) of each leaf block in page order."""
    found: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, str]] = []
    run: list[str] = []
    linked = [0]
    path: tuple[str, ...] = ()

    def close() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                found.append((path, text, min(1.0, linked[0] / len(text))))
            run.clear()
        linked[0] = 0

    at, depth_links = 0, 0
    size = len(page)
    while at < size:
        match = _TOKEN.search(page, at)
        until = match.start() if match else size
        if until > at:
            run.append(page[at:until])
            if depth_links:
                linked[0] += until - at
        if not match:
            break
        at = match.end()
        closing, name = match[1], (match[2] or "").lower()
        if not name:
            continue
        if name in HIDDEN_TEXT and not closing:
            if not match[3].rstrip().endswith("/"):
                if name == "head":
                    stop = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                    at = (stop.end() if stop[0].startswith("</") else stop.start()) if stop else at
                else:
                    stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                    at = stop.end() if stop else size
            close() if name in ("head", "title") else None
            continue
        if name == "br":
            run.append(" ")
            continue
        if name == "a":
            depth_links = max(0, depth_links + (-1 if closing else 1))
            continue
        if name not in BLOCK and name not in MAIN:
            continue
        close()
        if closing:
            names = [n for n, _ in stack]
            if name in names:
                del stack[len(names) - 1 - names[::-1].index(name) :]
        else:
            if name in _CLOSES_P and stack and stack[-1][0] == "p":
                stack.pop()
            if name not in VOID:
                words = [name]
                for kind, *values in _ATTRIBUTE.findall(match[3]) if match[3] else ():
                    words += [f"{kind.lower()}={v}" for v in " ".join(values).lower().split()]
                stack.append((name, " ".join(words)))
        path = tuple(words for _, words in stack)
    close()
    return found


def stated_label(path: tuple[str, ...]) -> float:
    """1 if the markup says main text, 0 if it says something else; the innermost statement counts."""
    for step in reversed(path):
        name, *attributes = step.split(" ")
        names = " ".join(a.partition("=")[2] for a in attributes)
        if name in ASIDE or _ASIDE_NAME.search(names):
            return 0.0
        if name in MAIN or _MAIN_NAME.search(names):
            return 1.0
    return 0.0


_HASHED: dict[tuple[str, int], tuple[int, float]] = {}


def _slot(word: str, size: int) -> tuple[int, float]:
    key = (word, size)
    found = _HASHED.get(key)
    if found is None:
        if len(_HASHED) > 200_000:
            _HASHED.clear()
        code = zlib.crc32(word.encode("utf-8", "replace"))
        found = _HASHED[key] = (code % size, 1.0 if code & 0x10000 else -1.0)
    return found


def _path_words(path: tuple[str, ...]) -> Iterator[str]:
    """Tags, and the parts of class, id and role values."""
    for step in path:
        name, *attributes = step.split(" ")
        yield name
        for attribute in attributes:
            yield from (f".{part}" for part in re.split(r"[^a-z]+", attribute.partition("=")[2]) if part)


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def vectors(page_blocks: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    out = np.zeros((len(page_blocks), INPUT), np.float32)
    for i, (path, text, linked) in enumerate(page_blocks):
        own = _PATHS.get(path)
        if own is None:
            if len(_PATHS) > 50_000:
                _PATHS.clear()
            own = np.zeros(PATH_SIZE, np.float32)
            for word in _path_words(path):
                slot, sign = _slot(word, PATH_SIZE)
                own[slot] += sign
            if path:
                slot, sign = _slot("leaf " + path[-1].split(" ")[0], PATH_SIZE)
                own[slot] += sign
            _PATHS[path] = np.clip(own, -2, 2)
            own = _PATHS[path]
        out[i, :PATH_SIZE] = own
        words = text.split()
        codes = np.fromiter(map(zlib.crc32, text.lower().encode("utf-8", "replace").split()), np.int64)
        signs = np.where(codes & 0x10000, 1.0, -1.0)
        out[i, PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.bincount(codes % WORD_SIZE, signs, WORD_SIZE) * 0.3 / np.sqrt(len(codes) + 1)
        out[i, PATH_SIZE + WORD_SIZE :] = (
            np.log1p(len(words)) / 4, linked, text.count(".") / (len(words) + 1), text.count(",") / (len(words) + 1),
            i / len(page_blocks), float("©" in text), float(text[-1] in ".!?:;”\"'"), 1.0,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class Labeller:
    """A bidirectional LSTM over padded batches (time, page, input)."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {}
        for way in "fb":
            self.p[f"w{way}"] = (rng.standard_normal((INPUT, 4 * HIDDEN)) / np.sqrt(INPUT)).astype(np.float32)
            self.p[f"u{way}"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            self.p[f"c{way}"] = np.zeros(4 * HIDDEN, np.float32)
        self.p["o"] = (rng.standard_normal(2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.p["d"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        steps, pages, _ = x.shape
        drive = x @ self.p[f"w{way}"] + self.p[f"c{way}"]
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            gates = drive[t] + h @ self.p[f"u{way}"]
            io = _sigmoid(gates[:, : 3 * HIDDEN])
            i, f, o = io[:, :HIDDEN], io[:, HIDDEN : 2 * HIDDEN], io[:, 2 * HIDDEN :]
            g = np.tanh(gates[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            after = f * c + i * g
            tanh = np.tanh(after)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tanh, m))
            c = np.where(m, after, c)
            h = np.where(m, o * tanh, h)
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], axis=2)
        return both @ self.p["o"] + self.p["d"]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept = {"f": [], "b": []}
        halves = {way: self._run(x, mask, way, kept[way]) for way in "fb"}
        both = np.concatenate([halves["f"], halves["b"]], axis=2)
        error = (_sigmoid(both @ self.p["o"] + self.p["d"]) - y) * mask / max(1, mask.sum())
        slopes = {"o": np.einsum("tp,tph->h", error, both), "d": np.array([error.sum()])}
        for k, way in enumerate("fb"):
            back = error[:, :, None] * self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            u = self.p[f"u{way}"]
            dh, dc = np.zeros_like(back[0]), np.zeros_like(back[0])
            dgates, du = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(u)
            for t, h, c, i, f, o, g, tanh, m in reversed(kept[way]):
                total = dh + back[t]
                inside = np.where(m, total, 0)
                d_after = np.where(m, dc, 0) + inside * o * (1 - tanh**2)
                d = np.concatenate(
                    [d_after * g * i * (1 - i), d_after * c * f * (1 - f), inside * tanh * o * (1 - o), d_after * i * (1 - g**2)], axis=1
                )
                dgates[t] = d
                du += h.T @ d
                dh = np.where(m, d @ u.T, total)
                dc = np.where(m, d_after * f, dc)
            slopes[f"u{way}"] = du
            slopes[f"w{way}"] = np.einsum("tpi,tpg->ig", x, dgates, optimize=True)
            slopes[f"c{way}"] = dgates.sum(axis=(0, 1))
        return slopes

    def labels(self, pages: list[np.ndarray], most: int = 40_000) -> list[np.ndarray]:
        """Main text or not, for each block of each page; pages of similar length are run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])]
        while order:
            first, longest = len(order), len(pages[order[-1]])
            while first and longest * (len(order) - first + 1) <= max(most, longest):
                first -= 1
            group, order = order[first:], order[:first]
            x, mask = padded([pages[i] for i in group])
            found = self.scores(x, mask) > 0
            for k, i in enumerate(group):
                out[i] = found[: len(pages[i]), k]
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), INPUT), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


_MAIN_FORMS = ["article", "main", "div class=content", "div class=post", "div class=entry-content", "section class=story", "div id=main-content", "div class=article-body"]
_OTHER_FORMS = {
    "nav": ["nav", "div class=menu", "ul class=nav-menu", "div class=navbar", "div id=menu", "div class=breadcrumb"],
    "header": ["header", "div class=header", "div id=masthead", "div class=site-header"],
    "footer": ["footer", "div class=footer", "div id=footer", "div class=site-footer"],
    "aside": ["aside", "div class=sidebar", "div id=sidebar", "div class=widget", "div class=related"],
    "ad": ["div class=ad", "div class=ads", "div class=advert", "div class=advertisement", "div class=banner", "div class=sponsored", "div class=promo"],
    "notice": ["div class=cookie-notice", "div class=cookie", "div class=notice", "div id=consent", "div class=popup", "dialog", "div class=newsletter"],
    "form": ["form", "form class=search", "form class=subscribe", "div class=login"],
    "comments": ["section class=comments", "div id=comments", "div class=comment-list", "ol class=comments", "div class=comment"],
}


def _renamed(path: tuple[str, ...], forms: dict[str, str]) -> tuple[str, ...]:
    out = []
    for step in path:
        name, *attributes = step.split(" ")
        names = " ".join(a.partition("=")[2] for a in attributes)
        kind = "main" if name in MAIN else name if name in ASIDE else "ad" if _ASIDE_NAME.search(names) else None
        out.append(forms.get(kind, step) if kind else step)
    return tuple(out)


def variants(page_blocks: list, rng: np.random.Generator, count: int) -> Iterator[tuple[list, np.ndarray]]:
    """The page's blocks and stated labels, as they are and in other ways of writing."""
    labels = [stated_label(b[0]) for b in page_blocks]
    yield page_blocks, np.array(labels)
    texts = [b[1] for b in page_blocks]
    for _ in range(count):
        forms = {kind: str(rng.choice(f)) for kind, f in _OTHER_FORMS.items()} | {"main": str(rng.choice(_MAIN_FORMS))}
        wrap = ["div class=wrapper"] if rng.random() < 0.4 else []
        made = [((*p[:2], *wrap, *_renamed(p[2:], forms)), t, l) for p, t, l in page_blocks]
        marks = list(labels)
        inside = next((i for i, m in enumerate(marks) if m), None)
        base = (*page_blocks[0][0][:2], *wrap) if page_blocks else ()
        for kind in rng.permutation(list(_OTHER_FORMS)):
            if rng.random() < 0.45:
                n = int(rng.integers(1, 5))
                extra = []
                for _ in range(n):
                    words = str(rng.choice(texts)).split() if texts else ["x"]
                    cut = words[: int(rng.integers(1, 40))]
                    leaf = str(rng.choice({"nav": ["li", "ul li"], "comments": ["p", "li", "div"], "form": ["p", "legend"]}.get(str(kind), ["p", "div", "li", "h3"])))
                    holder = (page_blocks[inside][0][2:] if inside is not None and rng.random() < 0.5 else ())
                    extra.append(((*base, *_renamed(tuple(s for s in holder if s != "p"), forms), forms[str(kind)], *leaf.split()), " ".join(cut), float(kind == "nav")))
                at = int(rng.choice([0, len(made), rng.integers(0, len(made) + 1)]))
                made[at:at] = extra
                marks[at:at] = [0.0] * n
        yield made, np.array(marks)


def fit(pages: list[str], epochs: int = 8, copies: int = 8, seed: int = 5) -> Labeller | None:
    rng = np.random.default_rng(seed)
    examples = []
    for page in pages:
        found = blocks(page)[:400]
        if found:
            examples += [(vectors(b), y) for b, y in variants(found, rng, copies) if len(y)]
    if not examples or not any(y.any() for _, y in examples):
        return None
    model = Labeller()
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.p.items()}
    examples.sort(key=lambda e: len(e[1]))
    batches = [examples[i : i + 32] for i in range(0, len(examples), 32)]
    step = 0
    for epoch in range(epochs):
        for b in rng.permutation(len(batches)):
            step += 1
            x, mask = padded([e[0] for e in batches[b]])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, labels) in enumerate(batches[b]):
                y[: len(labels), k] = labels
            for k, g in model.gradient(x, mask, y).items():
                m, v = moments[k]
                g = np.clip(g, -1, 1)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                model.p[k] -= (0.02 * (1 - 0.9 * epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def main_text(df: DataFrame, sample: int = SAMPLE, html_column: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of each row."""
    spark = df.sparkSession
    pages = df.select(df[page_id].alias("page_id"), df[url].alias("url"), F.coalesce(df[html_column].cast("string"), F.lit("")).alias("html"))
    # Bounded by `sample` pages, of which at most the first 100,000 characters are learnt from.
    keys = pages.select("page_id", "url").distinct().orderBy(F.xxhash64("url", "page_id"), "page_id", "url").limit(sample).alias("k")
    same = F.col("p.page_id").eqNullSafe(F.col("k.page_id")) & F.col("p.url").eqNullSafe(F.col("k.url"))
    picked = pages.alias("p").join(F.broadcast(keys), same, "left_semi").groupBy("page_id", "url")
    picked = picked.agg(F.substring(F.min("html"), 1, 100_000).alias("html"))
    model = fit([r.html for r in sorted(picked.collect(), key=repr)])
    if model is None:
        return pages.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars"))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def extract(column: pd.Series) -> pd.Series:
        out = []
        for begin in range(0, len(column), 256):
            found = [blocks(page) for page in column.iloc[begin : begin + 256]]
            labels = shared.value.labels([vectors(b) if b else np.zeros((0, INPUT), np.float32) for b in found])
            out += ["\n\n".join(t for (_, t, _), main in zip(b, marks) if main) for b, marks in zip(found, labels)]
        return pd.Series(out)

    texts = pages.select("page_id", "url", extract("html").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
