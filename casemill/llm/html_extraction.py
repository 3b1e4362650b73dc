"""HTML extraction: a bidirectional LSTM in numpy labels a page's leaf blocks as main text or not."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import sliced
from casemill.llm.html_blocks import WIDTH, Block, leaf_blocks, vectors

HIDDEN_SIZE = 16
#: Generated pages that the labeller is trained on, pages in a step, and passes over them.
TRAIN_PAGES, STEP_PAGES, PASSES = 1500, 32, 8
SEED = 9
#: Share of the training pages whose parts have names of no meaning.
RENAMED = 0.3
#: Pages that are labelled together, and blocks, shorter pages counted as the longest of their step; a longer page runs alone.
PAGES, STEP_BLOCKS = 128, 16_384
#: Blocks whose vectors are held at a time, or those of one page.
BLOCKS = 20_000

# Names that pages give to their parts, for the generated training pages.
PARTS = {
    "menu": ("nav", "div.nav", "div.menu", "ul.navbar", "div.navigation", "div.breadcrumb", "div.topnav", "nav.main-nav"),
    "header": ("header", "div.header", "div.masthead", "div.site-header", "div.banner", "div.logo"),
    "footer": ("footer", "div.footer", "div.site-footer", "div.copyright", "section.bottom"),
    "sidebar": ("aside", "div.sidebar", "div.side", "div.widget", "div.related", "section.related-posts", "div.recommended"),
    "notice": ("div.cookie-notice", "div.cookie", "div.consent", "div.alert", "div.notice", "div.popup", "div.gdpr", "div.modal"),
    "advert": ("div.ad", "div.ads", "div.advert", "div.sponsored", "div.promo", "ins.adsbygoogle", "div.banner-ad", "aside.ad"),
    "form": ("form", "form.search", "form.newsletter", "div.signup", "div.login", "form.subscribe", "div.share", "div.social"),
    "comments": ("div.comments", "section.comments", "ol.comment-list", "div.comment", "div#disqus", "div.replies", "section#comments"),
}
MAIN = ("article", "main", "div.content", "div.post", "div.entry-content", "div.article-body", "div#content", "section.story", "div.post-body", "div.text", "main.article", "div")
FRAMES = ("div.container", "div.wrapper", "div#page", "div.row", "div.col", "div.site", "section", "div")
NOISE = "home about contact login menu search privacy cookies accept subscribe newsletter share reply says comments copyright rights reserved sponsored advertisement related more read next previous terms sign up follow email submit".split()


def _element(spec: str, inside: str) -> str:
    tag, mark, name = spec.partition("." if "." in spec else "#")
    kind = {".": "class", "#": "id"}.get(mark)
    return f'<{tag}{f' {kind}="{name}"' if kind else ''}>{inside}</{tag}>'


def generated_page(draw: np.random.Generator) -> tuple[str, list[int]]:
    """An invented page and the label of each of its leaf blocks in order: 1 main text, 0 not."""
    letters = [a + b for a in "bcdfglmnprstv" for b in "aeiou"]
    pick = lambda x: x[int(draw.integers(len(x)))]
    word = lambda: "".join(pick(letters) for _ in range(int(draw.integers(1, 4))))
    labels: list[int] = []

    def words(n: int, noise: float) -> str:
        return " ".join(pick(NOISE) if draw.random() < noise else word() for _ in range(n))

    def sentence(low: int, high: int, noise: float = 0.0) -> str:
        text = words(int(draw.integers(low, high)), noise).capitalize()
        return text + pick([".", ".", "!", "?", ", " + word() + "."])

    def odd(n: int) -> str:
        # Tables put as text, marked words, capitals, repeats: main text as well as any other.
        join, mark = pick([" | ", " ", "! ", " - "]), pick(["", "", "###", "$", "!!", "&amp;", "."])
        one = [word() + mark for _ in range(1 + n // 8 if draw.random() < 0.3 else n)]
        text = join.join((one * n)[:n])
        return text.upper() if draw.random() < 0.2 else text

    def block(tag: str, text: str, label: int) -> str:
        labels.append(label)
        return f"<{tag}>{text}</{tag}>" if tag else text

    def clutter(kind: str) -> str:
        spec = pick(PARTS[kind])
        tag = spec.split(".")[0].split("#")[0]
        if kind in ("menu", "sidebar") and draw.random() < 0.8:
            items = "".join(block("li", f'<a href="/x">{words(int(draw.integers(1, 5)), 0.3)}</a>', 0) for _ in range(int(draw.integers(2, 9))))
            return _element(spec, items if tag in ("ul", "ol") else f"<ul>{items}</ul>")
        if kind == "comments":
            n = int(draw.integers(1, 5))
            return _element(spec, "".join(block(pick(["p", "div", "li"]), sentence(3, 40, 0.1), 0) for _ in range(n)))
        if draw.random() < 0.5:
            return _element(spec, block("", sentence(2, 25, 0.2), 0))
        return _element(spec, "".join(block(pick(["p", "div", "h3"]), sentence(2, 20, 0.2), 0) for _ in range(int(draw.integers(1, 4)))))

    def story() -> str:
        out = block(pick(["h1", "h1", "h2"]), words(int(draw.integers(2, 10)), 0.0).capitalize(), 1) if draw.random() < 0.9 else ""
        for _ in range(int(draw.integers(1, pick([3, 6, 12])))):
            kind = draw.random()
            if kind < 0.1:
                out += block("p", sentence(1, 14), 1)
            elif kind < 0.2:
                out += block("p", odd(int(draw.integers(1, 60))), 1)
            elif kind < 0.7:
                out += block("p", " ".join(sentence(3, 16) for _ in range(int(draw.integers(1, 6)))), 1)
            elif kind < 0.78:
                out += block(pick(["h2", "h3"]), sentence(1, 7), 1)
            elif kind < 0.84:
                out += block("p", f"<b>{sentence(1, 8)}<br>", 1)
            elif kind < 0.9:
                out += "<ul>" + "".join(block("li", sentence(2, 12), 1) for _ in range(int(draw.integers(2, 5)))) + "</ul>"
            elif kind < 0.93:
                out += block(pick(["blockquote", "pre", "div"]), sentence(4, 30), 1)
            elif kind < 0.96:
                rows = ["".join(block("td", words(int(draw.integers(1, 4)), 0.0), 1) for _ in range(2)) for _ in range(int(draw.integers(1, 4)))]
                out += "<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>"
            else:
                out += clutter(pick(["advert", "sidebar", "form"]))
        return out + (clutter("comments") if draw.random() < 0.15 else "")

    if draw.random() < 0.05:
        return block(pick(["", "p", "div"]), sentence(5, 40), 1), labels
    page = "".join(clutter(x) for x in ("notice", "header", "menu", "advert", "form", "sidebar") if draw.random() < 0.45)
    page += _element(pick(MAIN), story())
    page += "".join(clutter(x) for x in ("comments", "sidebar", "form", "advert", "notice", "footer") if draw.random() < 0.45)
    for _ in range(int(draw.integers(0, 3))):
        page = _element(pick(FRAMES), page)
    return f"<html><head><title>x</title></head><body>{page}</body></html>", labels


def renamed(page: str, draw: np.random.Generator) -> str:
    """The page with other names for its classes and ids, each the same throughout, so that tags, words and places have to tell."""
    names: dict[str, str] = {}

    def other(m: re.Match) -> str:
        return f'{m[1]}="{names.setdefault(m[2], "".join(map(chr, draw.integers(97, 123, 6))))}"'

    return re.sub(r'(class|id)="([^"]*)"', other, page)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _run(w: dict[str, np.ndarray], side: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states of one direction over x (pages, blocks, features); mask: blocks that exist."""
    order = range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1)
    inputs, size = x @ w[f"{side}x"] + w[f"{side}b"], HIDDEN_SIZE
    h, c = np.zeros((len(x), size), np.float32), np.zeros((len(x), size), np.float32)
    out, steps = np.zeros((len(x), x.shape[1], size), np.float32), []
    for t in order:
        z = inputs[:, t] + h @ w[f"{side}h"]
        i, f, o, g = _sigmoid(z[:, :size]), _sigmoid(z[:, size : 2 * size]), _sigmoid(z[:, 2 * size : 3 * size]), np.tanh(z[:, 3 * size :])
        m = mask[:, t, None]
        before, then = (h, c), f * c + i * g
        th = np.tanh(then)
        c, h = m * then + (1 - m) * c, m * (o * th) + (1 - m) * h
        out[:, t] = h
        if keep:
            steps.append((t, i, f, o, g, th, m, *before))
    return out, steps


def _back(w: dict[str, np.ndarray], side: str, x: np.ndarray, steps: list, dout: np.ndarray, grads: dict[str, np.ndarray]) -> None:
    """Add one direction's gradients for dout, the loss by its hidden states."""
    dh, dc = np.zeros_like(dout[:, 0]), np.zeros_like(dout[:, 0])
    for t, i, f, o, g, th, m, h0, c0 in reversed(steps):
        dh = dh + dout[:, t]
        own = m * dh
        dthen = m * dc + own * o * (1 - th * th)
        dz = np.concatenate([dthen * g * i * (1 - i), dthen * c0 * f * (1 - f), own * th * o * (1 - o), dthen * i * (1 - g * g)], axis=1)
        grads[f"{side}x"] += x[:, t].T @ dz
        grads[f"{side}h"] += h0.T @ dz
        grads[f"{side}b"] += dz.sum(0)
        dh, dc = (1 - m) * dh + dz @ w[f"{side}h"].T, (1 - m) * dc + dthen * f


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(pages), max(map(len, pages)), WIDTH), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for k, page in enumerate(pages):
        x[k, : len(page)], mask[k, : len(page)] = page, 1
    return x, mask


def label(w: dict[str, np.ndarray], pages: list[np.ndarray]) -> list[np.ndarray]:
    """Probability that each block of each page is main text; pages of like lengths run together."""
    out: list[np.ndarray] = [np.empty(0)] * len(pages)
    order = [k for k in np.argsort([len(p) for p in pages], kind="stable").tolist() if len(pages[k])]
    at = 0
    while at < len(order):
        own = order[at : at + STEP_PAGES]
        while len(own) > 1 and len(own) * len(pages[own[-1]]) > STEP_BLOCKS:
            own = own[: len(own) // 2]
        at += len(own)
        x, mask = _padded([pages[k] for k in own])
        both = np.concatenate([_run(w, side, x, mask, False)[0] for side in "fr"], axis=2)
        p = _sigmoid(both @ w["y"] + w["yb"])
        for k, row in zip(own, p, strict=True):
            out[k] = row[: len(pages[k])]
    return out


@functools.cache
def trained() -> dict[str, np.ndarray]:
    """The labeller's weights, trained on generated pages: the same in every run."""
    draw = np.random.Generator(np.random.PCG64(SEED))
    rows, paths, words = [], {}, {}
    for _ in range(TRAIN_PAGES):
        page, labels = generated_page(draw)
        blocks = leaf_blocks(renamed(page, draw) if draw.random() < RENAMED else page)
        if len(blocks) == len(labels) and labels:
            rows.append((vectors(blocks, paths, words), np.array(labels, np.float32)))
    n = HIDDEN_SIZE
    w = {}
    for side in "fr":
        w |= {f"{side}x": draw.normal(0, 0.1, (WIDTH, 4 * n)), f"{side}h": draw.normal(0, 0.1, (n, 4 * n)), f"{side}b": np.repeat([0.0, 1.0, 0.0, 0.0], n)}
    w |= {"y": draw.normal(0, 0.1, 2 * n), "yb": np.zeros(1)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    m, v, t = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for turn in range(PASSES):
        rate = 0.01 * (1 - turn / PASSES)
        order = draw.permutation(len(rows))
        for at in range(0, len(order), STEP_PAGES):
            own = [rows[k] for k in order[at : at + STEP_PAGES]]
            x, mask = _padded([r[0] for r in own])
            y = np.zeros_like(mask)
            for k, r in enumerate(own):
                y[k, : len(r[1])] = r[1]
            runs = {side: _run(w, side, x, mask, True) for side in "fr"}
            both = np.concatenate([runs[side][0] for side in "fr"], axis=2)
            e = (_sigmoid(both @ w["y"] + w["yb"]) - y) * mask / mask.sum()
            grads = {k: np.zeros_like(u) for k, u in w.items()}
            grads["y"], grads["yb"] = np.tensordot(e, both, ([0, 1], [0, 1])), e.sum(keepdims=True)[0]
            dboth = e[:, :, None] * w["y"]
            for k, side in enumerate("fr"):
                _back(w, side, x, runs[side][1], dboth[:, :, k * n : (k + 1) * n], grads)
            t += 1
            for k in w:
                g = np.clip(grads[k], -1, 1)
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return w


def _by_blocks(pages: list[list[Block]]) -> Iterator[list[list[Block]]]:
    """The pages in order, in parts of at most BLOCKS blocks or of one page."""
    own, n = [], 0
    for blocks in pages:
        if own and n + len(blocks) > BLOCKS:
            yield own
            own, n = [], 0
        own.append(blocks)
        n += len(blocks)
    if own:
        yield own


def extract(pages: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars, n_blocks.

    text joins the blocks labelled main text in page order by a line feed; it is empty for null or empty pages and
    for pages without such blocks. Repeated rows are extracted each; other columns are dropped. Nothing is shuffled;
    a task holds the pages of one small batch.
    """
    w = trained() if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: dict = {}
        words: dict = {}
        for batch in sliced(batches, PAGES):
            blocks = [leaf_blocks(x) for x in batch.column(2).to_pylist()]
            p = [q for own in _by_blocks(blocks) for q in label(w, [vectors(b, paths, words) for b in own])]
            texts = ["\n".join(x.text for x, main in zip(b, q, strict=True) if main >= 0.5) for b, q in zip(blocks, p, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(b) for b in blocks], pa.int32())], names=["page_id", "url", "text", "n_blocks"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    found = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_blocks int")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")
