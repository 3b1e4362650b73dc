"""Leaf blocks of broken and deep pages, by hand and against the standard library's parser; the labeller on unknown names."""

from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from casemill.llm import html_blocks as B
from casemill.llm import html_extraction as H


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p class=it's>Hello", ["Hello"]),
        ('<p title="5" tall">Hello', ["Hello"]),
        ('<p title="a > b">Hello', ["Hello"]),
        ('<a href="foo>text', ["text"]),
        ("<p <b>x</p>", ["x"]),
        ("<p>1 < 2 and 3 > 2</p>", ["1 < 2 and 3 > 2"]),
        ("<p>a</p><select><option>b</option><p>rest of article</p>", ["a", "rest of article"]),
        ("<p>a</p><select><option>b</option></select><p>c", ["a", "c"]),
        ("<p>a <svg/> b</p><p>c", ["a", "b", "c"]),
        ("<p>a</p><canvas><p>rest</p>", ["a", "rest"]),
        ("<div><video>x</div><p>after</p><video></video><p>z", ["after", "z"]),
        ("<div><object>x</object>y</div>", ["y"]),
        ("<p>a</p><iframe src='x'/><p>z</p>", ["a", "z"]),
        ("<p>a</p><template><p>x</p></template><noscript>n</noscript>b", ["a", "b"]),
        ("<p>a</p><script>var t='</p>';if (a</b) {}</script><p>b", ["a", "b"]),
        ("<p>a</p><script>never ended <p>b", ["a"]),
        ("<head><meta a><title>t</title><p>body", ["body"]),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be</p>", ["Let x=2 be"]),
        ("<!-- a > b --><p>x<!-- unclosed", ["x"]),
        ("<p>&lt;b&gt; &amp; &eacute;", ["<b> & é"]),
        ("<ul><li>a<li>b</ul><dl><dt>c<dd>d</dl>", ["a", "b", "c", "d"]),
        ("</div></p>x</unknown>y", ["x", "y"]),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in B.leaf_blocks(page)] == texts


class Plain(HTMLParser):
    """Texts between tags of block elements, by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.now, self.hidden = [], [], 0

    def flush(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.out.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now.append(" ")
        elif tag not in B.INLINE:
            self.flush()
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        if tag not in B.INLINE:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.now.append(data)


def test_same_blocks_as_the_standard_parser():
    draw = random.Random(3)
    for _ in range(200):
        page = ""
        for _ in range(draw.randint(1, 40)):
            page += draw.choice(["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<br>", "<ul>", "<li>", "</ul>", " ", "word ", "a &amp; b ", "&lt;i&gt;", '<section class="x y">', "</section>", "<script>if (1) {}</script>", "<!-- c -->", "<span title='a>b'>", "<td>", "\n"])
        parser = Plain()
        parser.feed(page)
        parser.close()
        parser.flush()
        assert [b.text for b in B.leaf_blocks(page)] == parser.out, page


def test_work_grows_with_the_page():
    def seconds(n):
        began = time.perf_counter()
        B.leaf_blocks("<div>" * n + "x" + "</div>" * n + "<i>y</i>" * n + "</x>" * n + "<a" * n)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.002)
    deep = B.leaf_blocks("<div class='a b'>" * 5000 + "x")
    assert len(deep) == 1 and len(deep[0].path) == B.PATH_TOKENS


def test_label_by_steps_is_label_alone(monkeypatch):
    draw = np.random.Generator(np.random.PCG64(8))
    pages = [B.vectors(B.leaf_blocks(H.generated_page(draw)[0]), {}, {}) for _ in range(40)]
    w = {k: draw.normal(0, 0.3, s).astype(np.float32) for k, s in (("fx", (B.WIDTH, 64)), ("fh", (16, 64)), ("fb", 64), ("rx", (B.WIDTH, 64)), ("rh", (16, 64)), ("rb", 64), ("y", 32), ("yb", 1))}
    alone = [slow_label(w, x) for x in pages]
    monkeypatch.setattr(H, "STEP_BLOCKS", 60)
    for a, b in zip(H.label(w, pages), alone, strict=True):
        assert a == pytest.approx(b, abs=1e-4)


def slow_label(w, x):
    """The LSTM block by block, as its equations say."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    sides = {}
    for side, order in (("f", range(len(x))), ("r", range(len(x) - 1, -1, -1))):
        h, c, out = np.zeros(16), np.zeros(16), np.zeros((len(x), 16))
        for t in order:
            i, f, o, g = np.split(x[t] @ w[f"{side}x"] + h @ w[f"{side}h"] + w[f"{side}b"], 4)
            c = sig(f) * c + sig(i) * np.tanh(g)
            h = sig(o) * np.tanh(c)
            out[t] = h
        sides[side] = out
    return sig(np.concatenate([sides["f"], sides["r"]], axis=1) @ w["y"] + w["yb"])


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p hidden>a</p><p>b</p>", ["b"]),
        ("<div hidden=''><p>a</p>c</div>d", ["d"]),
        ("<div style='color: red; display : none'>a</div>b", ["b"]),
        ('<p style="DISPLAY:NONE">a</p><p style=display:none>a</p>b', ["b"]),
        ('<p class="not hidden" data-x="hidden" aria-hidden="true">a</p>', ["a"]),
        ('<p title="style=display:none">a</p><p style="display:block">b</p>', ["a", "b"]),
        ("<section><div hidden>a<p>b</section>c", ["c"]),
        ("<p>x <span hidden>y</span></p>", ["x y"]),
    ],
)
def test_hidden_elements(page, texts):
    assert [b.text for b in B.leaf_blocks(page)] == texts


def test_unclosed_annotations_are_linear():
    took = []
    for n in (8_000, 32_000):
        began = time.perf_counter()
        blocks = B.leaf_blocks("<p>" + "<annotation>x " * n)
        took.append(time.perf_counter() - began)
        assert blocks[0].text.count("x") == n
    assert took[1] < 12 * took[0] + 0.2


def test_pages_of_very_many_blocks_go_by_parts(monkeypatch):
    pages = [B.leaf_blocks("<p>a</p>" * n) for n in (3, 0, 9, 1, 1)]
    monkeypatch.setattr(H, "BLOCKS", 4)
    parts = list(H._by_blocks(pages))
    assert [x for part in parts for x in part] == pages and [[len(x) for x in part] for part in parts] == [[3, 0], [9], [1, 1]]
