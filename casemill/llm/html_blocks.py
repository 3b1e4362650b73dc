"""Leaf blocks of HTML pages: their text, tag path and features."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from html import unescape

import numpy as np

#: Hashed places of tag-path tokens and of words in a block's vector.
PATH_SIZE, WORD_SIZE = 256, 32
WIDTH = PATH_SIZE + WORD_SIZE + 5

# Elements whose content is no text of the page, those of them that are read to their end tag as they
# stand, and elements that stay inside a block.
HIDDEN = frozenset("script style noscript template svg head title iframe object canvas audio video select textarea annotation".split())
RAW = frozenset("script style title textarea iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot munder mover munderover mfenced mspace mstyle semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key ends an open element of the values, up to the nearest of the stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that may stand in a hidden one without an end tag; any other ends it.
INSIDE = {"select": frozenset({"option", "optgroup", "hr"}), "head": frozenset("base link meta title style script noscript template".split())}
#: Nearest tokens of a block's tag path.
PATH_TOKENS = 48

# A quote opens a value after an equals sign only; elsewhere in a tag it is a character like any other.
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*))>", re.S)
_NAMED = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+")
_ATTRIBUTE = re.compile(r"([^\s=>/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int  # characters inside links


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    names = [x for m in _NAMED.finditer(attributes) for x in _PARTS.findall(m[1] or m[2] or m[3] or "")] if "=" in attributes else []
    return (tag, *(f".{x.lower()}" for x in names))


def _not_shown(attributes: str) -> bool:
    """Whether attributes hide their element: hidden, or a style that displays nothing."""
    lowered = attributes.lower()
    if "hidden" not in lowered and "display" not in lowered:
        return False
    named = [(m[1].lower(), m[2] or "") for m in _ATTRIBUTE.finditer(attributes)]
    return any(name == "hidden" or (name == "style" and _NO_DISPLAY.search(value) is not None) for name, value in named)


def leaf_blocks(html: str | None) -> list[Block]:
    """Blocks with text in page order: references decoded, white space made one space, ends trimmed.

    Elements that hold blocks end a block at both tags; inline elements and line breaks do not. Hidden elements are
    passed over: scripts, styles, titles, text areas and frames up to their end tags or else the page's end, others up
    to their own or their parent's end. One of these others that has no end tag at all hides nothing but what may stand
    in it, and one of either kind that is closed in itself (scripts aside) hides nothing. Block elements with the attribute hidden, or a style of
    display: none, are hidden to their end; inline ones are read. Null and empty pages have no blocks. The work grows with the page's length.
    """
    page, out = html or "", []
    last = page.rfind(">")  # behind it no tag ends
    stack: list[tuple[str, tuple[str, ...], bool]] = []  # tag, nearest path tokens, hidden with its ancestors
    opened: dict[str, int] = {}
    ended: dict[str, int] = {}  # where a tag's last end tag stands
    pending: list[str] = []
    links = linked = at = 0
    bare = ""  # a hidden element without an end tag that is passed over

    def flush() -> None:
        nonlocal linked
        if pending:
            text = " ".join(unescape("".join(pending)).split())
            if text:
                out.append(Block(text, stack[-1][1] if stack else (), linked))
            pending.clear()
        linked = 0

    def close(i: int) -> None:
        for tag, _, _ in stack[i:]:
            opened[tag] -= 1
        del stack[i:]

    def ends_later(tag: str) -> bool:
        if tag not in ended:
            ended[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}[\s>]", page, re.I)), default=-1)
        return ended[tag] >= at

    while at < len(page):
        m = _MARK.search(page, at) if at <= last or "<!" in page[at:] else None
        # A mark that no tag follows is text.
        text = page[at : m.start() if m else len(page)]
        if text and not bare and not (stack and stack[-1][2]):
            pending.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        shown = not bare and not (stack and stack[-1][2])
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and shown:
                pending.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if bare and tag not in INSIDE[bare]:
            bare = ""
        if tag in INLINE:
            if tag == "br":
                pending.append(" ")
            elif tag == "a":
                links = max(0, links + (-1 if m[1] else 1))
            continue
        if tag == "annotation" and not m[1]:
            # Inside a formula: its text goes, the block goes on.
            end = re.compile(r"</annotation\s*>", re.I).search(page, at) if ends_later(tag) else None
            at = end.end() if end else at
            continue
        flush()
        links = 0
        if m[1]:
            if opened.get(tag):
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                close(i)
        elif tag in RAW and (tag == "script" or not m[3].endswith("/")):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (tag in HIDDEN and m[3].endswith("/")):
            if tag in HIDDEN and not ends_later(tag):
                bare = tag if tag in INSIDE else ""
                continue
            if stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            inner, stops = ENDS.get(tag, ((), ()))
            if any(opened.get(x) for x in inner):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in inner:
                        close(i)
                        break
                    if stack[i][0] in stops:
                        break
            above = stack[-1] if stack else ("", (), False)
            stack.append((tag, (above[1] + _tokens(tag, m[3]))[-PATH_TOKENS:], above[2] or tag in HIDDEN or _not_shown(m[3])))
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def vectors(blocks: list[Block], paths: dict[tuple[str, ...], np.ndarray], words: dict[str, int]) -> np.ndarray:
    """One row per block: hashed path tokens, hashed words, and shares of links, length, marks and place.

    paths and words remember what was hashed; both are emptied when they grow large.
    """
    out = np.zeros((len(blocks), WIDTH), np.float32)
    if len(paths) > 50_000:
        paths.clear()
    if len(words) > 500_000:
        words.clear()
    for i, b in enumerate(blocks):
        if b.path not in paths:
            v = np.zeros(PATH_SIZE, np.float32)
            for depth, x in enumerate(reversed(b.path)):
                v[zlib.crc32(x.encode("utf-8", "surrogatepass")) % PATH_SIZE] += 1 / (1 + 0.1 * depth)
            paths[b.path] = np.minimum(v, 1)
        out[i, :PATH_SIZE] = paths[b.path]
        tokens = b.text.lower().split()
        for x in tokens:
            if x not in words:
                words[x] = zlib.crc32(x.encode("utf-8", "surrogatepass")) % WORD_SIZE
        counts = np.bincount([words[x] for x in tokens], minlength=WORD_SIZE)
        out[i, PATH_SIZE : PATH_SIZE + WORD_SIZE] = counts / np.sqrt(float(counts @ counts))
        n = len(b.text)
        out[i, -5:] = (np.log1p(len(tokens)) / 5, min(1, b.linked / n), min(1, 10 * sum(map(b.text.count, ".,;:!?")) / n), i / len(blocks), 1.0)
    return out
