"""A page's markup, read in time that grows with its length: elements by tag, texts, and facts.

Everything is found by searching forward for fixed strings in a lower-cased copy, and what has
been searched for in vain is remembered, so markup that is never closed costs one search more,
not one for each opening.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from urllib.parse import urljoin, urlsplit

from . import vocabulary as V

MOST_CHARS = 1_200_000
#: Content of an element that is never closed, and of any element, at most.
OPEN_CHARS, INNER_CHARS = 2_000, 24_000
_TAG = re.compile(r"<[^<>]*>")
_ENTITY = re.compile(r"&(#x?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{1,10});")
_ATTR = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_HIDDEN_CLASS = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(V.HIDDEN_CLASS)})(?:$|[\s_-])", re.I)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HALVES = re.compile("[\ud800-\udfff]")


def lowered(text: str) -> str:
    """A-Z in lower case; as long as the text, whatever else it holds."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def collapsed(text: str) -> str:
    if not text.isascii():
        for c in _ZERO_WIDTH:
            text = text.replace(c, " ")
    return " ".join(text.split())


def _character(m: re.Match[str]) -> str:
    body = m[1]
    if body[0] != "#":
        return V.ENTITIES.get(body.lower(), m[0])
    digits = body[2:] if body[1] == "x" else re.match("[0-9]*", body[1:])[0]
    number = int(digits[-40:], 16 if body[1] == "x" else 10) if digits else 0x110000
    if len(digits.lstrip("0")) > 7 or number > 0x10FFFF:
        return m[0]
    return "\ufffd" if 0xD800 <= number <= 0xDFFF else chr(number)


def decoded(text: str) -> str:
    """``text`` with the named entities of ``V.ENTITIES`` and numeric ones as characters; others stay."""
    return _ENTITY.sub(_character, text) if "&" in text else text


def plain(markup: str) -> str:
    """The text of a fragment: tags are spaces, entities are decoded, white space is collapsed."""
    text = _TAG.sub(" ", markup)
    return collapsed(decoded(text))


def clipped(text: str | None, most: int) -> str | None:
    """Collapsed text of ``most`` characters, with an ellipsis where it was longer; null if blank."""
    text = collapsed(str(text or ""))
    return (text if len(text) <= most else text[: most - 1] + "\u2026") or None


def whole(text: str) -> str:
    """``text`` with U+FFFD for halves of surrogate pairs, which no column can hold."""
    return text if text.isascii() else _HALVES.sub("\ufffd", text)


def repeated_once(text: str, least: int = 8, long: int = 24) -> str:
    """``text`` said once where it is one part, of ``least`` characters at least, said over and over.

    The smallest period of a string is where it is found again in itself doubled; a space may
    stand between the parts, so the text is tried with one after it as well.
    """
    if len(text) < long:
        return text
    for probe in (text, text + " "):
        n = (probe + probe).find(probe, 1)
        if least <= len(probe[:n].strip()) and n < len(probe):
            return probe[:n].strip()
    return text


def resolved(link: str | None, base: str | None) -> str | None:
    """A link as a full http address; null for one that is not, or can't be read."""
    try:
        found = urljoin(base or "", (link or "").strip())
        return found if urlsplit(found).scheme in ("http", "https") and urlsplit(found).netloc else None
    except ValueError:
        return None


class _Finder:
    """Forward search for one string, whose last answer is kept while it still holds."""

    def __init__(self, text: str, wanted: str):
        self._text, self._wanted, self._at = text, wanted, -2

    def __call__(self, start: int) -> int:
        if self._at != -1 and self._at < start:
            self._at = self._text.find(self._wanted, start)
        return self._at


def _openings(low: str, tag: str, start: int = 0) -> Iterator[tuple[int, int]]:
    """(start, end) of each opening tag; one that another ``<`` begins inside is none."""
    head, close, at = f"<{tag}", _Finder(low, ">"), low.find(f"<{tag}", start)
    while at >= 0:
        after = at + len(head)
        if after < len(low) and not (low[after].isalnum() or low[after] in "-_:"):
            end = close(after)
            if end < 0:
                return
            if low.find("<", after, end) < 0:
                yield at, end + 1
        at = low.find(head, after)


def without_code(raw: str) -> str:
    """Markup without comments, scripts, styles, noscript and templates; each leaves a space. What
    is never closed stays."""
    low, pieces, at = lowered(raw), [], 0
    ends = {"<!--": (_Finder(low, "-->"), 3)} | {f"<{t}": (_Finder(low, f"</{t}"), 0) for t in ("script", "style", "noscript", "template")}
    starts = {head: _Finder(low, head) for head in ends}
    close = _Finder(low, ">")
    here = 0
    while True:
        found = [(f(here), head) for head, f in starts.items()]
        found = [x for x in found if x[0] >= 0]
        if not found:
            break
        start, head = min(found)
        here = start + len(head)
        if head != "<!--" and here < len(low) and (low[here].isalnum() or low[here] in "-_"):
            continue
        finder, width = ends[head]
        end = finder(here)
        if end >= 0 and not width:
            end = close(end)
        if end < 0:
            del starts[head]  # none of its kind is closed from here on
            continue
        here = end + (width or 1)
        pieces.append(raw[at:start])
        at = here
    pieces.append(raw[at:])
    return " ".join(pieces)


def without_drawings(markup: str) -> str:
    """Markup without svg elements."""
    page, at, pieces = Page(markup, markup), 0, []
    for e in page.all("svg", 10_000):
        if e.start >= at:
            pieces.append(markup[at : e.start])
            at = min(len(markup), (markup.find(">", e.end) + 1) or len(markup)) if e.closed else e.body
    return " ".join([*pieces, markup[at:]])


@dataclass(slots=True)
class Element:
    tag: str
    start: int
    body: int  # where its content begins
    end: int  # where its content ends
    closed: bool
    raw: str = ""
    _attributes: dict[str, str] | None = None

    @property
    def attributes(self) -> dict[str, str]:
        if self._attributes is None:
            found: dict[str, str] = {}
            for m in _ATTR.finditer(self.raw):
                found.setdefault(m[1].lower(), decoded(next((v for v in m.groups()[1:] if v is not None), "")))
            self._attributes = found
        return self._attributes

    @property
    def hidden(self) -> bool:
        a = self.attributes
        return "hidden" in a or a.get("aria-hidden", "").startswith("true") or bool(_HIDDEN_CLASS.search(a.get("class", ""))) or bool(_HIDDEN_STYLE.search(a.get("style", "")))


#: An opening tag of one of these ends an open element of its kind.
_ENDS_ITSELF = frozenset("p li dt".split())
_VOID = frozenset("meta link img input".split())


class Page:
    """Markup of at most ``MOST_CHARS`` characters; ``markup`` is without code."""

    def __init__(self, raw: str, markup: str | None = None):
        self.raw = raw[:MOST_CHARS]
        self.markup = without_code(self.raw) if markup is None else markup
        self.low = lowered(self.markup)
        self._found: dict[str, list[Element]] = {}

    @cached_property
    def text(self) -> str:
        """The text of the first ``PLAIN_WINDOW`` characters."""
        return plain(self.markup[: V.PLAIN_WINDOW])

    def elements(self, tag: str, start: int = 0) -> Iterator[Element]:
        """Elements of a tag in document order, found as they are asked for."""
        low, closer = self.low, _Finder(self.low, f"</{tag}")
        before: Element | None = None
        for at, body in _openings(low, tag, start):
            if tag in _VOID:
                yield Element(tag, at, body, body, True, self.markup[at + len(tag) + 1 : body - 1])
                continue
            end = closer(body)
            e = Element(tag, at, body, end if end >= 0 else min(len(low), body + OPEN_CHARS), end >= 0, self.markup[at + len(tag) + 1 : body - 1])
            if before is not None:
                if tag in _ENDS_ITSELF and at < before.end:
                    before.end = at
                yield before
            before = e
        if before is not None:
            yield before

    def all(self, tag: str, most: int = 2_000) -> list[Element]:
        """The first elements of a tag."""
        if tag not in self._found:
            found: list[Element] = []
            for e in self.elements(tag):
                found.append(e)
                if len(found) >= most:
                    break
            self._found[tag] = found
        return self._found[tag][:most]

    def first(self, tag: str) -> Element | None:
        return next(iter(self._found.get(tag) or self.elements(tag)), None)

    def count(self, tag: str, start: int, end: int, most: int) -> int:
        """Opening tags between two places, ``most`` at most; counting stops there."""
        n, head, at = 0, f"<{tag}", self.low.find(f"<{tag}", start, end)
        while at >= 0 and n < most:
            after = at + len(head)
            n += after >= len(self.low) or not (self.low[after].isalnum() or self.low[after] in "-_")
            at = self.low.find(head, after, end)
        return n

    def inner(self, e: Element, most: int = INNER_CHARS) -> str:
        return self.markup[e.body : min(e.end, e.body + most)]

    def said(self, e: Element, most: int) -> str | None:
        """The element's visible text; a text that is one part said over and over is said once."""
        return clipped(heading_text(self.inner(e)), most)

    def meta(self, *names: str) -> str | None:
        for name in names:
            for e in self.all("meta", 200):
                a = e.attributes
                if name in (a.get("name", "").lower(), a.get("property", "").lower(), a.get("itemprop", "").lower()) and a.get("content", "").strip():
                    return a["content"]
        return None

    def facts(self, url: str | None = None) -> dict[str, str | None]:
        """Language of the page, and its canonical address in full where the page's own is known."""
        root = self.first("html")
        lang = root.attributes.get("lang") if root else None
        link = next((e.attributes.get("href") for e in self.all("link", 500) if "canonical" in e.attributes.get("rel", "").lower().split()), None)
        return {"lang": re.split(r"[-_]", lang.strip())[0].lower() or None if lang else None, "canonical": resolved(link, url) if url else link}

    def linked_data(self, most: int = 12) -> list[dict]:
        """Objects of the page's JSON-LD blocks, lists and graphs unwrapped; blocks that can't be
        read are left out."""
        low, out, blocks = lowered(self.raw), [], 0
        closer = _Finder(low, "</script")
        for at, body in _openings(low, "script"):
            if "application/ld+json" not in low[at:body]:
                continue
            end = closer(body)
            if end < 0 or blocks >= most:
                break
            blocks += 1
            try:
                queue = [json.loads(self.raw[body:end])]
            except (ValueError, RecursionError):
                continue
            while queue:
                node = queue.pop(0)
                if isinstance(node, list):
                    queue += node
                elif isinstance(node, dict):
                    out.append(node)
                    queue += node["@graph"] if isinstance(node.get("@graph"), list) else []
        return out


_ARIA_HIDDEN = re.compile(r"<([a-z][a-z0-9-]*)\b[^<>]*aria-hidden\s*=\s*[\"']?true[^<>]*>", re.I)


def without_hidden(fragment: str, most: int = 40_000, passes: int = 8) -> str:
    """A fragment without elements that are hidden from readers, what is nested in them included."""
    if len(fragment) > most:
        return fragment
    for _ in range(passes):
        m = _ARIA_HIDDEN.search(fragment)
        if not m:
            break
        depth, end = 1, m.end()
        for t in re.compile(rf"<(/?){re.escape(m[1])}\b[^<>]*>", re.I).finditer(fragment, m.end()):
            depth += -1 if t[1] else not t[0].endswith("/>")
            if not depth:
                end = t.end()
                break
        fragment = fragment[: m.start()] + " " + fragment[end:]
    return fragment


def heading_text(fragment: str) -> str:
    return repeated_once(plain(without_hidden(fragment)))
