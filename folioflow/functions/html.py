"""What one page of HTML holds, as plain Python values.

A small helper around the standard library parser; Spark partitions the pages
and calls it once per page.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Fixed values of the page contract.
CONTAINER_CLASSES = ("judgments", "judgment")
COURT_CLASS = "docsource_main"
NOISE_TAGS = frozenset(("script", "style", "noscript", "nav", "header", "footer", "form", "iframe"))
NOISE_CLASSES = ("ad", "advertisement", "share", "navigation", "breadcrumb", "sidebar", "menu", "social")
PARAGRAPH_TAGS = frozenset(("p", "blockquote"))
VOID_TAGS = frozenset(
    ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
)
# A start tag of one of these ends an open <p>.
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
)


def squash(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class PageReader(HTMLParser):
    """Collects paragraphs, title, headings and marked elements of a page."""

    def __init__(self, whole_token: bool = False):
        super().__init__(convert_charrefs=True)
        self.whole_token = whole_token
        self.stack: list[dict] = []
        self.paragraphs: list[tuple[int, str, int, bool]] = []
        self.headings: list[str] = []
        self.title: str | None = None
        self.court: str | None = None
        self.containers: dict[str, int] = {}
        self.counter = 0
        self.started = 0

    def _noisy(self, tag: str, classes: list[str]) -> bool:
        if tag in NOISE_TAGS:
            return True
        joined = " ".join(classes).lower()
        if self.whole_token:
            return any(word in NOISE_CLASSES for word in joined.split())
        return any(word in joined for word in NOISE_CLASSES)

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            self.handle_data(" ")
            return
        if tag in BLOCK_TAGS:
            self._close_open("p", stop=("blockquote", "div", "article", "section", "body"))
        classes = (dict(attrs).get("class") or "").split()
        parent = self.stack[-1] if self.stack else None
        frame = {
            "tag": tag,
            "classes": classes,
            "text": [],
            "noise": bool(parent and parent["noise"]) or self._noisy(tag, classes),
            "in_body": tag == "body" or bool(parent and parent["in_body"]),
            "container": parent["container"] if parent else 0,
            "start": self.started,
        }
        self.started += 1
        if not frame["noise"]:
            for name in CONTAINER_CLASSES:
                if name in classes and name not in self.containers:
                    self.counter += 1
                    self.containers[name] = self.counter
                    frame["container"] = frame["container"] | (1 << self.counter)
        self.stack.append(frame)

    def handle_startendtag(self, tag, attrs):
        self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag not in VOID_TAGS and any(frame["tag"] == tag for frame in self.stack):
            while self._close()["tag"] != tag:
                pass

    def _close_open(self, tag: str, stop: tuple[str, ...]) -> None:
        """Close an open ``tag`` unless one of ``stop`` lies in between."""
        for depth in range(len(self.stack) - 1, -1, -1):
            name = self.stack[depth]["tag"]
            if name == tag:
                while len(self.stack) > depth:
                    self._close()
                return
            if name in stop:
                return

    def _close(self) -> dict:
        frame = self.stack.pop()
        text = squash(" ".join(frame["text"]))
        tag = frame["tag"]
        if tag in PARAGRAPH_TAGS and not frame["noise"]:
            if text:
                self.paragraphs.append((frame["start"], text, frame["container"], frame["in_body"]))
        elif self.stack and not frame["noise"] and tag != "title":
            self.stack[-1]["text"].append(" ".join(frame["text"]))
        if tag == "title" and self.title is None:
            self.title = text
        if tag in ("h2", "h3") and text:
            self.headings.append(text)
        if COURT_CLASS in frame["classes"] and self.court is None and text:
            self.court = text
        return frame

    def handle_data(self, data):
        # Text of noisy elements belongs to nothing, whatever is around them.
        if self.stack and not self.stack[-1]["noise"]:
            self.stack[-1]["text"].append(data)

    def finish(self) -> None:
        self.close()
        while self.stack:
            self._close()


def read_page(html: str, min_chars: int, whole_token: bool = False) -> dict:
    """Paragraph texts and metadata of one page.

    ``paragraphs`` are those of the first container class present, else those
    of the body, in the order in which they start; text of a nested paragraph
    belongs to the innermost one, text of a noisy element to none.
    """
    reader = PageReader(whole_token)
    reader.feed(html)
    reader.finish()
    bit = None
    for name in CONTAINER_CLASSES:
        if name in reader.containers:
            bit = 1 << reader.containers[name]
            break
    paragraphs = [
        text
        for _, text, held, in_body in sorted(reader.paragraphs)
        if (in_body if bit is None else held & bit) and len(text) >= min_chars
    ]
    return {
        "has_container": bit is not None,
        "paragraphs": paragraphs,
        "title": reader.title,
        "court": reader.court,
        "headings": reader.headings,
    }
