"""What pages say outside their chrome, and the attributes of their elements, from one scan of a page's tags."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Elements without content, whose start tag opens nothing.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
# Elements whose own text is no text of the page.
SILENT = frozenset(("script", "style", "template", "rt", "rp"))


class Scan(HTMLParser):
    """Open elements by depth, and the runs of text between tags and comments that none of the dropped elements holds.

    An end tag closes the nearest open element of its name and all within it; without one it closes
    nothing. Text counts within the first body if there is one, else everywhere.
    """

    def __init__(self, tags: frozenset[str] = frozenset(), classes: frozenset[str] = frozenset(), attributes: frozenset[str] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.tags, self.classes, self.attributes = tags, classes, attributes
        self.open: list[str] = []
        self.counts: dict[str, int] = {}
        self.dropped_at: int | None = None  # depth of the outermost dropped element
        self.body_at: int | None = None
        self.had_body = self.in_body = False
        self.everywhere: list[str] = []
        self.in_first_body: list[str] = []
        self.run: list[str] = []

    def dropped(self, tag: str, attrs) -> bool:
        if tag in self.tags:
            return True
        for name, value in attrs:
            if name in self.attributes or (name == "class" and value and not self.classes.isdisjoint(value.split())):
                return True
        return False

    def handle_starttag(self, tag, attrs):
        self.end_run()
        if tag in VOID:
            return
        self.open.append(tag)
        self.counts[tag] = self.counts.get(tag, 0) + 1
        if self.dropped_at is None:
            if self.dropped(tag, attrs):
                self.dropped_at = len(self.open)
            elif tag == "body" and not self.had_body:
                self.had_body = self.in_body = True
                self.body_at = len(self.open)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.end_run()
        if not self.counts.get(tag):
            return
        while True:
            name = self.open.pop()
            self.counts[name] -= 1
            if self.dropped_at is not None and len(self.open) < self.dropped_at:
                self.dropped_at = None
            if self.in_body and len(self.open) < self.body_at:
                self.in_body = False
            if name == tag:
                return

    def handle_data(self, data):
        self.run.append(data)

    def handle_comment(self, data):
        self.end_run()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self.end_run()
        if data.startswith("CDATA["):
            self.run.append(data[6:])
            self.end_run()

    def end_run(self):
        if not self.run:
            return
        if self.dropped_at is None and (not self.open or self.open[-1] not in SILENT):
            text = "".join(self.run)
            (self.in_first_body if self.in_body else self.everywhere if not self.had_body else []).append(text)
        self.run = []

    def text(self) -> str:
        return "\n".join(self.in_first_body if self.had_body else self.everywhere)


def collapsed(text: str) -> str:
    """Blanks folded, lines trimmed, empty lines dropped."""
    if "\t" in text or "  " in text:
        text = re.sub(r"[ \t]{2,}|\t", " ", text)
    return "\n".join([x for line in text.splitlines() if (x := line.strip())])


def body_text(html: str, tags: frozenset[str], classes: frozenset[str], attributes: frozenset[str]) -> str:
    scan = Scan(tags, classes, attributes)
    scan.feed(html)
    scan.close()
    scan.end_run()
    return collapsed(scan.text())


class Marked(HTMLParser):
    """Attributes of the elements of a class that have a certain attribute, in document order."""

    def __init__(self, name: str, required: str):
        super().__init__(convert_charrefs=True)
        self.name, self.required = name, required
        self.found: list[dict[str, str]] = []

    def handle_starttag(self, tag, attrs):
        have = {k: v or "" for k, v in attrs}
        if self.required in have and self.name in have.get("class", "").split():
            self.found.append(have)


def marked_elements(html: str, name: str, required: str) -> list[dict[str, str]]:
    scan = Marked(name, required)
    scan.feed(html)
    scan.close()
    return scan.found
