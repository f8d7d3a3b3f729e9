"""HTML to text with paragraph and list breaks."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A line break is put at the start of these elements.
BREAKS = frozenset("br p div li h1 h2 h3 h4 h5 h6 tr".split())
# A space is put at the start and the end of these.
BLOCKS = BREAKS | frozenset(
    "html head title body section article main nav aside header footer hgroup ul ol dl dt dd menu dir pre blockquote hr address figure figcaption "
    "form fieldset details table caption colgroup col thead tbody tfoot th td ins del center video audio canvas template".split()
)


class _Text(HTMLParser):
    def __init__(self, breaks: bool):
        super().__init__(convert_charrefs=True)
        self.breaks, self.parts, self.hidden = breaks, [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in BREAKS and self.breaks:
            self.parts.append("\x01")
        elif tag in BLOCKS:
            self.parts.append(" ")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def _parsed(markup: str, breaks: bool) -> str:
    parser = _Text(breaks)
    parser.feed(markup)
    parser.close()
    return re.sub(r"[ \t\n\r\f]+", " ", "".join(parser.parts)).strip(" ")


def squeezed(text: str) -> str:
    text = re.sub(r"[ \t]+", " ", text.replace(" ", " "))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", text)).strip()


def plain_text(markup: str | None) -> str:
    """Text of an HTML fragment; null and blank ones are empty."""
    if markup is None or not markup.strip():
        return ""
    return squeezed(_parsed(markup, True).replace("\x01", "\n"))


def unescaped_text(escaped: str | None) -> str:
    """Text of an HTML fragment that arrives entity-escaped."""
    return "" if escaped is None else plain_text(_parsed(escaped, False))


@F.arrow_udf(T.StringType())
def html_to_text(a: pa.Array) -> pa.Array:
    return pa.array([plain_text(s) for s in a.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def escaped_html_to_text(a: pa.Array) -> pa.Array:
    return pa.array([unescaped_text(s) for s in a.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def html_parts_to_text(a: pa.Array) -> pa.Array:
    """Texts of the fragments of each row; a null row stays null."""
    return pa.array([None if row is None else [plain_text(s) for s in row] for row in a.to_pylist()], pa.list_(pa.string()))
