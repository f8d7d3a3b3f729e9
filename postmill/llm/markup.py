"""Markup residue: HTML, Markdown, wiki and LaTeX texts become clean text with structure.

A text is unescaped until its notation shows and cut into leaves: pieces of text with a path of the tags or
marks around them and the words in them. A recurrent block labeller (blocks.Labeller, a bidirectional LSTM
over the leaf sequence) gives every leaf a label from the context of the whole document: a line that begins
with '#' is a heading in one document and a list item in another. Labelled leaves are then joined to
elements (a list item may have several leaves) and freed of inline markup.

Labels: heading, list_item, code, formula, text, skip (comments, styles, bare environment marks).

Edge cases: null, empty and blank texts have no elements; texts without markup are text; unclosed and
misplaced tags are closed as browsers do; an unclosed fence or environment runs to the end of the text;
equal elements of one text are one row.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.blocks import LABELS, Labeller
from postmill.session import spread

KINDS = ("heading", "list_item", "code", "formula")
TAG = re.compile(r"</?(p|div|ul|ol|li|h[1-6]|pre|br|table|tr|td|section|article|span|blockquote)\b[^<>]*>", re.I)
ANY_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
BLOCK = frozenset("p div ul ol li h1 h2 h3 h4 h5 h6 pre table tr td th section article blockquote header footer dl dt dd".split())
OWNERS = frozenset("li h1 h2 h3 h4 h5 h6 pre style script".split())
SPACE = re.compile(r"[\s\u00a0\u200b]+")
#: formula delimiters; a dollar opens before and closes after something that is no space, and no digit follows
FORMULA = re.compile(r"\\\((?P<a>.+?)\\\)|\\\[(?P<b>.+?)\\\]|(?<!\\)\$\$(?P<c>.+?)\$\$|(?<![\\$\w])\$(?P<d>[^\s$](?:[^$\n]*?[^\s$\\])?)\$(?![\d$])|<math[^>]*>(?P<e>.+?)</math>", re.S | re.I)
FORMULA_MARK = {"a": "m:(", "b": "m:[", "c": "m:$$", "d": "m:$", "e": "m:math"}


@dataclass
class Leaf:
    path: tuple[str, ...]
    text: str
    owner: int  # leaves of one element share it
    blank_before: bool = True
    blank_after: bool = True
    stretch: int = 0  # leaves of one stretch of text were cut apart at formulas
    raw: str | None = None  # of a formula candidate: with its delimiters


def squeezed(text: str) -> str:
    return SPACE.sub(" ", text).strip()


def unescaped(text: str) -> str:
    """The text freed of whole layers of entity escaping: until tags show, or nothing is left to resolve."""
    while True:  # resolving an entity shortens the text
        if TAG.search(text) or (ANY_TAG.search(text) and not re.search(r"&(?:amp;)*(?:lt|gt);?", text)):
            break
        new = html.unescape(text)
        if new == text:
            break
        text = new
    return text


def notation(text: str) -> str:
    """html, latex, wiki or markdown (also for plain text)."""
    tags = {m[1].lower() for m in TAG.finditer(text)}
    # wiki texts may have code between pre tags
    if tags and not (tags == {"pre"} and re.search(r"^(={2,6}) ?\S.* ?\1\s*$", text, re.M)):
        return "html"
    if re.search(r"\\(?:(?:sub)*section\*?\{|begin\{|item\b|textbf\{|emph\{|texttt\{|href\{)", text):
        return "latex"
    if re.search(r"^={2,6} .*\S ={2,6}\s*$|'''|''\S|\[\[|<(?:syntaxhighlight|source|math|nowiki)\b|^[*#]{2,} ", text, re.M) and not re.search(r"^#{2,6} |^```|^~~~", text, re.M):
        return "wiki"
    return "markdown"


class _Html(HTMLParser):
    """Leaves of an HTML text; a block's own text is one leaf, split at formula delimiters."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []  # (path element, owner)
        self.leaves: list[Leaf] = []
        self.text: list[str] = []
        self.count = 0

    def flush(self) -> None:
        text = "".join(self.text)
        self.text = []
        if text.strip():
            self.count += 1
            # list items, headings and code own all their text; other text stands by itself
            owner = next((o for t, o in reversed(self.stack) if t in OWNERS or t.endswith("@heading")), self.count)
            self.leaves.append(Leaf(tuple(t for t, _ in self.stack), text, owner, stretch=self.count))

    def pop_to(self, tags: set[str], stop: set[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            t = self.stack[i][0].split("@")[0]
            if t in tags:
                self.flush()
                del self.stack[i:]
                return
            if t in stop:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK or tag in ("style", "script"):
            self.flush()
            self.pop_to({"p"}, BLOCK - {"p"})
            if tag == "li":
                self.pop_to({"li"}, {"ul", "ol"})
            if tag[0] == "h" and tag[1:].isdigit():
                self.pop_to({f"h{i}" for i in range(1, 7)}, {"li", "div"})
            self.count += 1
            heading = dict(attrs).get("role") == "heading"
            self.stack.append((tag + ("@heading" if heading else ""), self.count))
        elif tag == "br":
            self.text.append("\n")
        elif tag == "math":  # kept as a delimiter
            self.text.append("<math>")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.text.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK or tag in ("style", "script"):
            if any(t.split("@")[0] == tag for t, _ in self.stack):
                stop = {"ul", "ol"} - {tag} if tag == "li" else set()
                self.pop_to({tag}, stop)
        elif tag == "math":
            self.text.append("</math>")

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def handle_comment(self, data: str) -> None:
        self.flush()
        self.count += 1
        self.leaves.append(Leaf((*(t for t, _ in self.stack), "comment"), data, self.count))


def html_leaves(text: str) -> list[Leaf]:
    parser = _Html()
    parser.feed(text)
    parser.close()
    parser.flush()
    return parser.leaves


FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([\w+-]*)\s*$")
TAG_CODE = re.compile(r"^\s*<(syntaxhighlight|source|pre)\b[^>]*>(.*)$", re.I)
ENV = re.compile(r"^\s*\\begin\{(verbatim|lstlisting|minted|equation|align|gather|displaymath|math)\*?\}(?:\[[^\]]*\])?(.*)$")
MARK = re.compile(r"^(\s*)(?:([-*+])|(\d{1,9}[.)])|([*#:;]+))[ \t]+(\S.*)$")
HEAD = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*(.+?)[ \t]*\1[ \t]*$")
UNDERLINE = re.compile(r"^(=+|-{2,})[ \t]*$")
COMMAND = re.compile(r"^\s*\\((?:sub)*section|paragraph|chapter)\*?\{(.*)\}\s*$")
ITEM = re.compile(r"^\s*\\item(?:\[[^\]]*\])?\s+(.*)$")
BARE = re.compile(r"^\s*\\(?:begin|end)\{[^}]*\}\s*$")


def line_leaves(text: str) -> list[Leaf]:
    """Leaves of a line-oriented notation; which one it is, the labeller finds out."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out: list[Leaf] = []
    i, n, owner = 0, len(lines), 0
    after_item = False

    def add(path: tuple[str, ...], body: str, start: int, end: int) -> None:
        nonlocal owner
        owner += 1
        if body.strip() or path[0] == "comment":
            out.append(Leaf(path, body, owner, start == 0 or not lines[start - 1].strip(), end >= n or not lines[end].strip()))

    def until(closing: re.Pattern, first: str) -> tuple[str, int]:
        """Text up to a closing mark, and the next line; without one the rest belongs to it."""
        rows, j = [first], i + 1
        while True:
            if m := closing.search(rows[-1]):
                rows[-1] = rows[-1][: m.start()]
                return "\n".join(rows), j
            if j >= n:
                return "\n".join(rows), j
            rows.append(lines[j])
            j += 1

    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        if m := FENCE.match(line):
            close = re.compile(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$")
            j = next((k for k in range(i + 1, n) if close.match(lines[k])), n)
            add(("fence",), "\n".join(lines[i + 1 : j]), i, j + 1)
            i, after_item = j + 1, False
            continue
        if m := TAG_CODE.match(line):
            body, j = until(re.compile(rf"</{m[1]}\s*>", re.I), m[2])
            add(("tag:" + m[1].lower(),), body, i, j)
            i, after_item = j, False
            continue
        if m := ENV.match(line):
            body, j = until(re.compile(rf"\\end\{{{m[1]}\*?\}}"), m[2])
            add(("env:" + m[1],), body, i, j)
            i, after_item = j, False
            continue
        if "<!--" in line and line.lstrip().startswith("<!--"):
            body, j = until(re.compile("-->"), line.lstrip()[4:])
            add(("comment",), body, i, j)
            i = j
            continue
        if m := re.match(r"^\s*(\$\$|\\\[)\s*(.*)$", line):
            close = re.compile(r"\$\$" if m[1] == "$$" else r"\\\]")
            body, j = until(close, m[2])
            add((FORMULA_MARK["c" if m[1] == "$$" else "b"], "block"), body, i, j)
            i, after_item = j, False
            continue
        if m := COMMAND.match(line):
            add(("cmd:section",), m[2], i, i + 1)
            i, after_item = i + 1, False
            continue
        if BARE.match(line):
            add(("env",), line, i, i + 1)
            i += 1
            continue
        if m := ITEM.match(line):
            j = i + 1
            body = [m[1]]
            while j < n and lines[j].strip() and not re.match(r"^\s*\\", lines[j]):
                body.append(lines[j].strip())
                j += 1
            add(("cmd:item",), " ".join(body), i, j)
            i = j
            continue
        m = MARK.match(line)
        if re.match(r"^(?: {4}|\t)", line) and not after_item and (i == 0 or not lines[i - 1].strip()):
            j = i
            while j < n and (re.match(r"^(?: {4}|\t)", lines[j]) or not lines[j].strip() and j + 1 < n and re.match(r"^(?: {4}|\t)", lines[j + 1])):
                j += 1
            add(("indent",), "\n".join(lines[i:j]), i, j)
            i = j
            continue
        if m and (m[2] or m[3] or m[4]):
            mark = m[2] or ("1." if m[3] else m[4][:3])
            closed = HEAD.match(line)  # hashes may also close a heading
            j, body = i + 1, [closed[2] if closed else m[5]]
            while j < n and re.match(r"^(?: {2,}|\t)\S", lines[j]) and not MARK.match(lines[j]):
                body.append(lines[j].strip())
                j += 1
            add(("mark:" + mark, "deep" if m[1] else "top"), " ".join(body), i, j)
            i, after_item = j, not closed
            continue
        after_item = False
        if m := HEAD.match(line):
            add(("mark:" + m[1][:3],), m[2], i, i + 1)
            i += 1
            continue
        if m := WIKI_HEAD.match(line):
            add(("equals",), m[2], i, i + 1)
            i += 1
            continue
        if i + 1 < n and UNDERLINE.match(lines[i + 1]):
            add(("underlined", lines[i + 1].strip()[0]), line, i, i + 2)
            i += 2
            continue
        j = i + 1
        while j < n and lines[j].strip() and not (MARK.match(lines[j]) or HEAD.match(lines[j]) or WIKI_HEAD.match(lines[j]) or FENCE.match(lines[j]) or TAG_CODE.match(lines[j]) or ENV.match(lines[j]) or COMMAND.match(lines[j]) or BARE.match(lines[j]) or re.match(r"^\s*(?:\$\$|\\\[)", lines[j])) and not (j + 1 < n and UNDERLINE.match(lines[j + 1])):
            j += 1
        add(("par",), "\n".join(lines[i:j]), i, j)
        i = j
    return out


VERBATIM = frozenset(("pre", "style", "script", "comment", "fence", "indent", "env", "block", "env:verbatim", "env:lstlisting", "env:minted", "env:equation", "env:align", "env:gather", "env:displaymath", "env:math", "tag:syntaxhighlight", "tag:source", "tag:pre"))


def split_formulas(leaves: list[Leaf]) -> list[Leaf]:
    """Formula candidates within text become leaves of their own, of the same owner."""
    out = []
    for leaf in leaves:
        if not VERBATIM.isdisjoint(leaf.path) or not re.search(r"[$\\]|<math", leaf.text):
            out.append(leaf)
            continue
        cut = lambda path, text, raw=None: out.append(Leaf(path, text, leaf.owner, leaf.blank_before, leaf.blank_after, leaf.stretch, raw)) if text.strip() else None
        last = 0
        for m in FORMULA.finditer(leaf.text):
            cut(leaf.path, leaf.text[last : m.start()])
            cut((*leaf.path, FORMULA_MARK[m.lastgroup]), m[m.lastgroup], m.group())
            last = m.end()
        cut(leaf.path, leaf.text[last:])
    return out


def leaves_of(text: str) -> tuple[str, list[Leaf]]:
    """The notation and the leaf sequence of a text."""
    text = unescaped(text)
    kind = notation(text)
    return kind, split_formulas(html_leaves(text) if kind == "html" else line_leaves(text))


def _markdown(s: str) -> str:
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m[1])
        return f"\x00{len(held) - 1}\x00"

    s = re.sub(r"(?<!`)`{2}(?!`)\s?(.+?)\s?(?<!`)`{2}(?!`)|(?<!`)`(?!`)([^`\n]+)`(?!`)", lambda m: (held.append(m[1] or m[2]), f"\x00{len(held) - 1}\x00")[1], s)
    s = re.sub(r"\\([!-/:-@\[-`{-~])", hold, s)
    s = re.sub(r"!?\[([^\]]*)\]\((?:[^()\s]|\([^()]*\))*(?:\s+\"[^\"]*\")?\)", r"\1", s)
    for mark in (r"\*\*\*", r"\*\*", r"\*"):
        s = re.sub(rf"(?<![*\w]){mark}(?=\S)([^*\n]+?)(?<=\S){mark}(?![*\w])", r"\1", s)
    for mark in ("___", "__", "_"):
        s = re.sub(rf"(?<![_\w]){mark}(?=\S)([^_\n]+?)(?<=\S){mark}(?![_\w])", r"\1", s)
    s = re.sub(r"~~(\S(?:.*?\S)?)~~", r"\1", s)
    s = re.sub(r"</?(?:b|i|u|em|strong|code|span|a|sub|sup|br)\b[^<>]*>", "", s, flags=re.I)
    s = html.unescape(s)
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], s)


def _wiki(s: str) -> str:
    held: list[str] = []
    s = re.sub(r"<nowiki>(.*?)</nowiki>", lambda m: (held.append(m[1]), f"\x00{len(held) - 1}\x00")[1], s, flags=re.S)
    s = re.sub(r"<ref[^>]*/>|<ref[^>]*>.*?</ref>", "", s, flags=re.S)
    s = re.sub(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]", r"\1", s)
    s = re.sub(r"\[(?:https?|mailto|ftp):\S+?(?:\s+([^\]]*))?\]", lambda m: m[1] or "", s)
    s = re.sub(r"'{5}(.+?)'{5}|'{3}(.+?)'{3}|'{2}(.+?)'{2}", lambda m: m[1] or m[2] or m[3], s)
    s = re.sub(r"'{2,3}(.+?)'{2,3}", r"\1", s)
    s = re.sub(r"</?(?:b|i|u|em|strong|code|tt|span|small|sub|sup|br|kbd|var)\b[^<>]*>", "", s, flags=re.I)
    s = html.unescape(s)
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], s)


def _latex(s: str) -> str:
    s = re.sub(r"(?<!\\)%.*", "", s)
    while True:  # from the innermost command outwards
        new = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", s)
        new = re.sub(r"\\(?:text[a-z]{2}|emph|underline|mbox|texttt|textnormal|url)\{([^{}]*)\}", r"\1", new)
        if new == s:
            break
        s = new
    s = re.sub(r"\\(?:text)?(?:ldots|dots)\b\{?\}?", "…", s)
    s = s.replace("\\textasciitilde{}", "~").replace("\\textbackslash{}", "\\").replace("\\\\", " ")
    s = re.sub(r"(?<!\\)~", " ", s)
    s = re.sub(r"\\([&%#_${} ])", r"\1", s)
    return html.unescape(s)


PLAIN = {"html": lambda s: s, "markdown": _markdown, "wiki": _wiki, "latex": _latex}


def elements(kind: str, leaves: list[Leaf], labels: list[str], inline: bool = False) -> list[tuple[str, str]]:
    """(label, body) of the elements in order, text included, skipped leaves left out.

    A formula within an element is part of its body and also an element; with ``inline`` it is only the former,
    between dollars.
    """
    plain = PLAIN[kind]
    out: list[list] = []
    at: dict[int, tuple[int, int]] = {}  # owner to its element and the last stretch in it
    for leaf, label in zip(leaves, labels):
        if label == "skip":
            continue
        if label == "code":
            out.append(["code", leaf.text])
            continue
        if label == "formula":
            body = f"$ {leaf.text.strip()} $" if inline else leaf.text
            if not inline:
                out.append(["formula", leaf.text])
        else:
            body = plain(leaf.text if leaf.raw is None else leaf.raw)
        k, stretch = at.get(leaf.owner, (None, None))
        own = "text" if label == "formula" and inline else "" if label == "formula" else label
        if k is None:
            k = len(out)
            out.append([own, body])
        else:
            if label != "formula":
                out[k][0] = label
            out[k][1] += ("" if stretch == leaf.stretch else " ") + body
        at[leaf.owner] = (k, leaf.stretch)
    return [(a, b) for a, b in ((label, squeezed(body)) for label, body in out) if a and b]


def _found(labeller: Labeller, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids = batch.column("id").slice(at, 256).to_pylist()
                docs = [leaves_of(t) if t and t.strip() else ("markdown", []) for t in batch.column("text").slice(at, 256).to_pylist()]
                labels = labeller.label([leaves for _, leaves in docs])
                parts = [elements(kind, leaves, ls, whole) for (kind, leaves), ls in zip(docs, labels)]
                if whole:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([rendered(p) for p in parts], pa.string())], names=["id", "text"])
                    continue
                rows = list(dict.fromkeys((i, k, b) for i, p in zip(ids, parts) for k, b in p if k in KINDS))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["id", "kind", "body"])

    return run


def rendered(parts: list[tuple[str, str]]) -> str:
    """Clean text: '# ' before headings, '- ' before list items, code indented; formulas stand between dollars."""
    marks = {"heading": "# {}", "list_item": "- {}", "code": "    {}"}
    return "\n".join(marks.get(k, "{}").format(b) for k, b in parts)


def found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, body) of the structural elements."""
    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(_found(Labeller.trained(), False), "id long, kind string, body string").distinct()


def clean_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with the structure kept as plain marks."""
    rows = spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(_found(Labeller.trained(), True), "id long, text string")


assert set(KINDS) < set(LABELS)
