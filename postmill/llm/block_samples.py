"""Texts with known structure for training the block labeller: written by a generator that knows what each block is.

A sample is a sequence of blocks, each of a kind, with a marker word (``qz17``) in every stretch of its text; it is
spelled out in one of the notations and in one of the ways that notation has for the kind. The label of a leaf is
the kind of the block whose marker it holds, so labels come from what was meant, not from the marks that were read.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import replace

from postmill.llm.markup import Leaf, leaves_of

NOTATIONS = ("html", "markdown", "wiki", "latex")
VARIABLES = ("x", "n", "a", "E", "q_1", "x_{12}", "\\beta", "97", "2k")
_WHOLE = re.compile(r"qz_\{\d+\}|qz\d+", re.I)
MARKER = re.compile(r"qz_?\{?(\d+)", re.I)
WORDS = (
    "anchor basin candle dust ember ferry gravel harbour island jacket kettle lantern meadow needle orchard paper quarry river saddle timber "
    "umbrella valley window yarn zinc Apples Bridges Carts Doors Engines Farms über für können gründlich équipe année señal mañana zażółć "
    "работа команда 2024 17 3.5 C++ B2B A/B and the of with to in we you or if"
).split()
FORMULAS = ("qz_{N}", "a + qz_{N}", "qz_{N} = mc^2", "\\frac{qz_{N}}{b} \\leq c_1", "\\alpha_i + qz_{N}", "O(qz_{N} \\log n)", "f(x) = qz_{N}", "\\sum_{i=1}^{9} qz_{N} x_i", "x^2 + qz_{N}^2 < z_3")
CODE = ("def f(x):\n    return x  # qzN", "x = 1\ny = [qzN]", "SELECT a FROM qzN\nWHERE b > 2;", "#!/bin/sh\necho qzN | wc -c", "key: qzN\n  - item\n  - # note", "# qzN\nmake all", "* qzN *\n- not a list\n# nor a heading", "if (a < b && c) { qzN(); }")


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng, self.kinds, self.lines = rng, {}, []

    def pick(self, *options):
        return self.rng.choice(options)

    def mark(self, kind: str) -> int:
        self.kinds[len(self.kinds)] = kind
        return len(self.kinds) - 1

    def words(self, n: int, lo: int = 0, hi: int = 14) -> str:
        w = [self.rng.choice(WORDS) for _ in range(self.rng.randint(lo, hi))]
        w.insert(self.rng.randint(0, len(w)), f"qz{n}")
        if self.rng.random() < 0.5:
            w[0] = w[0][:1].upper() + w[0][1:]
        return " ".join(w) + self.pick("", "", ".", ":", "?")

    def formula(self) -> str:
        return self.pick(*FORMULAS).replace("N", str(self.mark("formula")))

    def code(self) -> str:
        return self.pick(*CODE).replace("N", str(self.mark("code")))

    def text(self, kind: str, wrap, lo: int = 1, hi: int = 14) -> str:
        """Words of a block, now and then with a formula inside; every stretch has the marker."""
        n = self.mark(kind)
        out = self.words(n, lo, hi)
        if self.rng.random() < 0.12:
            out = f"{out} {wrap(self.formula())} {self.words(n, 1, 6)}"
        return out


class _Html(_Writer):
    def inside(self, f: str) -> str:
        return self.pick("\\({}\\)", "\\[{}\\]", "$${}$$", "${}$", "<math>{}</math>").replace("{}", html.escape(f))

    def block(self, kind: str, depth: int = 0) -> None:
        end = lambda tag: "" if tag in ("li", "p") and self.rng.random() < 0.15 else f"</{tag}>"
        if kind == "heading":
            tag = self.pick("h1", "h2", "h3", "h4", "h5", "h6", "role")
            text = self.text(kind, self.inside, 0, 7)
            self.lines.append(f'<div role="heading" aria-level="2">{text}</div>' if tag == "role" else f"<{tag}>{text}</{tag}>")
        elif kind == "list_item":
            kind_of = self.pick("ul", "ol")
            self.lines.append(f"<{kind_of}>")
            for _ in range(self.rng.randint(1, 5)):
                text = self.text(kind, self.inside)
                self.lines.append("<li>" + (f"<p>{text}</p>" if self.rng.random() < 0.2 else text))
                if depth < 2 and self.rng.random() < 0.2:
                    self.block("list_item", depth + 1)
                if self.rng.random() < 0.9:
                    self.lines.append("</li>")
            self.lines.append(f"</{kind_of}>")
        elif kind == "code":
            self.lines.append(f"<pre>{self.pick('', '<code>')}{html.escape(self.code())}{self.pick('', '</code>')}</pre>")
        elif kind == "formula":
            tag = self.pick("p", "div", "section", "blockquote")
            self.lines.append(f"<{tag}>{self.inside(self.formula())}</{tag}>")
        elif kind == "skip":
            n = self.mark("skip")
            self.lines.append(self.pick(f"<!-- {self.words(n)} -->", f"<style>.qz{n} > li {{ color: red }}</style>", f"<script>var qz{n} = 1;</script>"))
        else:
            tag = self.pick("p", "p", "div", "section", "article", "blockquote", "td", "dd")
            text = self.text(kind, self.inside)
            self.lines.append(f"<table><tr><td>{text}</td></tr></table>" if tag == "td" else f"<{tag}>{text}{end(tag)}")

    def done(self) -> str:
        out = self.pick("\n", "").join(self.lines)
        if self.rng.random() < 0.2:
            out = f"<div>{out}</div>"
        for _ in range(self.pick(0, 0, 1, 2)):
            out = html.escape(out)
        return out


class _Lines(_Writer):
    """Notations of lines: blocks apart by empty lines, most of the time."""

    def put(self, *rows: str, apart: float = 0.8) -> None:
        self.lines += rows
        if self.rng.random() < apart:
            self.lines.append("")

    def done(self) -> str:
        return self.pick("\n", "\n", "\r\n").join("\n".join(self.lines).split("\n"))


class _Markdown(_Lines):
    def inside(self, f: str) -> str:
        return self.pick("${}$", "$${}$$", "\\({}\\)").replace("{}", f)

    def block(self, kind: str) -> None:
        if kind == "heading":
            text = self.text(kind, self.inside, 0, 7)
            way = self.pick("#", "#", "##", "###", "####", "#####", "######", "# #", "=", "-")
            if way in "=-":
                self.put("", text, way * self.rng.randint(3, 12))
            else:
                self.put(f"{way.split()[0]} {text}" + (" #" * (" " in way)), apart=0.7)
        elif kind == "list_item":
            mark = self.pick("-", "*", "+", "1.", "1)")
            for i in range(self.rng.randint(1, 6)):
                here = f"{i + 1}{mark[1]}" if mark[0] == "1" else mark
                self.lines.append(f"{here} {self.text(kind, self.inside)}")
                if self.rng.random() < 0.15:
                    self.lines += [f"{self.pick('  ', '    ')}{self.pick('-', '*', '+')} {self.text(kind, self.inside)}" for _ in range(self.rng.randint(1, 3))]
            self.lines.append("")
        elif kind == "code":
            way = self.pick("```", "~~~", "````", "    ")
            body = self.code()
            if way == "    ":
                # a paragraph before it, as after a list it would belong to the list
                self.put("", self.text("text", self.inside), apart=1)
                self.put(*["    " + r for r in body.split("\n")], apart=1)
            else:
                self.put(way + self.pick("", "python", "sh", " sql"), body, way)
        elif kind == "formula":
            self.put("", *self.pick(("$$", self.formula(), "$$"), (f"$${self.formula()}$$",), ("\\[", self.formula(), "\\]")), "", apart=1)
        elif kind == "skip":
            self.put("", f"<!-- {self.words(self.mark(kind))} -->", "", apart=1)
        else:
            self.put("", self.text(kind, self.inside), *[self.words(len(self.kinds) - 1)] * self.pick(0, 0, 1), "", apart=1)


class _Wiki(_Lines):
    def inside(self, f: str) -> str:
        return f"<math>{f}</math>"

    def block(self, kind: str) -> None:
        if kind == "heading":
            e = "=" * self.rng.randint(2, 5)
            self.put(f"{e}{self.pick(' ', ' ', '')}{self.text(kind, self.inside, 0, 7)} {e}", apart=0.4)
        elif kind == "list_item":
            mark = self.pick("*", "#", "*", "#", ":", ";")
            # a numbered list of one item is hardly ever written
            for _ in range(self.rng.randint(1 if mark != "#" else 2, 6)):
                self.lines.append(f"{mark} {self.text(kind, self.inside)}")
                if self.rng.random() < 0.2:
                    self.lines += [f"{mark}{self.pick('*', '#')} {self.text(kind, self.inside)}" for _ in range(self.rng.randint(1, 3))]
            self.lines.append("")
        elif kind == "code":
            tag = self.pick("syntaxhighlight", "source", "pre")
            self.put(f"<{tag}{self.pick('', ' lang=sh')}>", self.code(), f"</{tag}>")
        elif kind == "formula":
            self.put("", f"<math>{self.formula()}</math>", "", apart=1)
        elif kind == "skip":
            self.put("", f"<!-- {self.words(self.mark(kind))} -->", "", apart=1)
        else:
            self.put("", self.text(kind, self.inside) + self.pick("", "", " '''bold'''", " [[link]]"), "", apart=1)


class _Latex(_Lines):
    def inside(self, f: str) -> str:
        return self.pick("${}$", "\\({}\\)").replace("{}", f)

    def block(self, kind: str) -> None:
        if kind == "heading":
            self.put(f"\\{self.pick('section', 'subsection', 'subsubsection', 'section*', 'subsection*', 'paragraph', 'chapter')}{{{self.text(kind, self.inside, 0, 7)}}}")
        elif kind == "list_item":
            env = self.pick("itemize", "enumerate")
            self.put(f"\\begin{{{env}}}", *[f"{self.pick('', '  ')}\\item{self.pick('', '', '[a]')} {self.text(kind, self.inside)}" for _ in range(self.rng.randint(1, 6))], f"\\end{{{env}}}")
        elif kind == "code":
            env = self.pick("verbatim", "lstlisting", "minted")
            self.put(f"\\begin{{{env}}}", self.code(), f"\\end{{{env}}}")
        elif kind == "formula":
            env = self.pick("equation", "align", "gather", "displaymath", "equation*", "[", "$$")
            self.put("", *(("\\[", self.formula(), "\\]") if env == "[" else ("$$", self.formula(), "$$") if env == "$$" else (f"\\begin{{{env}}}", self.formula(), f"\\end{{{env}}}")), "")
        elif kind == "skip":
            self.put("", self.pick("\\begin{center}", "\\end{center}", "\\begin{document}"), "")
        else:
            self.put("", self.text(kind, self.inside) + self.pick("", "", " \\emph{x}", " \\textbf{y}"), "", apart=1)


WRITERS = {"html": _Html, "markdown": _Markdown, "wiki": _Wiki, "latex": _Latex}


def sample(rng: random.Random, notation: str) -> tuple[str, dict[int, str]]:
    """A text and the kind of each of its markers."""
    w = WRITERS[notation](rng)
    only = rng.random() < 0.15  # some texts have few kinds
    kinds = rng.sample(["heading", "list_item", "text", "code"], 2) if only else ["heading", "heading", "list_item", "list_item", "text", "text", "text", "code", "formula", "skip"]
    if notation == "markdown" and rng.random() < 0.15:
        kinds = ["text"]  # plain
    for _ in range(rng.randint(1, 9)):
        w.block(rng.choice(kinds))
    return w.done(), w.kinds


def labelled(rng: random.Random, notation: str) -> tuple[list[Leaf], list[str]]:
    """Leaves and labels of a sample that is read as it was meant: in its notation, every marker in a leaf of its own
    block. Others are passed over. Words and variables take the markers' places in the end."""
    while True:
        text, kinds = sample(rng, notation)
        read, leaves = leaves_of(text)
        labels = _labels(leaves, kinds)
        # a text with nothing of its notation in it is plain, which is read as Markdown
        if leaves and labels and (read == notation or set(labels) <= {"text"}):
            plain = lambda label: lambda m: rng.choice(VARIABLES if label == "formula" else WORDS)
            return [replace(leaf, text=_WHOLE.sub(plain(label), leaf.text)) for leaf, label in zip(leaves, labels)], labels


def _labels(leaves: list[Leaf], kinds: dict[int, str]) -> list[str] | None:
    out = []
    for leaf in leaves:
        own = {kinds.get(int(n)) for n in MARKER.findall(leaf.text)}
        if len(own) > 1:
            return None
        # the only leaves without a marker are environment marks, which are left out
        out.append(own.pop() if own else "skip")
    return None if None in out else out
