import html
import random

import numpy as np
import pytest

from postmill.llm import markup as M
from postmill.llm import blocks as B
from postmill.llm.block_samples import MARKER, NOTATIONS, _labels, labelled, sample
from postmill.llm.blocks import LABELS, Batch, Labeller
from postmill.llm.train_blocks import accuracy, fitted

HTML = """<style>.a > li { color: red; }</style><!-- <h2>draft</h2> --><h2 class="x">About R&amp;D</h2><p>Text with \\(a^2 &lt; b\\) here. Pay runs from $4 to $97 an hour.
<ul><li>One <b>bold</b><ul><li>Deep&nbsp;one<li><p>Deep two</p></ul><li>Two <code>x_y</code></ul><pre><code>if (a &lt; b) {
  go();
}</code></pre><div role="heading">Last words</div><p>\\[E = \\frac{a}{b}\\]</p>"""
HTML_FOUND = {
    ("heading", "About R&D"), ("formula", "a^2 < b"), ("list_item", "One bold"), ("list_item", "Deep one"), ("list_item", "Deep two"), ("list_item", "Two x_y"),
    ("code", "if (a < b) { go(); }"), ("heading", "Last words"), ("formula", "E = \\frac{a}{b}"),
}
MARKDOWN = """# Top *part* #

Some 4 \\* 26 hours, crew_list_2 and **bold**. We use C# and $\\sqrt{2}$ here. Pay from $16 to $71.

Under
-----

1. First [link](https://x.example/a?b=1)
2. Second `code_x`
    - Deep & R&D

### Code

    def f(x):
        # skip
        return x

```text
- not a list
```

$$
p = e^{-1}
$$"""
MARKDOWN_FOUND = {
    ("heading", "Top part"), ("heading", "Under"), ("heading", "Code"), ("list_item", "First link"), ("list_item", "Second code_x"), ("list_item", "Deep & R&D"),
    ("code", "def f(x): # skip return x"), ("code", "- not a list"), ("formula", "p = e^{-1}"), ("formula", "\\sqrt{2}"),
}
WIKI = """== Why ''us''? ==

# First with [[Page 2|a link]]
# Second
#* Deep '''bold'''

<syntaxhighlight lang="text">
a <> b
</syntaxhighlight>

The load follows <math>x < y</math> here, see [https://x.example/ the site].

<math>\\sum_i w_i</math>

=== More ===

* Star"""
WIKI_FOUND = {
    ("heading", "Why us?"), ("list_item", "First with a link"), ("list_item", "Second"), ("list_item", "Deep bold"), ("code", "a <> b"), ("formula", "x < y"), ("formula", "\\sum_i w_i"), ("heading", "More"), ("list_item", "Star"),
}
LATEX = """\\section*{tools \\& more}

We use C\\# and pay \\$5 to \\$9; the load is $a + b$ here.

\\begin{enumerate}
  \\item One \\textbf{bold} \\& R\\&D, 20\\% of it
  \\begin{itemize}
    \\item Deep \\href{https://x.example}{link}
  \\end{itemize}
\\end{enumerate}

\\begin{lstlisting}
x = 1 # & y
\\end{lstlisting}

\\begin{equation}
f(t) = 3
\\end{equation}

\\[ q \\geq 1 \\]

\\subsection{End}"""
LATEX_FOUND = {
    ("heading", "tools & more"), ("formula", "a + b"), ("list_item", "One bold & R&D, 20% of it"), ("list_item", "Deep link"), ("code", "x = 1 # & y"), ("formula", "f(t) = 3"), ("formula", "q \\geq 1"), ("heading", "End"),
}


@pytest.fixture(scope="module")
def labeller():
    return Labeller.trained()


def found(labeller, text):
    kind, leaves = M.leaves_of(text)
    return {(k, b) for k, b in M.elements(kind, leaves, labeller.label([leaves])[0]) if k in M.KINDS}


@pytest.mark.parametrize("text, want", [(HTML, HTML_FOUND), (MARKDOWN, MARKDOWN_FOUND), (WIKI, WIKI_FOUND), (LATEX, LATEX_FOUND)])
def test_notations(labeller, text, want):
    assert found(labeller, text) == want


def test_escaping_layers(labeller):
    once = html.escape(HTML)
    assert found(labeller, once) == found(labeller, html.escape(once)) == HTML_FOUND
    assert found(labeller, HTML.replace("<li>", "<LI>").replace("<h2", "<H2").replace("</h2>", "</H2>")) == HTML_FOUND


def test_text_around_nested_elements(labeller):
    assert found(labeller, "<ul><li>One<ul><li>Two</li></ul>tail</li></ul>") == {("list_item", "One tail"), ("list_item", "Two")}
    assert found(labeller, "<h2>A $x$ b</h2><p>t</p>") == {("heading", "A x b"), ("formula", "x")}


def test_spark_rows(spark):
    rows = [(1, HTML, "x", "y"), (1, HTML, "x", "y"), (2, None, "", ""), (3, "", "", ""), (4, " \n\u00a0", "", ""), (5, "plain text only", "", ""), (6, "- a\n" * 3000, "", ""), (7, "```\nopen " + "z" * 200_000, "", "")]
    df = spark.createDataFrame(rows, "id long, content string, kind string, body string")
    got = [tuple(r) for r in M.found(df, "id", "content").collect()]
    assert len(got) == len(set(got)) and {(k, b) for i, k, b in got if i == 1} == HTML_FOUND
    assert {(i, k) for i, k, _ in got if i > 1} == {(6, "list_item"), (7, "code")}
    texts = {r.id: r.text for r in M.clean_text(df, "id", "content").collect()}
    assert texts[2] == texts[3] == texts[4] == "" and texts[5] == "plain text only" and texts[1].startswith("# About R&D\nText with $ a^2 < b $ here. Pay runs from $4 to $97 an hour.\n- One bold\n- Deep one")
    assert M.found(df.limit(0), "id", "content").count() == 0


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    docs = [labelled(random.Random(i), n)[0] for i, n in enumerate(("html", "markdown", "latex"))]
    for context in (True, False):
        model = Labeller.fresh(1, context)
        model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
        x = Batch(docs)
        y = rng.integers(0, len(LABELS), x.mask.shape)
        loss, g = model.gradients(x, y)
        for name in ("wxf", "whf", "bf", "wxb", "whb", "wo", "bo"):
            flat, some = model.w[name].reshape(-1), np.flatnonzero(g[name])
            for i in rng.choice(some, min(3, len(some)), replace=False):
                old, eps = flat[i], 1e-3
                flat[i] = old + eps
                up, _ = model.gradients(x, y)
                flat[i] = old - eps
                down, _ = model.gradients(x, y)
                flat[i] = old
                assert abs((up - down) / (2 * eps) - g[name].reshape(-1)[i]) < 2e-3
    assert not g["wxf"].any()


def test_labels_do_not_depend_on_the_batch(labeller, monkeypatch):
    docs = [M.leaves_of(t)[1] for t in (HTML, MARKDOWN, WIKI, LATEX, "x")]
    assert labeller.label(docs) == [labeller.label([d])[0] for d in docs] and labeller.label([[]]) == [[]]
    long = [leaf for i in range(40) for leaf in docs[i % 4]]
    whole = labeller.label([long, *docs])
    monkeypatch.setattr(B, "WINDOW", 7)
    monkeypatch.setattr(B, "CELLS", 50)
    assert labeller.label([long, *docs]) == whole


def test_held_out_accuracy(labeller):
    """Generated texts of other seeds than the labeller was fitted to; each leaf by itself is not enough."""
    held = [labelled(random.Random(f"test {i}"), NOTATIONS[i % 4]) for i in range(400)]
    assert sum(len(labels) for _, labels in held) > 2000 and accuracy(labeller, held) > 0.999
    train = [labelled(random.Random(i), NOTATIONS[i % 4]) for i in range(200)]
    assert accuracy(fitted(train, 20), held) > 0.97
    # a line that begins with a number sign is a heading in one document and a list item in another
    shared = "# About the oven"
    assert found(labeller, f"{shared}\n\nText.\n\n## More\n\n- one\n- two") >= {("heading", "About the oven"), ("list_item", "one")}
    assert found(labeller, f"== Steps ==\n{shared}\n# Light it\n# Wait\n\n'''Then''' bake.") >= {("heading", "Steps"), ("list_item", "About the oven"), ("list_item", "Wait")}


def test_the_labels_are_what_was_meant():
    text, kinds = sample(random.Random(3), "html")
    leaves = M.leaves_of(text)[1]
    assert [kinds[int(MARKER.search(leaf.text)[1])] for leaf in leaves if MARKER.search(leaf.text)] == [a for leaf, a in zip(leaves, _labels(leaves, kinds)) if MARKER.search(leaf.text)]
    assert _labels(M.leaves_of("<p>qz1 and qz2</p>")[1], {1: "text", 2: "code"}) is None


def test_deep_escaping_and_nesting(labeller):
    text = HTML
    for _ in range(12):
        text = html.escape(text)
    assert found(labeller, text) == HTML_FOUND
    deep = "\\section{A}\n\\begin{itemize}\n\\item " + "\\emph{" * 9 + "deep" + "}" * 9 + "\n\\end{itemize}"
    assert found(labeller, deep) == {("heading", "A"), ("list_item", "deep")}
    assert found(labeller, "<p>So <math>a + b</math> holds.</p>") == {("formula", "a + b")}
