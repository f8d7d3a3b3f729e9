import hashlib

import pytest
from pyspark.sql import functions as F

from postmill.functions import html_text, text, vectors
from postmill.functions.plain import error_text

TITLES = [
    ("Sr. Software Eng - Remote (US)", None, "senior software engineer"),
    ("Senior Software Engineer", None, "senior software engineer"),
    ("Software Engineer II", None, "software engineer 2"),
    ("Software Engineer III", None, "software engineer 3"),
    ("Engineer II, Platform [London]", "London", "engineer 2 platform"),
    ("Account Executive - New York", "New York, NY", "account executive"),
    ("Account Executive - New York", None, "account executive new york"),
    ("Ingénieur Données (Card Acquisition)", None, "ingenieur donnees card acquisition"),
    ("X - US & Canada", None, "x us and canada"),
    ("Remote", None, "remote"),
    ("eng remote hybrid", None, "engineer"),
    ("Front-End Engineer | Growth", None, "frontend engineer growth"),
    ("Front End Engineer", None, "frontend engineer"),
    ("Engineer (Remote - US) Job #1234", None, "engineer"),
    ("C++ / C# Developer", None, "c++ c# developer"),
    ("Storefront Endeavor", None, "storefrontendeavor"),
    ("日本", None, ""),
    ("  ", None, ""),
    (None, None, ""),
]


def test_title_keys(spark):
    df = spark.createDataFrame([t[:2] for t in TITLES], "t string, l string")
    got = [r[0] for r in df.select(text.title_key(F.col("t"), F.col("l"))).collect()]
    assert got == [t[2] for t in TITLES]


def test_shingles_and_jaccard(spark):
    rows = [("a b c d e", "A, b. c d e!"), ("a b", "a b"), ("", ""), ("", "a b c d"), ("one two three four five", "six seven eight nine ten")]
    s = spark.createDataFrame(rows, "x string, y string").select(text.shingles(F.col("x"), 4).alias("x"), text.shingles(F.col("y"), 4).alias("y"))
    got = s.select(F.size("x"), F.size("y"), text.jaccard(F.col("x"), F.col("y"))).collect()
    assert [tuple(r) for r in got] == [(2, 2, 1.0), (1, 1, 1.0), (0, 0, 1.0), (0, 1, 0.0), (2, 2, 0.0)]


def test_hash_strip_whitespace(spark):
    df = spark.createDataFrame([("t", None, "d", "x"), ("", "null", "", "é")], "a string, b string, c string, d string")
    got = [r[0] for r in df.select(text.content_hash(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    want = [hashlib.sha256(b"".join(x.encode() + b"\0" for x in row)).hexdigest() for row in (("t", "null", "d", "x"), ("", "null", "", "é"))]
    assert got == want
    df = spark.createDataFrame([("  a\t\tb \n c\n\n\n\nd  ",)], "s string")
    assert df.select(text.normalize_whitespace(F.col("s"))).head()[0] == "a b\nc\n\nd"
    assert df.select(text.strip(F.lit(" \n x  "))).head()[0] == "x"


@pytest.mark.parametrize(
    "given, pattern",
    [("a%b_c", "a%b_c"), ("a\\b", "a\\\\b"), ("a\\%", "a\\%"), ("end\\", "end\\\\"), ("a\\\\b", "a\\\\b")],
)
def test_like_escaped(given, pattern):
    assert text.like_escaped(given) == pattern


def test_vectors(spark):
    f = lambda v: F.array(*[F.lit(x).cast("float") for x in v])
    one = spark.range(1)
    for a, b, want in (([1, 2], [2, 4], 1.0), ([1, 0], [0, 3], 0.0), ([1, 1], [-2, -2], -1.0), ([0, 0], [1, 1], 0.0)):
        assert one.select(vectors.cosine(f(a), f(b))).head()[0] == pytest.approx(want, abs=1e-6)
    with pytest.raises(Exception, match="different lengths"):
        one.select(vectors.cosine(f([1]), f([1, 2]))).collect()
    assert one.select(vectors.round_half_up(F.lit(-0.00005), 4)).head()[0] == 0.0


def test_html_text():
    assert html_text.plain_text("<h2>About</h2><p>Build <b>APIs</b> &amp; services.</p><ul><li>Java<li>Go</ul>") == "About\nBuild APIs & services.\nJava\nGo"
    assert html_text.unescaped_text("&lt;p&gt;R&amp;amp;D&lt;/p&gt;&lt;script&gt;x&lt;/script&gt;") == "R&D"
    assert html_text.plain_text(None) == html_text.plain_text("  ") == html_text.unescaped_text(None) == ""
    assert html_text.plain_text("a<br>b<br><br><br><br>c\xa0d") == "a\nb\n\nc d"


def test_error_text():
    assert error_text(None) == "unknown error" and error_text("x" * 600) == "x" * 500
