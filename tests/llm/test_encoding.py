import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postmill.llm import encoding as E

PATH = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return E.Encoder(E.read_ranks(PATH), public_tokenizers.PATTERN), t


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab <|endoftx>\n\t'sé日🚀", max_size=80))
def test_equals_the_library(both, text):
    assert both[0].ids(text) == both[1].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|> a", "a" * 5000, "abc" * 3000, " " * 3000, "é" * 2000, "\n \n\t", "don't we'll"])
def test_long_and_odd(both, text):
    assert both[0].ids(text) == both[1].encode(text, add_special_tokens=False).ids


def test_tree_gives_the_leftmost_lowest():
    t = E.PairTree([5, 3, None, 3, 9])
    assert t.lowest() == 1
    t.set(1, None)
    assert t.lowest() == 3
    t.set(0, 0)
    assert t.lowest() == 0
    assert E.PairTree([None]).lowest() is None and E.PairTree([7]).lowest() == 0


def test_megabyte_without_space(both):
    assert len(both[0].ids("ab" * 200_000)) > 0


def test_spark_rows_and_round_trip(spark, both):
    rows = [(1, None, "a", "b"), (2, "", "", ""), (3, "  ", "", ""), (4, "Hello <|endoftext|>", "", ""), (4, "Hello <|endoftext|>", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, ids string")
    got = sorted((r.id, r.ids) for r in E.encoded(df, "doc_id", "text", PATH, public_tokenizers.PATTERN).collect())
    assert got[0] == (1, []) and got[1] == (2, []) and len(got) == 5 and got[3] == got[4]
    back = {i: b for b, i in E.read_ranks(PATH).items()}
    assert b"".join(back[i] for i in got[3][1]).decode() == "Hello <|endoftext|>" and b"".join(back[i] for i in got[2][1]) == b"  "
    assert E.encoded(df.limit(0), "doc_id", "text", PATH, public_tokenizers.PATTERN).count() == 0
