"""Encoding of a corpus with a byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; every part is encoded on its own. A part starts as single
bytes. A segment tree over the adjacent pairs holds (rank, place) of each pair; its root is the leftmost
pair of the lowest rank. That pair is merged and the three pairs around it are updated, each in logarithmic
time, until the root holds no mergeable pair. Parts of any length, also megabytes without a space, cost
n log n. Parts recur, so a bounded number of short ones is kept with their ids.

Edge cases: null and empty texts give an empty list; blank texts are encoded like any other; strings that
look like special tokens are ordinary text; ids are not checked for uniqueness, every row gives a row.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import spread

KEPT_PARTS, KEPT_LENGTH = 400_000, 64


def ranks_of(content: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a rank file's content: a base64 token and its id on every line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return ranks_of(f.read())


class PairTree:
    """Segment tree over the pairs of a part; a leaf is rank * size + place, so the minimum is leftmost."""

    def __init__(self, ranks: list[int | None]):
        size = 1
        while size < len(ranks):
            size *= 2
        self.size, self.none = size, 1 << 62
        tree = [self.none] * (2 * size)
        for i, r in enumerate(ranks):
            if r is not None:
                tree[size + i] = r * size + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.tree = tree

    def set(self, place: int, rank: int | None) -> None:
        tree, i = self.tree, self.size + place
        tree[i] = self.none if rank is None else rank * self.size + place
        i //= 2
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                break  # nothing changes further up
            tree[i] = low
            i //= 2

    def lowest(self) -> int | None:
        """Place of the leftmost pair of the lowest rank."""
        low = self.tree[1]
        return None if low == self.none else low % self.size


def encode_part(part: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one part."""
    n = len(part)
    if n == 1:
        return [ranks[part]]
    get = ranks.get
    tree = PairTree([get(part[i : i + 2]) for i in range(n - 1)])
    # piece i is part[i:end[i]]; end and before tie the pieces together
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (i := tree.lowest()) is not None:
        j = end[i]
        end[i] = k = end[j]
        tree.set(j, None) if j < n - 1 else None
        if k < n:
            before[k] = i
            tree.set(i, get(part[i : end[k]]))
        else:
            tree.set(i, None)
        if (h := before[i]) >= 0:
            tree.set(h, get(part[h:k]))
    out, i = [], 0
    while i < n:
        out.append(ranks[part[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find, self.kept = ranks, regex.compile(pattern).findall, {}

    def ids(self, text: str | None) -> list[int]:
        out: list[int] = []
        kept = self.kept
        for part in self.find(text) if text else ():
            ids = kept.get(part)
            if ids is None:
                ids = encode_part(part.encode("utf-8", "surrogatepass"), self.ranks)
                if len(part) <= KEPT_LENGTH:
                    if len(kept) >= KEPT_PARTS:
                        kept.clear()
                    kept[part] = ids
            out += ids
        return out


def _encoded(tokens: bytes, pattern: str):
    """tokens: the rank file's content, of a fixed size; it travels once with the function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_of(tokens), pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids = [encoder.ids(t) for t in batch.column("text").slice(at, 512).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)])
                if ends[-1] > 2**31 - 1:
                    raise ValueError("more than 2**31 ids in a batch; lower spark.sql.execution.arrow.maxRecordsPerBatch")
                flat = np.fromiter((x for row in ids for x in row), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, 512), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["id", "ids"])

    return run


def encoded(docs: DataFrame, id_col: str, text_col: str, rank_path: str, pattern: str) -> DataFrame:
    """(id, ids) of every row."""
    with open(rank_path, "rb") as f:
        tokens = f.read()
    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(_encoded(tokens, pattern), "id long, ids array<int>")
