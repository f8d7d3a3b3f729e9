"""Evaluation texts leaking into a corpus: pigeonhole edit matching.

A passage of ``window`` words of an item leaks if a document has it with at most ``budget`` word edits. Items
are split into aligned pieces of window // (budget + 2) words; every window then contains budget + 1 whole
pieces, and as an edit can spoil one piece only, one of them stands unchanged in the document. Documents are
scanned for all pieces at once; around each hit the windows that contain the piece are compared with the
document's words by Myers' bit-parallel edit distance.

Words are maximal runs of letters and digits, letter case ignored. Items are written in blocks of at most
``block_chars`` characters, each a file that the executors fetch and build their automaton from, so its size has a
fixed bound and no item passes through the driver; the corpus is scanned once per block.

A piece may stand in very many items. Their surroundings, as far as a window with the piece reaches, are compared
with the document once for each different surrounding.

Edge cases: null and short items (fewer words than the window) and null and short documents never match;
repeated rows and items with equal texts give each id once; empty tables give empty results; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import scratch_folder, spread

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def best_distance(pattern: list[str], text: list[str]) -> int:
    """The least edit distance of pattern to any stretch of text, bit-parallel (Myers)."""
    m = len(pattern)
    places: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        places[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for w in text:
        eq = places.get(w, 0)
        x = eq | minus
        d0 = ((((eq & plus) + plus) ^ plus) | x) & full
        hp, hn = (minus | ~(d0 | plus)) & full, plus & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full  # a match may start anywhere
        plus, minus = (hn | ~(d0 | hp)) & full, hp & d0
        best = min(best, score)
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], window: int, budget: int):
        self.window, self.budget = window, budget
        self.length = window // (budget + 2)
        if self.length < 1:
            raise ValueError("the error budget is too large for the window")
        # of each piece the surroundings, (words, place of the piece in them), and the items that have them
        pieces: dict[str, dict[tuple[tuple[str, ...], int], list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, t in items:
            w = words(t)
            if len(w) < window:
                continue
            for at in range(0, len(w) - self.length + 1, self.length):
                lo = max(0, at + self.length - window)
                pieces[" " + " ".join(w[at : at + self.length]) + " "][tuple(w[lo : at + window]), at - lo].append(i)
        self.automaton = ahocorasick.Automaton()
        for piece, around in pieces.items():
            self.automaton.add_word(piece, (len(piece), list(around.items())))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def leaks(self, text: str | None) -> set[int]:
        """Ids of the items of which the text has a passage."""
        found: set[int] = set()
        if self.empty or not text:
            return found
        ws = words(text)
        if len(ws) < self.window - self.budget:
            return found
        joined = " " + " ".join(ws) + " "
        seen, counted = 0, 0  # characters of joined whose words are counted
        for end, (size, around) in self.automaton.iter(joined):
            start = end - size + 1
            if start < seen:
                at = joined.count(" ", 0, start + 1) - 1
            else:
                counted += joined.count(" ", seen, start)
                seen = start
                at = counted
            for (item, offset), ids in around:
                if not found.issuperset(ids) and self._verified(ws, at, item, offset):
                    found.update(ids)
        return found

    def _verified(self, doc: list[str], at: int, item: tuple[str, ...], offset: int) -> bool:
        w, k, n = self.window, self.budget, self.length
        for s in range(max(0, offset + n - w), min(offset, len(item) - w) + 1):
            lo = max(0, at - (offset - s) - k)
            if best_distance(item[s : s + w], doc[lo : at - (offset - s) + w + k]) <= k:
                return True
        return False


def _scan(file: str, window: int, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = pq.read_table(SparkFiles.get(file))
        matcher = Matcher(list(zip(items.column("i").to_pylist(), items.column("t").to_pylist())), window, budget)
        for batch in batches:
            ids, out = batch.column("id").to_pylist(), ([], [])
            for i, t in zip(ids, batch.column("text").to_pylist()):
                for item in matcher.leaks(t):
                    out[0].append(i)
                    out[1].append(item)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["doc", "item"])

    return run


def _shared(items: DataFrame) -> str:
    """Name of the file, one that every executor fetches, that holds the items of a block."""
    spark = items.sparkSession
    folder = scratch_folder(spark, "items")
    items.coalesce(1).write.parquet(folder)  # a block has a size bound
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    (file,) = [f.getPath() for f in files if f.getPath().getName().startswith("part-")]
    spark.sparkContext.addFile(file.toString())
    return file.getName()


def leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, window: int = 12, budget: int = 0, block_chars: int = 8_000_000) -> DataFrame:
    """(doc, item) of every document that has a passage of an item."""
    held = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    total, longest = held.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)), F.coalesce(F.max(F.length("t")), F.lit(0))).head()
    # hashed blocks of half the bound on average; a single longer item is a block of its own size
    blocks = max(1, -(-2 * total // max(block_chars, longest)))
    texts = spread(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).alias("text")))
    out = None
    for b in range(blocks):
        part = texts.mapInArrow(_scan(_shared(held.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)), window, budget), "doc long, item long")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
