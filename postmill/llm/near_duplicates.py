"""Near-duplicate records with small edits: meet-in-the-middle ball hashing.

A record's fingerprint is a row of one-bit minima of its shingle set under random hashes; two records of
Jaccard similarity s differ in each bit with probability (1-s)/2. The fingerprint is read as words of BITS bits.
Of every word a record emits all variants within half the radius; two words within the radius of each other meet
in a common variant, so a shuffle on (block, place of the word, variant) brings them together. Colliding pairs are thinned by the Hamming distance of the whole fingerprint, deduplicated and
verified by the exact similarity of the shingle sets.

A word of 12 bits and radius 2 is shared by unrelated records with probability 0.02. So that a record meets about
as many of them in a block of any size, words grow with the logarithm of the block's size: what is beyond 12 bits
must agree exactly. There are as many words as keep the probability of a miss: MISS at the threshold, which is
5 words of 12 bits for a similarity of 0.7, 9 of 14 bits in a block of 30,000, 21 of 18 in one of 500,000; the
fingerprint is as long as the largest block needs. At 0.8 a pair is missed with probability 0.00003 (5 words). The
whole-fingerprint bound of 40 of the first 128 bits adds less than 0.000001. Records with equal shingle sets in one
block are one class, so copies cost linear work and can't be missed.

Edge cases: null texts and texts of fewer words than a shingle have no shingles and no pairs; a null block
key equals nothing; repeated ids count once; equal ids are no pair; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.components import components
from postmill.session import cut, spread

WORD = r"(?:[^\W_]|[+#])+"
SKETCH = 128
HAMMING = 40
MISS = 0.0013
BITS, RADIUS = 12, 2


class _Hashes(dict):
    """64-bit hashes of words, kept for a bounded number of them."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingle_sets(texts: list[str | None], size: int, pattern: str = WORD, hashes: _Hashes | None = None) -> list[np.ndarray]:
    """The sorted different 64-bit shingle hashes of each text."""
    find = re.compile(pattern).findall
    hashes = _Hashes() if hashes is None else hashes
    words = [find(t.lower()) if t else [] for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, int(lengths.sum()))
    n = len(flat) - size + 1
    empty = np.zeros(0, np.uint64)
    if n < 1:
        return [empty] * len(texts)
    with np.errstate(over="ignore"):
        h = flat[:n].copy()
        for i in range(1, size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + flat[i : n + i]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    ends = np.cumsum(lengths)
    return [np.unique(h[e - l : e - size + 1]) if l >= size else empty for e, l in zip(ends.tolist(), lengths.tolist())]


def _factors(bits: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, bits, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One-bit minima, 64 to a number; as many as there are factors."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 4096):
            np.minimum(low, (shingles[i : i + 4096, None] * factors[None, :]).min(axis=0), out=low)
    bits = ((low >> np.uint64(20)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64)


def _fingerprints(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, hashes = _factors(bits), _Hashes()
        for batch in batches:
            ids, blocks = batch.column("id"), batch.column("block")
            for at in range(0, batch.num_rows, 512):
                sets = shingle_sets(batch.column("text").slice(at, 512).to_pylist(), size, hashes=hashes)
                rows = [i for i, s in enumerate(sets) if len(s)]
                if not rows:
                    continue
                sketches = np.stack([sketch(sets[i], factors) for i in rows])
                take = pa.array([at + i for i in rows])
                same = [xxhash.xxh64_intdigest(sets[i].tobytes()) - 2**63 for i in rows]
                more = pa.array(list(sketches[:, 2:]), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.take(take), blocks.take(take), pa.array([len(sets[i]) for i in rows], pa.int32()), pa.array(same, pa.int64()), pa.array(sketches[:, 0]), pa.array(sketches[:, 1]), more], names=["id", "block", "n", "same", "s0", "s1", "more"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = shingle_sets(batch.column("text").slice(at, 512).to_pylist(), size, hashes=hashes)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, 512), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "shingles"])

    return run


def word_probability(threshold: float, bits: int, exact: int) -> float:
    """That two records of the threshold's similarity agree in ``bits`` bits up to the radius and in ``exact`` others."""
    p = (1 - threshold) / 2
    return sum(math.comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(RADIUS + 1)) * (1 - p) ** exact


def words_needed(threshold: float, exact: int) -> int:
    """Words that miss a pair of the threshold's similarity no more often than MISS."""
    return max(1, math.ceil(math.log(MISS) / math.log1p(-word_probability(threshold, BITS, exact)) - 1e-6))


def exact_bits(block: Column) -> Column:
    """Bits beyond the first 12 of the words of a block of so many records: a record meets by chance about as many
    as in a block of 2^13."""
    return F.greatest(F.ceil(F.log2(block)).cast("int") - (BITS + 1), F.lit(0))


def half_ball() -> list[int]:
    """What to flip for all variants within half the radius."""
    return [sum(1 << i for i in c) for r in range(RADIUS // 2 + 1) for c in combinations(range(BITS), r)]


def _variants(threshold: float):
    """(rep, n, s0, s1, keys): the shuffle keys of a record, all variants within half the radius of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.array(half_ball(), np.uint64)
        for batch in batches:
            blocks, exact = batch.column("block").to_numpy().view(np.uint64), batch.column("exact").to_numpy()
            more = batch.column("more").flatten().to_numpy().reshape(batch.num_rows, -1)
            numbers = np.column_stack([batch.column("s0").to_numpy(), batch.column("s1").to_numpy(), more])
            bits = np.unpackbits(np.ascontiguousarray(numbers).view(np.uint8), axis=1, bitorder="little")
            for e in np.unique(exact):
                own = np.flatnonzero(exact == e)
                n, width = words_needed(threshold, int(e)), BITS + int(e)
                weights = np.uint64(1) << np.arange(width, dtype=np.uint64)
                for at in range(0, len(own), 2048):
                    part = own[at : at + 2048]
                    words = bits[part, : n * width].reshape(len(part), n, width).astype(np.uint64) @ weights
                    with np.errstate(over="ignore"):
                        head = (blocks[part][:, None] + np.arange(n, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
                        keys = (words[:, :, None] ^ masks) + (head ^ (head >> np.uint64(29)))[:, :, None]
                        keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
                        keys ^= keys >> np.uint64(31)
                    flat = pa.array(keys.ravel().view(np.int64))
                    ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * (n * len(masks)))
                    take = pa.array(part)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("rep", "n", "s0", "s1")), pa.ListArray.from_arrays(ends, flat)], names=["rep", "n", "s0", "s1", "keys"])

    return run


def links(docs: DataFrame, id_col: str, block_col: str, text_col: str, threshold: float = 0.8, shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rep_a, rep_b, similarity) between class representatives, and the membership (id, rep)."""
    text = docs.where(F.col(block_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(block_col).alias("block"), F.col(text_col).alias("text"))
    crowded = text.groupBy("block").agg(F.count("*").alias("c")).where("c > 1").select("block", exact_bits(F.col("c")).alias("exact"))
    most = crowded.agg(F.max("exact")).head()[0] or 0
    bits = max(SKETCH, -(-max(words_needed(threshold, e) * (BITS + e) for e in range(most + 1)) // 64) * 64)
    prints = cut(spread(text).mapInArrow(_fingerprints(shingle, bits), "id long, block long, n int, same long, s0 long, s1 long, more array<long>"))
    # equal sets have equal hashes, sizes and fingerprints
    of_class = ["block", "same", "n", "s0", "s1"]
    classes = prints.groupBy(*of_class).agg(F.min("id").alias("rep"), F.first("more").alias("more"))
    sent = classes.join(crowded, "block").select("rep", "block", "n", "s0", "s1", "more", "exact")
    emitted = sent.mapInArrow(_variants(threshold), "rep long, n int, s0 long, s1 long, keys array<long>").select("rep", "n", "s0", "s1", F.explode("keys").alias("key"))
    a, b = emitted.alias("a"), emitted.select(*[F.col(c).alias(f"{c}_b") for c in ("rep", "n", "s0", "s1", "key")]).alias("b")
    apart = F.bit_count(F.col("s0").bitwiseXOR(F.col("s0_b"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("s1_b")))
    sizes = F.least("n", "n_b") >= F.greatest("n", "n_b") * F.lit(threshold) - F.lit(1e-9)
    pairs = cut(a.join(b, (F.col("key") == F.col("key_b")) & (F.col("rep") < F.col("rep_b")) & sizes & (apart <= HAMMING)).select("rep", "rep_b").distinct())
    needed = pairs.select(F.col("rep").alias("id")).union(pairs.select("rep_b")).distinct()
    sets = text.join(needed, "id", "left_semi").dropDuplicates(["id"]).select("id", "text").mapInArrow(_sets(shingle), "id long, shingles array<long>")
    sets = cut(sets)
    both = pairs.join(sets.select(F.col("id").alias("rep"), F.col("shingles").alias("x")), "rep").join(sets.select(F.col("id").alias("rep_b"), F.col("shingles").alias("y")), "rep_b")
    common = F.size(F.array_intersect("x", "y"))
    scored = both.select("rep", "rep_b", common.alias("i"), (F.size("x") + F.size("y") - common).alias("u"))
    near = scored.where(F.col("i") >= F.col("u") * F.lit(threshold) - F.lit(1e-9)).select(F.col("rep").alias("rep_a"), "rep_b", (F.col("i") / F.col("u")).alias("similarity"))
    return near, prints.join(classes.select(*of_class, "rep"), of_class).select("id", "rep")


def pairs(docs: DataFrame, id_col: str, block_col: str, text_col: str, **options) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair, copies expanded."""
    near, members = links(docs, id_col, block_col, text_col, **options)
    members = cut(members)
    left, right = members.select(F.col("id").alias("x"), F.col("rep").alias("rep_a")), members.select(F.col("id").alias("y"), F.col("rep").alias("rep_b"))
    across = near.join(left, "rep_a").join(right, "rep_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    within = left.join(right, (F.col("rep_a") == F.col("rep_b")) & (F.col("x") < F.col("y"))).select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return across.unionByName(within).where("id_a < id_b").distinct()


def groups(docs: DataFrame, id_col: str, block_col: str, text_col: str, **options) -> DataFrame:
    """(id, group_id, links): every record that has a near-duplicate, the smallest id of its group, and how many
    near-duplicates it has. Copies are counted, not expanded.
    """
    near, members = links(docs, id_col, block_col, text_col, **options)
    near, members = cut(near), cut(members)
    sizes = members.groupBy("rep").agg(F.countDistinct("id").alias("copies"))
    both = near.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("other")).unionByName(near.select(F.col("rep_b").alias("rep"), F.col("rep_a").alias("other")))
    across = both.join(sizes.select(F.col("rep").alias("other"), "copies"), "other").groupBy("rep").agg(F.sum("copies").alias("across"))
    parts = components(near, "rep_a", "rep_b").select(F.col("node").alias("rep"), "component")
    per_class = sizes.join(across, "rep", "left").join(parts, "rep", "left")
    per_class = per_class.select("rep", (F.col("copies") - 1 + F.coalesce("across", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("group_id")).where("links > 0")
    # a class' representative is its smallest id, so the smallest representative is the group's smallest id
    return members.distinct().join(per_class, "rep").select("id", "group_id", "links")
