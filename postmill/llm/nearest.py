"""Most similar vectors for every vector: a block matrix join.

Vectors are split into g blocks by the hash of their id; each of the g(g+1)/2 block pairs is one tile, one
partition, one task. A tile quantises its vectors to int8 and multiplies these whole numbers; the sums stay below
2^24, so the product is exact although the library's fast product is that of float32. Scaled, it bounds the cosine by
the quantisation errors. A pair whose upper bound reaches the lower bound of a row's k-th best so far survives, is
recomputed in float64 from the vectors, which the tile has at hand, and merged into the row's heap of k. The rows'
heaps of all tiles are merged at the end. No pair that belongs to the result is lost.

Exact copies of a vector, told by two hashes of 64 bits, are one row of the join (a class with its k+1 smallest ids),
so a group of copies of any size costs linear work; copies are each other's nearest.

Each vector is sent to g tiles. g is the least of which two blocks of ``block_rows`` vectors hold all rows
(at least ``min_blocks``): memory per task is bounded, the shuffle grows with the number of blocks.

Edge cases: null vectors, other lengths, null, NaN or infinite elements and all-zero vectors are unusable
and neither get nor are neighbours; ties go to the smaller id; fewer than k others give what there is;
repeated ids count once; empty input gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRIP = 512


def usable(vector: Column, dim: int) -> Column:
    """True for ``dim`` finite numbers that are not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == dim) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, their scale, the norm of the error and the norm of the quantised vector, of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    approx = q * scale[:, None]
    return q, scale, np.linalg.norm(unit - approx, axis=1), np.linalg.norm(approx, axis=1)


class Heaps:
    """The k best (similarity, id) of each row, as arrays; ``low`` bounds the k-th best from below."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.sim = np.full((n, k), -np.inf)
        self.col = np.full((n, k), -1, dtype=np.int64)
        self.low = np.full(n, -np.inf)

    def push(self, rows: np.ndarray, cols: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> None:
        """Merges new entries; ids: of the columns, for ties."""
        if not len(rows):
            return
        touched = np.unique(rows)
        old_sim, old_col = self.sim[touched], self.col[touched]
        had = old_col >= 0
        r = np.concatenate([np.repeat(touched, self.k)[had.ravel()], rows])
        c = np.concatenate([old_col[had], cols])
        s = np.concatenate([old_sim[had], sims])
        order = np.lexsort((ids[c], -s, r))
        r, c, s = r[order], c[order], s[order]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        place = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
        keep = place < self.k
        self.sim[touched], self.col[touched] = -np.inf, -1
        self.sim[r[keep], place[keep]], self.col[r[keep], place[keep]] = s[keep], c[keep]
        self.low[touched] = self.sim[touched, self.k - 1]


def _tile(ia: np.ndarray, a: np.ndarray, ib: np.ndarray | None, b: np.ndarray | None, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, neighbour, similarity) of one tile; ib, b None: the tile of a block with itself."""
    same = b is None
    ua = a / np.linalg.norm(a, axis=1)[:, None]
    ub = ua if same else b / np.linalg.norm(b, axis=1)[:, None]
    ib = ia if same else ib
    qa, sa, ea, na = quantise(ua)
    qb, sb, eb, nb = (qa, sa, ea, na) if same else quantise(ub)
    if 127 * 127 * a.shape[1] >= 2**24:
        raise ValueError("the whole numbers of longer vectors are not exact in float32")
    fa, fb = qa.astype(np.float32), qb.astype(np.float32).T.copy()
    heap_a, heap_b = Heaps(len(ia), k), None if same else Heaps(len(ib), k)
    heap_b = heap_a if same else heap_b
    # |cos - product| <= |approx a| * error b + error a (a unit vector b), plus rounding
    sa32, sb32 = sa.astype(np.float32)[:, None], sb.astype(np.float32)
    worst_b, worst_nb = float(eb.max(initial=0.0)), float(nb.max(initial=0.0))
    for i in range(0, len(ia), STRIP):
        rows = slice(i, min(i + STRIP, len(ia)))
        slack_a = na[rows] * worst_b + ea[rows] + 1e-5
        slack_b = worst_nb * float(ea[rows].max()) + eb + 1e-5
        width = STRIP * 4
        for j in range(i if same else 0, len(ib), width):
            cols = slice(j, min(j + width, len(ib)))
            dots = (fa[rows] @ fb[:, cols]) * sa32[rows] * sb32[cols]
            if same and j < rows.stop:  # each pair once, none with itself
                dots[np.arange(rows.start, rows.stop)[:, None] >= np.arange(cols.start, cols.stop)] = -np.inf
            low_a, low_b = heap_a.low[rows], heap_b.low[cols]
            if not np.isfinite(low_a).all() and cols.stop - cols.start > k:  # a first bound from this strip itself
                kth = np.partition(dots, -k, axis=1)[:, -k] - slack_a
                low_a = np.maximum(low_a, np.where(np.isfinite(kth), kth, -np.inf))
            if not np.isfinite(low_b).all() and rows.stop - rows.start > k:
                kth = np.partition(dots, -k, axis=0)[-k] - slack_b[cols]
                low_b = np.maximum(low_b, np.where(np.isfinite(kth), kth, -np.inf))
            for_a = dots >= (low_a - slack_a).astype(np.float32)[:, None]
            for_b = dots >= (low_b - slack_b[cols]).astype(np.float32)[None, :]
            hit = np.flatnonzero((for_a | for_b).ravel())
            if same and j < rows.stop:
                hit = hit[np.isfinite(dots.ravel()[hit])]
            if not len(hit):
                continue
            r, c = np.divmod(hit, dots.shape[1])
            exact = np.einsum("ij,ij->i", ua[r + rows.start], ub[c + cols.start])
            wa, wb = for_a.ravel()[hit], for_b.ravel()[hit]
            heap_a.push(r[wa] + rows.start, c[wa] + cols.start, exact[wa], ib)
            heap_b.push(c[wb] + cols.start, r[wb] + rows.start, exact[wb], ia)
    for heap, own, other in ((heap_a, ia, ib),) if same else ((heap_a, ia, ib), (heap_b, ib, ia)):
        r, p = np.nonzero(heap.col >= 0)
        yield own[r], other[heap.col[r, p]], heap.sim[r, p]


def _tiles(k: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, ids, vectors, own = [], [], [], set()
        for batch in batches:
            side.append(batch.column("side").to_numpy())
            ids.append(batch.column("id").to_numpy())
            vectors.append(batch.column("vector").flatten().to_numpy().reshape(-1, dim))
            own.update(np.unique(batch.column("tile").to_numpy()).tolist())
        if not ids or not sum(map(len, ids)):
            return
        assert len(own) == 1, "a partition holds one tile"
        side, ids, vectors = np.concatenate(side), np.concatenate(ids), np.concatenate(vectors).astype(np.float64)
        sides = [np.flatnonzero(side == s) for s in (0, 1, 2)]
        if len(sides[2]):
            parts = _tile(ids, vectors, None, None, k)
        elif len(sides[0]) and len(sides[1]):
            parts = _tile(ids[sides[0]], vectors[sides[0]], ids[sides[1]], vectors[sides[1]], k)
        else:
            return
        for a, b, s in parts:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], names=["id", "nbr", "sim"])

    return run


def neighbours(vectors: DataFrame, id_col: str, vector_col: str, k: int = 5, dim: int = 64, block_rows: int = 65_536, min_blocks: int = 4) -> DataFrame:
    """(id, nbr, sim, place): the k most similar other rows of every usable row, place from 1."""
    good = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector"), dim)).withColumn("class", F.struct(F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector")))  # 128 bits
    classes = good.groupBy("class").agg(F.min(F.struct("id", "vector")).alias("rep"), F.count("*").alias("copies")).select("class", F.col("rep.id").alias("id"), F.col("rep.vector").alias("vector"))
    n = vectors.select(id_col).count()
    g = max(min_blocks, -(-n // block_rows))
    block = F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(g)).cast("int")
    # tile number of blocks i <= j: pairs in rows of the upper triangle
    tile = lambda i, j: (i * g - (i * (i - 1) / 2).cast("int") + (j - i)).cast("int")
    other = F.sequence(F.lit(0), F.lit(g - 1))
    tiles = F.transform(other, lambda o: F.struct(tile(F.least("block", o), F.greatest("block", o)).alias("tile"), F.when(F.col("block") == o, 2).when(F.col("block") < o, 0).otherwise(1).alias("side")))
    sent = classes.withColumn("block", block).select("id", "vector", F.explode(tiles).alias("t")).select("id", "vector", F.col("t.tile").alias("tile"), F.col("t.side").alias("side"))
    found = sent.repartitionById(g * (g + 1) // 2, F.col("tile")).mapInArrow(_tiles(k, dim), "id long, nbr long, sim double")
    by_class = _merge(found, k)
    return _expand(good.select("id", "class").distinct(), classes.select("class", F.col("id").alias("rep")), by_class, k)


def _best(entries: Column, k: int) -> Column:
    return F.slice(F.array_sort(entries), 1, k)


def _merge(found: DataFrame, k: int) -> DataFrame:
    """(rep, near): the k best of a representative's heaps, one of at most k entries from each of its g tiles."""
    return found.groupBy(F.col("id").alias("rep")).agg(_best(F.collect_list(F.struct((-F.col("sim")).alias("far"), F.col("nbr").alias("nbr"))), k).alias("near"))


def _expand(members: DataFrame, classes: DataFrame, by_class: DataFrame, k: int) -> DataFrame:
    """Neighbours of every row from those of the representatives."""
    w = Window.partitionBy("class").orderBy("id")
    # k+1 smallest ids of each class with copies; the window keeps only those before the shuffle
    few = members.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).groupBy("class").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    copies = few.where(F.size("ids") > 1)
    reps = classes.join(copies, "class", "inner").select("rep", "ids")
    near = by_class.select("rep", F.posexplode("near").alias("p", "e")).select("rep", F.col("e.far").alias("far"), F.col("e.nbr").alias("nbr"))
    spread = near.join(reps.select(F.col("rep").alias("nbr"), "ids"), "nbr", "left").select("rep", F.explode(F.transform(F.coalesce("ids", F.array("nbr")), lambda i: F.struct(F.col("far"), i.alias("nbr")))).alias("e"))
    spread = spread.groupBy("rep").agg(_best(F.collect_list("e"), k).alias("near"))
    per_row = members.join(classes, "class").join(copies, "class", "left").join(spread, "rep", "left")
    own = F.transform(F.filter(F.coalesce("ids", F.array()), lambda i: i != F.col("id")), lambda i: F.struct(F.lit(-2.0).alias("far"), i.alias("nbr")))
    best = _best(F.concat(own, F.coalesce("near", F.array().cast("array<struct<far:double,nbr:bigint>>"))), k)
    return per_row.select("id", F.posexplode(best).alias("place", "e")).select("id", F.col("e.nbr").alias("nbr"), F.when(F.col("e.far") == -2.0, 1.0).otherwise(-F.col("e.far")).alias("sim"), (F.col("place") + 1).alias("place"))


def found(vectors: DataFrame, id_col: str, vector_col: str, k: int = 5, dim: int = 64) -> DataFrame:
    """(id_a, id_b), id_a < id_b: one of the two is among the other's k most similar."""
    near = neighbours(vectors, id_col, vector_col, k, dim)
    return near.select(F.least("id", "nbr").alias("id_a"), F.greatest("id", "nbr").alias("id_b")).distinct()
