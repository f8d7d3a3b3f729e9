"""Lines repeated across one source's documents: suffix arrays over the source's line identifiers.

A source's documents, each a sequence of line identifiers, are concatenated with breaks at the documents'
ends. Its suffix array is the sorted list of all positions by the lines that follow. Neighbours in the array
that agree in the first l lines form an interval: a block of l lines repeated as often as the interval is
long. A block is *wide* if it spans at least ``min_documents`` different document keys. The longest wide block
at every position is found, and the blocks that lie in no longer one are deleted wherever they stand.

The array is refined by chunk doubling. Chunks of 4^k lines have names, each made of the names of its four
quarters. The first sort is by FAN chunks of one line. Suffixes that are still wide at its end are sorted on
by further chunks of 4, then 16, and so on up, and where a longer chunk is too much they go on by shorter ones
down to one line, together with all others that begin alike; so a block of any length takes about 2 log4(length)
sorts of the suffixes concerned, with keys of a fixed size. Within one interval the sort is by the chunks' names in
order, so every common prefix at a chunk's end is an interval of neighbours.

Each sort is one global range sort over (source, prefix, chunks, document, line), so neither a source with a
third of all rows nor a line in every document is gathered in one task: an interval cut by a partition's end
is counted in parts, as the at most ``min_documents`` different keys seen on either side, and the parts merged.

Lines without letter or digit have no identifier: they end a run and are never part of a block.
Edge cases: null texts count as empty; null sources are a source; null keys are one key; empty tables give
empty results; repeated rows of a document count once through its key; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.session import cut

FAN = 4
CHUNKS = [f"c{j}" for j in range(1, FAN + 1)]
_SUFFIX = "doc long, line_no int, source long, key long, length int, prefix long, c1 long, c2 long, c3 long, c4 long"


def line_key(line: Column) -> Column:
    """Letters and digits of a line in order, case folded."""
    return F.regexp_replace(F.lower(F.upper(line)), r"[^\p{L}\p{N}]+", "")


def line_ids(text: Column) -> Column:
    """Line identifiers of a text, null for lines without letter or digit."""
    keys = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), line_key)
    return F.transform(keys, lambda k: F.when(k != "", F.xxhash64(k)))


def identified(docs: DataFrame, doc: str, source: str, key: str, text: str) -> DataFrame:
    """(doc, source, key, ids): each document as the sequence of its line identifiers."""
    return docs.select(F.col(doc).cast("long").alias("doc"), F.xxhash64(F.lit("s"), F.col(source)).alias("source"), F.xxhash64(F.lit("k"), F.col(key)).alias("key"), line_ids(F.col(text)).alias("ids"))


def _mixed(name: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """The name of a block followed by a chunk."""
    with np.errstate(over="ignore"):
        x = (name ^ (name >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + chunk
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def chunk_names(ids: np.ndarray, there: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the chunks of FAN**level lines that begin at each line, and whether there is one before a break."""
    names, ok, size = ids, there, 1
    for _ in range(level):
        n = max(len(names) - (FAN - 1) * size, 0)
        out, fine = np.full(n, FAN * size, np.uint64), np.ones(n, bool)
        for q in range(FAN):
            out = _mixed(out, names[q * size : q * size + n])
            fine &= ok[q * size : q * size + n]
        names, ok, size = out, fine, size * FAN
    return names, ok


def _suffixes(level: int):
    """Rows of the array to sort at a level, from (doc, source, key, ids, at), at: (line, length, prefix) of the
    suffixes that take part, or null for all of them."""
    size = FAN**level

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, at = batch.column("ids"), batch.column("at")
        # the documents' lines one after another, a break after each document
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy().astype(np.int64)
        begin = np.cumsum(lengths + 1) - (lengths + 1)
        flat = ids.flatten()
        where = np.arange(len(flat)) + np.repeat(np.arange(len(lengths)), lengths)
        lines, there = np.zeros(len(flat) + len(lengths), np.uint64), np.zeros(len(flat) + len(lengths), bool)
        lines[where], there[where] = flat.fill_null(0).to_numpy().view(np.uint64), ~np.asarray(flat.is_null())
        if at.null_count:
            place = np.flatnonzero(there)
            owner = np.searchsorted(begin, place, side="right") - 1
            length, prefix = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        else:
            owner = np.repeat(np.arange(len(at)), pc.list_value_length(at).to_numpy())
            line, length, prefix = (pc.struct_field(at.flatten(), f).to_numpy() for f in ("line", "length", "prefix"))
            place = begin[owner] + line
        names, ok = chunk_names(lines, there, level)
        alive, chunks = np.ones(len(place), bool), []
        for j in range(FAN):
            start = place + length + j * size
            alive = alive & (start < len(names))
            alive[alive] &= ok[start[alive]]
            c = np.zeros(len(place), np.uint64)
            c[alive] = names[start[alive]]
            chunks.append(pa.array(c.view(np.int64), mask=~alive))
        own = [pa.array((place - begin[owner] + 1).astype(np.int32)), *(batch.column(c).take(pa.array(owner)) for c in ("source", "key")), pa.array(length.astype(np.int32)), pa.array(prefix)]
        return pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(owner)), *own, *chunks], names=["doc", "line_no", "source", "key", "length", "prefix", *CHUNKS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                yield rows(batch.slice(first, 1024))

    return run


def _blocks(prefix: np.ndarray, chunks: list[pa.Array]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Names of the prefix with 1 to FAN chunks, and whether there are so many."""
    name, names, valid = prefix.view(np.uint64), [], []
    for c in chunks:
        name = _mixed(name, c.fill_null(0).to_numpy().view(np.uint64))
        names.append(name.view(np.int64))
        valid.append(~np.asarray(c.is_null()))
    return names, valid


def _intervals(least: int):
    """Over one sorted stretch of the suffix array: (source, chunks, block, keys) of the intervals of 1 to FAN
    common chunks, with up to ``least`` different keys of each. An interval of fewer keys is kept only where it
    may go on in a neighbouring partition, that is at the stretch's ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[dict] = [{"id": None, "keys": set(), "head": True} for _ in range(FAN)]
        out: list[tuple] = []

        def close(l: int, tail: bool) -> None:
            o = open_[l]
            if o["id"] is not None and (len(o["keys"]) >= least or o["head"] or tail):
                out.append((o["id"][0], l + 1, o["id"][1], sorted(o["keys"])[:least]))

        started = False
        for batch in batches:
            if not batch.num_rows:
                continue
            source, key = (batch.column(c).to_numpy() for c in ("source", "key"))
            names, valid = _blocks(batch.column("prefix").to_numpy(), [batch.column(c) for c in CHUNKS])
            for l in range(FAN):
                ok = np.flatnonzero(valid[l])
                if not len(ok):
                    continue
                b, s, k = names[l][ok], source[ok], key[ok]
                new = np.concatenate([[True], (b[1:] != b[:-1]) | (s[1:] != s[:-1])])
                starts = np.flatnonzero(new)
                # different keys of each interval of the batch, at most ``least`` (exact for the threshold)
                group = np.cumsum(new) - 1
                order = np.lexsort((k, group))
                kk, gg = k[order], group[order]
                uniq = np.concatenate([[True], (kk[1:] != kk[:-1]) | (gg[1:] != gg[:-1])])
                kk, gg = kk[uniq], gg[uniq]
                head = np.searchsorted(gg, np.arange(len(starts) + 1))
                many = np.flatnonzero((np.diff(head) >= least) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1))
                for g in many:
                    ident = (int(s[starts[g]]), int(b[starts[g]]))
                    keys = set(kk[head[g] : min(head[g + 1], head[g] + least)].tolist())
                    o = open_[l]
                    if o["id"] == ident:
                        o["keys"] = set(sorted(o["keys"] | keys)[:least])
                        continue
                    close(l, False)
                    open_[l] = {"id": ident, "keys": keys, "head": not started or o["id"] is None}
            started = True
            if out:
                yield _frame(out)
                out.clear()
        for l in range(FAN):
            close(l, True)
        if out:
            yield _frame(out)

    return run


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    s, n, b, k = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(n, pa.int32()), pa.array(b, pa.int64()), pa.array(k, pa.list_(pa.int64()))], names=["source", "chunks", "block", "keys"])


def wide_intervals(array: DataFrame, min_documents: int) -> DataFrame:
    """(source, chunks, block) of the intervals that span at least min_documents different keys."""
    by = ["source", "prefix", *CHUNKS]
    ordered = array.select(*by, "key", "doc", "line_no").repartitionByRange(*by, "doc", "line_no").sortWithinPartitions(*by)
    parts = ordered.select(*by, "key").mapInArrow(_intervals(min_documents), "source long, chunks int, block long, keys array<long>")
    return parts.groupBy("source", "chunks", "block").agg(F.collect_set("keys").alias("sets")).where(F.size(F.array_distinct(F.flatten("sets"))) >= min_documents).drop("sets")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each suffix with the names of its prefix and 1 to FAN chunks."""
    for batch in batches:
        names, valid = _blocks(batch.column("prefix").to_numpy(), [batch.column(c) for c in CHUNKS])
        keep = [batch.column(c) for c in ("doc", "line_no", "source", "length", "prefix")]
        yield pa.RecordBatch.from_arrays([*keep, *[pa.array(n, pa.int64(), mask=~v) for n, v in zip(names, valid)]], names=["doc", "line_no", "source", "length", "prefix", *CHUNKS])


def _stages(array: DataFrame, start: bool) -> DataFrame:
    """(doc, line_no, source, length, chunks, block): every suffix after 1 to FAN of its chunks; with ``start``
    also after none."""
    rows = array.mapInArrow(_named, "doc long, line_no int, source long, length int, prefix long, c1 long, c2 long, c3 long, c4 long")
    after = ["prefix", *CHUNKS]
    tried = F.array(*[F.struct(F.lit(j).alias("chunks"), F.col(c).alias("block")) for j, c in enumerate(after) if j or start])
    return rows.select("doc", "line_no", "source", "length", F.explode(tried).alias("t")).select("doc", "line_no", "source", "length", "t.*").where("block is not null")


def _ends(array: DataFrame, min_documents: int, level: int) -> DataFrame:
    """(doc, line_no, source, length, prefix, full): every suffix of the array taken as far as its chunks are wide;
    full if all FAN are. At the lowest level those that have no wide chunk are left out."""
    # the wide intervals are few beside the suffixes; the planner measures them
    hit = _stages(array, False).join(wide_intervals(array, min_documents), ["source", "chunks", "block"], "left_semi")
    if level:
        hit = hit.unionByName(_stages(array, True).where("chunks = 0").select(hit.columns))
    best = hit.groupBy("doc", "line_no", "source", "length").agg(F.max(F.struct("chunks", "block")).alias("b"))
    return best.select("doc", "line_no", "source", (F.col("length") + F.col("b.chunks") * FAN**level).cast("int").alias("length"), F.col("b.block").alias("prefix"), (F.col("b.chunks") == FAN).alias("full"))


def longest_blocks(docs: DataFrame, min_documents: int) -> DataFrame:
    """(doc, line_no, length): the longest wide block that begins at each line, if there is one. docs as from
    ``identified``, written."""

    def sorted_on(active: DataFrame | None, level: int) -> tuple[DataFrame, DataFrame]:
        at = F.lit(None).cast("array<struct<line:bigint,length:bigint,prefix:bigint>>")
        rows = docs
        if active is not None:
            # at most a document's lines
            own = active.groupBy("doc").agg(F.collect_list(F.struct((F.col("line_no") - 1).cast("long").alias("line"), F.col("length").cast("long").alias("length"), "prefix")).alias("at"))
            rows, at = docs.dropDuplicates(["doc"]).join(own, "doc"), F.col("at")
        array = cut(rows.select("doc", "source", "key", "ids", at.alias("at")).mapInArrow(_suffixes(level), _SUFFIX))
        return array, cut(_ends(array, min_documents, level))

    def stopped(array: DataFrame, ends: DataFrame, level: int) -> DataFrame:
        """All suffixes that pass a stage at which some stop: they are compared there by shorter chunks."""
        stops = ends.where("not full").select("source", "length", F.col("prefix").alias("block")).distinct()
        passed = _stages(array, True).select("doc", "line_no", "source", (F.col("length") + F.col("chunks") * FAN**level).cast("int").alias("length"), "block")
        return passed.join(stops, ["source", "length", "block"], "left_semi").select("doc", "line_no", "length", F.col("block").alias("prefix")).distinct()

    up, every = [sorted_on(None, 0)], []
    while not (full := up[-1][1].where("full")).isEmpty():
        up.append(sorted_on(full.select("doc", "line_no", "length", "prefix").distinct(), len(up)))
    every += [ends for _, ends in up]
    down = None
    for level in range(len(up) - 1, 0, -1):
        active = stopped(*up[level], level)
        if down is not None:
            active = active.unionByName(stopped(*down, level)).distinct()
        down = sorted_on(active, level - 1)
        every.append(down[1])
    out = every[0].select("doc", "line_no", "length")
    for ends in every[1:]:
        out = out.unionByName(ends.select("doc", "line_no", "length"))
    return out.groupBy("doc", "line_no").agg(F.max("length").alias("length"))


def repeated_blocks(docs: DataFrame, doc: str, source: str, key: str, text: str, min_documents: int = 3) -> DataFrame:
    """(doc, line_no, length) of every block that spans at least min_documents different keys of its source and
    lies in no longer one."""
    held = cut(identified(docs, doc, source, key, text))  # read by every sort
    longest = longest_blocks(held, min_documents)
    # a document's lines: those whose block ends no later than that of the line before are inside of it
    blocks = F.array_sort(F.collect_list(F.struct("line_no", "length")))
    each = longest.groupBy("doc").agg(blocks.alias("b"))
    outer = F.filter("b", lambda x, i: (i == 0) | (F.get("b", i - 1)["line_no"] + F.get("b", i - 1)["length"] < x["line_no"] + x["length"]))
    return each.select("doc", F.explode(outer).alias("x")).select("doc", "x.line_no", "x.length")


def repeated_lines(docs: DataFrame, doc: str, source: str, key: str, text: str, min_documents: int = 3) -> DataFrame:
    """(doc, line_no) of every line that lies in a repeated block."""
    blocks = repeated_blocks(docs, doc, source, key, text, min_documents)
    return blocks.select("doc", F.explode(F.sequence("line_no", F.col("line_no") + F.col("length") - 1)).alias("line_no")).distinct()


def stripped(docs: DataFrame, doc: str, text: str, lines: DataFrame) -> DataFrame:
    """(doc, text) with the given (doc, line_no) taken out; other lines stay as they are, in order."""
    gone = lines.groupBy(F.col("doc").alias(doc)).agg(F.collect_set("line_no").alias("_gone"))  # at most a document's lines
    kept = F.expr(f"filter(transform(split(`{text}`, '\\n', -1), (x, i) -> if(array_contains(coalesce(_gone, array()), i + 1), null, x)), x -> x is not null)")
    return docs.select(doc, text).join(gone, doc, "left").select(doc, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text))
