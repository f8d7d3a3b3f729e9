"""Search, detail, statistics and ranking of postings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import like_escaped
from postmill.functions.vectors import cosine, round_half_up

SUMMARY = ["id", "company_name", "title", "location", "department", "url", "posted_at", "closed_at", "canonical_id"]


def with_company(postings: DataFrame, companies: DataFrame) -> DataFrame:
    """Postings of known companies with company_name. The companies' side is left to the planner, which
    broadcasts it while its size is below the session's threshold.
    """
    return postings.join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name")), "company_id")


def clamped(limit: int, offset: int = 0) -> tuple[int, int]:
    return max(1, min(limit, 500)), max(offset, 0)


def search(postings: DataFrame, companies: DataFrame, q: str | None = None, company_id: int | None = None, location: str | None = None, include_duplicates: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of open postings, newest first. In q and location % and _ are wildcards."""
    limit, offset = clamped(limit, offset)
    rows = postings.where(F.col("closed_at").isNull())
    if not include_duplicates:
        rows = rows.where(F.col("canonical_id").isNull())
    if q and q.strip():
        like = f"%{like_escaped(q.strip())}%"
        rows = rows.where(F.col("title").ilike(like) | F.col("normalized_title").ilike(like))
    if company_id is not None:
        rows = rows.where(F.col("company_id") == company_id)
    if location and location.strip():
        rows = rows.where(F.col("location").ilike(f"%{like_escaped(location.strip())}%"))
    page = with_company(rows, companies).select(*SUMMARY).orderBy(F.col("posted_at").desc_nulls_last(), "id")
    return (page.offset(offset) if offset else page).limit(limit)


def by_ids(postings: DataFrame, companies: DataFrame, ids: list[int]) -> DataFrame:
    """Postings of a caller's list of ids; of an empty list none."""
    rows = postings.where(F.col("id").isin([int(i) for i in ids])) if ids else postings.limit(0)
    return with_company(rows, companies)


def duplicates_of(postings: DataFrame, companies: DataFrame, posting_id: int | None) -> DataFrame:
    return with_company(postings.where(F.col("canonical_id") == posting_id), companies).select(*SUMMARY).orderBy("id")


def job_detail(postings: DataFrame, companies: DataFrame, posting_id: int) -> DataFrame:
    """The posting, open or not, with the summaries of the duplicates of its canonical posting."""
    one = with_company(postings.where(F.col("id") == posting_id), companies).drop("embedding", "embedding_hash")
    # looked up first, so that the scan for the duplicates filters on a value
    found = postings.where(F.col("id") == posting_id).select(F.coalesce("canonical_id", "id")).head()
    summaries = duplicates_of(postings, companies, found[0] if found else None)
    others = summaries.agg(F.array_sort(F.collect_list(F.struct(*SUMMARY))).alias("duplicates"))  # the caller's page; ids come first
    return one.crossJoin(others)  # one row each


def embedded(postings: DataFrame) -> DataFrame:
    """(id, embedding) of open canonical postings with embedding."""
    return postings.where(F.col("closed_at").isNull() & F.col("canonical_id").isNull() & F.col("embedding").isNotNull()).select("id", "embedding")


def stats(postings: DataFrame, companies: DataFrame) -> DataFrame:
    """One row: companies, open, duplicate, canonical, embedded and closed postings, and the duplicate rate."""
    is_open, canonical = F.col("closed_at").isNull(), F.col("canonical_id").isNull()
    counts = postings.agg(
        F.count_if(is_open).alias("open_postings"),
        F.count_if(is_open & ~canonical).alias("duplicates"),
        F.count_if(is_open & canonical).alias("canonical_postings"),
        F.count_if(is_open & canonical & F.col("embedding").isNotNull()).alias("embedded"),
        F.count_if(~is_open).alias("closed"),
    )
    rate = F.when(F.col("open_postings") == 0, F.lit(0.0)).otherwise(round_half_up(F.try_divide("duplicates", "open_postings"), 3))
    return companies.agg(F.count("*").alias("companies")).crossJoin(counts).withColumn("duplicate_rate", rate)  # one row each


def recent_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    return runs.orderBy(F.col("id").desc()).limit(n)


def match(postings: DataFrame, companies: DataFrame, query: list[float], limit: int = 25, location: str | None = None, over_fetch: bool = False) -> DataFrame:
    """The postings most similar to a query vector: score (4 digits) and the posting's summary.

    Vectors of another length are passed over; scores that are no number come last. A location is a literal part of the posting's, letter case
    ignored; by default it is applied before ranking, so the result is exact. With over_fetch the best
    max(20 limit, 500) of all are taken first, and fewer than limit may be left.
    """
    limit, _ = clamped(limit)
    n = len(query)
    vector = F.array(*[F.lit(float(x)).cast("float") for x in query])
    needle = location.strip().lower() if location and location.strip() else None
    inside = F.coalesce(F.contains(F.lower("location"), F.lit(needle)), F.lit(False)) if needle else None
    rows = postings.where(F.col("closed_at").isNull() & F.col("canonical_id").isNull() & F.col("embedding").isNotNull())
    if needle and not over_fetch:
        rows = rows.where(inside)
    # the guard is in the expression too: filters may be reordered
    score = F.when(F.size("embedding") == n, cosine(F.when(F.size("embedding") == n, F.col("embedding")).otherwise(vector), vector))
    keep = max(limit * 20, 500) if needle and over_fetch else limit
    best = rows.where(F.size("embedding") == n).select("id", score.alias("exact")).withColumn("exact", F.when(~F.isnan("exact"), F.col("exact"))).orderBy(F.col("exact").desc_nulls_last(), "id").limit(keep)
    found = with_company(best.join(postings.drop("embedding"), "id"), companies)
    if needle and over_fetch:
        found = found.where(inside)
    return found.orderBy(F.col("exact").desc_nulls_last(), "id").limit(limit).select(round_half_up(F.col("exact"), 4).alias("score"), *SUMMARY[:-2])


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All dot products in the order and types of ``vectors.dot``: float products, summed in double."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += np.multiply.outer(a[:, i], b[:, i])
    return out


def _norms(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * a[:, i]
    return np.sqrt(out)


def _best_of_tile(limit: int, strip: int = 64):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q_id, ids, score = [], [], []
        q_ids, r_ids = queries["query_id"].to_numpy(), rows["id"].to_numpy()
        if len(q_ids) and len(r_ids):
            q = np.array(queries["vector"].to_pylist(), np.float32)
            r = np.array(rows["vector"].to_pylist(), np.float32)
            own = _norms(r)
            for at in range(0, len(q), strip):
                part = q[at : at + strip]
                norms = _norms(part)[:, None] * own
                sims = np.divide(_dots(part, r), norms, out=np.zeros(norms.shape), where=norms != 0)
                for k, s in enumerate(sims):
                    best = np.lexsort((r_ids, -s))[:limit]
                    q_id.append(np.full(len(best), q_ids[at + k]))
                    ids.append(r_ids[best])
                    score.append(s[best])
        join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
        return pa.table({"query_id": join(q_id, np.int64), "id": join(ids, np.int64), "exact": join(score, np.float64)})

    return run


def match_all(postings: DataFrame, companies: DataFrame, queries: DataFrame, limit: int = 25, block_rows: int = 16_384) -> DataFrame:
    """``match`` for every query (query_id, vector) at once: the best ``limit`` postings of each.

    Blocks of queries meet blocks of postings, one tile a task, which keeps the best of each query. Vectors with
    an element that is null or no finite number are passed over, queries too; lengths must be equal.
    """
    limit, _ = clamped(limit)
    fine = lambda v: F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    rows = embedded(postings.join(companies.select(F.col("id").alias("company_id")), "company_id", "left_semi")).where(fine(F.col("embedding"))).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("vector"))
    asked = queries.where(fine(F.col("vector"))).select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<float>").alias("vector"))
    g, h = (max(1, -(-t.count() // block_rows)) for t in (asked, rows))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.select("*", F.size("vector").alias("n"), block("query_id", g).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("h"))
    right = rows.select("*", F.size("vector").alias("n"), block("id", h).alias("h"), F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("g"))
    found = left.groupBy("n", "g", "h").cogroup(right.groupBy("n", "g", "h")).applyInArrow(_best_of_tile(limit), "query_id long, id long, exact double")
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("exact").desc(), "id"))).where(F.col("place") <= limit)
    return with_company(best.join(postings.drop("embedding"), "id"), companies).select("query_id", round_half_up(F.col("exact"), 4).alias("score"), *SUMMARY[:-2])


def postings_ranked(postings: DataFrame) -> DataFrame:
    """How many postings a ranking looks at, those with vectors of another length too."""
    return embedded(postings).agg(F.count("*").alias("postings_ranked"))
