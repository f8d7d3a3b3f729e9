"""Queries of the posting operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import schemas
from postmill.functions import text as X
from postmill.functions import vectors
from postmill.functions.plain import error_column
from postmill.operators import boilerplate, cluster, embed, search, snapshot
from postmill.plans.service import as_json
from postmill.session import spread, table
from postmill.sources import boards
from postmill.sources.embedding_api import sent_text

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _pc(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "job_postings"), table(spark, d, "companies")


def _weighed(vector) -> Column:
    """A whole number that every element of a vector and its place go into; what is no finite number counts as 0."""
    plain = F.transform(vector, lambda x, i: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x.cast("double") * (i + 1)))
    return F.floor(F.aggregate(plain, F.lit(0.0), lambda a, x: a + x) * 1000 + 0.5)


_WEIGHED = "CAST(floor(coalesce(list_sum(list_transform(list_zip({v}, range(1, len({v}) + 1)), lambda z: CASE WHEN z[1] IS NULL OR isnan(z[1]) OR isinf(z[1]) THEN 0 ELSE CAST(z[1] AS DOUBLE) * z[2] END)), 0) * 1000 + 0.5) AS BIGINT)"
_STRIP = r"regexp_replace(regexp_replace({c}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"
_OPEN = "p.closed_at IS NULL"


@query("SELECT id, name, source, board_token, enabled FROM companies")
def companies_all(spark, d):
    return table(spark, d, "companies").select("id", "name", "source", "board_token", "enabled").orderBy("name")


@query("SELECT id, name, source, board_token FROM companies WHERE enabled")
def companies_enabled(spark, d):
    return table(spark, d, "companies").where("enabled").select("id", "name", "source", "board_token").orderBy("name")


@query("SELECT * REPLACE (started_at AT TIME ZONE 'UTC' AS started_at, finished_at AT TIME ZONE 'UTC' AS finished_at) FROM ingestion_runs ORDER BY id DESC LIMIT 5")
def recent_runs(spark, d):
    return search.recent_runs(table(spark, d, "ingestion_runs"), 5)


@query("SELECT p.id, c.name AS company_name, p.title, p.content_hash FROM job_postings p JOIN companies c ON c.id = p.company_id WHERE p.id = 42")
def posting_by_id(spark, d):
    p, c = _pc(spark, d)
    return search.by_ids(p, c, [42]).select("id", "company_name", "title", "content_hash")


@query("SELECT p.id, c.name AS company_name, p.title FROM job_postings p JOIN companies c ON c.id = p.company_id WHERE p.id IN (3, 5, 8, 13, 21, 34, 999999999)")
def postings_by_ids(spark, d):
    p, c = _pc(spark, d)
    return search.by_ids(p, c, [3, 5, 8, 13, 21, 34, 999999999]).select("id", "company_name", "title")


@query(f"SELECT id, len(embedding) AS n, {_WEIGHED.format(v='embedding')} AS weighed FROM job_postings WHERE closed_at IS NULL AND canonical_id IS NULL AND embedding IS NOT NULL")
def embedded_canonical(spark, d):
    return search.embedded(table(spark, d, "job_postings")).select("id", F.size("embedding").cast("long").alias("n"), _weighed("embedding").alias("weighed"))


_GH_SQL = f"""SELECT CAST(id AS VARCHAR) AS external_id, {_STRIP.format(c="title")} AS title, location.name AS location, departments[1].name AS department, absolute_url AS url,
epoch_us(CAST(coalesce(first_published, updated_at) AS TIMESTAMPTZ)) AS posted_us FROM greenhouse"""


@query(_GH_SQL)
def greenhouse_jobs(spark, d):
    jobs = boards.greenhouse_jobs(table(spark, d, "greenhouse"))
    return jobs.select("external_id", "title", "location", "department", "url", F.unix_micros("posted_at").alias("posted_us"))


@query()
def greenhouse_text(spark, d):
    return boards.greenhouse_jobs(spread(table(spark, d, "greenhouse"))).select("external_id", "description")


def _escaped(c) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c


_FLAT = r"regexp_replace(coalesce({c}, ''), '[ \t\n\r\f]+', ' ', 'g')"


def _lever_payloads(p: DataFrame) -> DataFrame:
    posting = F.struct(
        F.col("external_id").alias("id"), F.col("title").alias("text"), F.col("url").alias("hostedUrl"), F.unix_millis("posted_at").alias("createdAt"),
        F.struct("location", F.when(F.col("id") % 3 != 0, F.col("department")).alias("team"), F.col("department")).alias("categories"), F.col("description").alias("descriptionPlain"),
        F.array(
            F.struct(F.lit("Role").alias("text"), F.concat(F.lit("<p>"), F.coalesce("normalized_title", F.lit("")), F.lit("</p><div>A <b>good</b>&nbsp; place</div>")).alias("content")),
            F.struct(F.lit(None).cast("string").alias("text"), F.lit("<ul><li>one<li>two &amp; three</ul>").alias("content")),
        ).alias("lists"),
        F.when(F.col("id") % 2 == 0, F.col("url")).alias("additionalPlain"),
    )
    return p.select("id", F.to_json(F.array(posting)).alias("payload"))


_WS = "regexp_replace({c}, chr(160), ' ', 'g')"
_WS = f"regexp_replace({_WS}, '[ \\t]+', ' ', 'g')"
_WS = f"regexp_replace({_WS}, ' ?\\n ?', chr(10), 'g')"
_WS = f"regexp_replace({_WS}, '\\n{{{{3,}}}}', chr(10) || chr(10), 'g')"
_WS = f"regexp_replace(regexp_replace({_WS}, '^[\\s\\p{{{{Z}}}}]+', ''), '[\\s\\p{{{{Z}}}}]+$', '')"


_LEVER_TEXT = "coalesce(description, '') || chr(10) || chr(10) || 'Role' || chr(10) || CASE WHEN coalesce(normalized_title, '') = '' THEN '' ELSE normalized_title || chr(10) END || 'A good place' || chr(10) || chr(10) || chr(10) || 'one' || chr(10) || 'two & three' || CASE WHEN id % 2 = 0 AND url IS NOT NULL THEN chr(10) || chr(10) || url ELSE '' END"


@query(f"""SELECT id AS posting_id, external_id, {_STRIP.format(c="title")} AS title, location, department, url, {_WS.format(c=_LEVER_TEXT)} AS description,
CAST(floor(epoch_us(posted_at) / 1000) AS BIGINT) AS posted_ms FROM job_postings""")
def lever_postings(spark, d):
    """Payloads made of the postings are parsed and projected back."""
    p = table(spark, d, "job_postings")
    rows = _lever_payloads(spread(p)).withColumnRenamed("id", "posting_id")
    jobs = boards.from_json_column(rows, "payload", "LEVER")
    return jobs.select("posting_id", "external_id", "title", "location", "department", "url", "description", F.unix_millis("posted_at").alias("posted_ms"))


_MARKED = f"{_FLAT.format(c='title')} || chr(10) || {_FLAT.format(c='department')} || chr(10) || {_FLAT.format(c='location')} || chr(10) || 'a < b & c ' || {_FLAT.format(c='normalized_title')}"


@query(f"SELECT CAST(id AS VARCHAR) AS external_id, {_WS.format(c=_MARKED)} AS description FROM job_postings")
def escaped_markup_text(spark, d):
    """Markup made of the postings, escaped as boards deliver it, becomes their text again."""
    p = table(spark, d, "job_postings")
    text = lambda c: _escaped(F.coalesce(c, F.lit("")))
    last = F.concat(F.lit("<ul><li>"), text("location"), F.lit("</li><li><i>a &lt; b &amp; c</i> "), text("normalized_title"), F.lit("</li></ul><style>p {}</style>"))
    markup = F.concat(F.lit("<h2>"), text("title"), F.lit("</h2><p>"), text("department"), F.lit("</p>\n"), last)
    none = F.lit(None).cast("string")
    jobs = p.select("id", none.alias("title"), none.alias("absolute_url"), none.alias("updated_at"), none.alias("first_published"), F.struct(none.alias("name")).alias("location"), F.array(F.struct(none.alias("name"))).alias("departments"), _escaped(markup).alias("content"))
    return boards.greenhouse_jobs(jobs).select("external_id", "description")


@query("SELECT id, normalized_title AS title_key FROM job_postings")
def title_keys(spark, d):
    """The stored keys are the keys of the titles."""
    return spread(table(spark, d, "job_postings").select("id", "title", "location")).select("id", X.title_key(F.col("title"), F.col("location")).alias("title_key"))


@query(f"""SELECT id, sha256(title || chr(0) || coalesce(location, 'null') || chr(0) || coalesce(department, 'null') || chr(0) || description || chr(0)) AS content_hash, {_WS.format(c="description")} AS squeezed FROM job_postings""")
def content_hashes(spark, d):
    h = X.content_hash(F.col("title"), F.col("location"), F.col("department"), F.col("description"))
    return table(spark, d, "job_postings").select("id", h.alias("content_hash"), X.normalize_whitespace(F.col("description")).alias("squeezed"))


@query("SELECT id, coalesce(substring(last_poll_error, 1, 500), 'unknown error') AS error FROM companies")
def poll_errors(spark, d):
    return table(spark, d, "companies").select("id", error_column(F.col("last_poll_error")).alias("error"))


@query("SELECT to_json({'id': id, 'name': name, 'source': source, 'enabled': enabled, 'last_poll_error': last_poll_error}) AS value FROM companies")
def companies_json(spark, d):
    return as_json(table(spark, d, "companies").select("id", "name", "source", "enabled", "last_poll_error"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name FROM (DESCRIBE {t})" for t in ("companies", "job_postings", "ingestion_runs")))
def table_columns(spark, d):
    """The columns of the state's tables."""
    rows = [(name, c) for name, schema in (("companies", schemas.COMPANIES), ("job_postings", schemas.POSTINGS), ("ingestion_runs", schemas.RUNS)) for c in schema.fieldNames()]
    return spark.createDataFrame(rows, "table_name string, column_name string")


@query("""WITH last AS (SELECT max(id) + 1 AS n FROM ingestion_runs)
SELECT id, started_at AT TIME ZONE 'UTC' AS started_at, CASE WHEN id = n - 1 THEN TIMESTAMP '2026-09-05 00:00:00' ELSE finished_at AT TIME ZONE 'UTC' END AS finished_at,
CAST(CASE WHEN id = n - 1 THEN 7 ELSE postings_new END AS INT) AS postings_new, CAST(CASE WHEN id = n - 1 THEN 0 ELSE postings_closed END AS INT) AS postings_closed FROM ingestion_runs, last
UNION ALL SELECT n, TIMESTAMP '2026-09-05 00:00:00', NULL, 0, 0 FROM last""")
def run_rows(spark, d):
    """The last run is finished and another one begun."""
    runs, at = table(spark, d, "ingestion_runs"), F.lit("2026-09-05 00:00:00 UTC").cast("timestamp")
    n = runs.agg(F.max("id")).head()[0]
    done = snapshot.finish_run(runs, n, at, {"postings_new": 7})
    return snapshot.start_run(done, n + 1, at).select("id", "started_at", "finished_at", "postings_new", "postings_closed")


@query("SELECT count(*) AS postings_ranked FROM job_postings WHERE closed_at IS NULL AND canonical_id IS NULL AND embedding IS NOT NULL")
def postings_ranked(spark, d):
    return search.postings_ranked(table(spark, d, "job_postings"))


@query("SELECT id, content_hash AS embedding_hash FROM job_postings WHERE FALSE")
def embedding_disabled(spark, d):
    """Without an embedder nothing is embedded."""
    return embed.embed_pending(*_pc(spark, d), None).select("id", "embedding_hash")


_SUMMARY = "p.id, c.name AS company_name, p.title, p.location, p.department, p.url, p.posted_at AT TIME ZONE 'UTC' AS posted_at, p.closed_at AT TIME ZONE 'UTC' AS closed_at, p.canonical_id"


@query(f"SELECT {_SUMMARY} FROM job_postings p JOIN companies c ON c.id = p.company_id WHERE {_OPEN} AND p.canonical_id IS NULL AND (p.title ILIKE '%engineer%' OR p.normalized_title ILIKE '%engineer%') AND p.location ILIKE '%remote%' ORDER BY p.posted_at DESC NULLS LAST, p.id LIMIT 50 OFFSET 5")
def search_page(spark, d):
    return search.search(*_pc(spark, d), q=" engineer ", location="remote", limit=50, offset=5)


@query(f"SELECT {_SUMMARY} FROM job_postings p JOIN companies c ON c.id = p.company_id WHERE {_OPEN} AND (p.title ILIKE '%s_nior%data%' OR p.normalized_title ILIKE '%s_nior%data%') AND p.company_id = 1 ORDER BY p.posted_at DESC NULLS LAST, p.id LIMIT 500")
def search_with_duplicates(spark, d):
    return search.search(*_pc(spark, d), q="s_nior%data", company_id=1, include_duplicates=True, limit=9999)


@query(f"SELECT {_SUMMARY} FROM job_postings p JOIN companies c ON c.id = p.company_id WHERE p.canonical_id IS NOT NULL")
def duplicate_summaries(spark, d):
    p, c = _pc(spark, d)
    return search.with_company(p.where(F.col("canonical_id").isNotNull()), c).select(*search.SUMMARY)


@query(f"""WITH one AS (SELECT * FROM job_postings WHERE canonical_id IS NOT NULL ORDER BY id LIMIT 1)
SELECT o.id, o.title, (SELECT string_agg(CAST(p.id AS VARCHAR), ',' ORDER BY p.id) FROM job_postings p WHERE p.canonical_id = o.canonical_id) AS duplicate_ids FROM one o JOIN companies c ON c.id = o.company_id""")
def job_detail(spark, d):
    p, c = _pc(spark, d)
    first = p.where(F.col("canonical_id").isNotNull()).agg(F.min("id")).head()[0]
    found = search.job_detail(p, c, first if first is not None else -1)
    return found.select("id", "title", F.array_join(F.transform("duplicates", lambda x: x["id"].cast("string")), ",").alias("duplicate_ids"))


@query("""SELECT (SELECT count(*) FROM companies) AS companies, open_postings, duplicates, canonical_postings, embedded, closed,
CASE WHEN open_postings = 0 THEN 0 ELSE floor(duplicates / open_postings * 1000 + 0.5) / 1000 END AS duplicate_rate FROM (SELECT
count(*) FILTER (WHERE closed_at IS NULL) AS open_postings, count(*) FILTER (WHERE closed_at IS NULL AND canonical_id IS NOT NULL) AS duplicates,
count(*) FILTER (WHERE closed_at IS NULL AND canonical_id IS NULL) AS canonical_postings, count(*) FILTER (WHERE closed_at IS NULL AND canonical_id IS NULL AND embedding IS NOT NULL) AS embedded,
count(*) FILTER (WHERE closed_at IS NOT NULL) AS closed FROM job_postings)""")
def stats(spark, d):
    return search.stats(*_pc(spark, d))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(CAST(z[1] AS FLOAT) * CAST(z[2] AS FLOAT) AS DOUBLE)))"
_RANK = f"""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
scored AS (SELECT p.*, c.name AS company_name, {_DOT.format(a="p.embedding", b="q.v")} / (sqrt({_DOT.format(a="p.embedding", b="p.embedding")}) * sqrt({_DOT.format(a="q.v", b="q.v")})) AS s,
sqrt({_DOT.format(a="p.embedding", b="p.embedding")}) AS norm
FROM job_postings p JOIN companies c ON c.id = p.company_id, q WHERE p.closed_at IS NULL AND p.canonical_id IS NULL AND len(p.embedding) = len(q.v) AND len(list_filter(p.embedding, lambda x: x IS NULL)) = 0),
safe AS (SELECT *, CASE WHEN norm = 0 THEN 0 ELSE s END AS score0 FROM scored)
SELECT floor(score0 * 10000 + 0.5) / 10000 AS score, id, company_name, title, location, department, url, posted_at AT TIME ZONE 'UTC' AS posted_at, score0 FROM safe"""


def _query_vector(spark, d) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").select("embedding").head()[0]]


def _finite(p: DataFrame) -> DataFrame:
    """Postings without a not-a-number in the vector, which would sort first."""
    return p.where(~F.coalesce(F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull()), F.lit(False)))


_FINITE = " WHERE len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0"


@query(f"SELECT * EXCLUDE (score0) FROM ({_RANK}{_FINITE} ORDER BY score0 DESC, id LIMIT 25)")
def match_topk(spark, d):
    p, c = _pc(spark, d)
    return search.match(_finite(p), c, _query_vector(spark, d))


@query(f"SELECT * EXCLUDE (score0) FROM ({_RANK}{_FINITE} AND contains(lower(location), 'remote') ORDER BY score0 DESC, id LIMIT 25)")
def match_located(spark, d):
    p, c = _pc(spark, d)
    return search.match(_finite(p), c, _query_vector(spark, d), location=" Remote ")


@query(f"SELECT * EXCLUDE (score0) FROM (SELECT * FROM ({_RANK}{_FINITE} ORDER BY score0 DESC, id LIMIT 500) WHERE contains(lower(location), 'remote') ORDER BY score0 DESC, id LIMIT 25)")
def match_over_fetched(spark, d):
    """The best 500 of all are taken first, then the place is looked at."""
    p, c = _pc(spark, d)
    return search.match(_finite(p), c, _query_vector(spark, d), location="remote", over_fetch=True)


_RANKS = _RANK.replace("SELECT embedding AS v FROM embeddings WHERE vec_id = 0", "SELECT vec_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0").replace("scored AS (SELECT p.*,", "scored AS (SELECT q.vec_id, p.*,").replace(" AS score, id,", " AS score, vec_id AS query_id, id,")


@query(f"SELECT * EXCLUDE (score0) FROM ({_RANKS}{_FINITE} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score0 DESC, id) <= 25)")
def match_batch(spark, d):
    """Every vector whose id is divisible by 100 is a query against all postings."""
    p, c = _pc(spark, d)
    return search.match_all(p, c, table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")))


@query(f"""WITH e AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, floor({_DOT.format(a="e.embedding", b="q.v")} / (sqrt({_DOT.format(a="e.embedding", b="e.embedding")}) * sqrt({_DOT.format(a="q.v", b="q.v")})) * 10000 + 0.5) / 10000 AS score FROM e, q""")
def cosine_scores(spark, d):
    """Every stored vector against the first."""
    q = F.array(*[F.lit(x).cast("float") for x in _query_vector(spark, d)])
    return table(spark, d, "embeddings").select("vec_id", vectors.round_half_up(vectors.cosine(F.col("embedding"), q), 4).alias("score"))


_LINES = r"""SELECT id, company_id, normalized_title, pos, trim(line, ' ') AS line FROM (SELECT id, company_id, normalized_title, closed_at, unnest(string_split(description, chr(10))) AS line,
unnest(range(len(string_split(description, chr(10))))) AS pos FROM job_postings) WHERE trim(line, ' ') <> ''"""
_BOILERPLATE = f"""SELECT company_id, md5(line) AS line_hash FROM ({_LINES} AND closed_at IS NULL) GROUP BY company_id, md5(line) HAVING count(DISTINCT normalized_title) >= 3"""


@query(_BOILERPLATE)
def boilerplate_lines(spark, d):
    return boilerplate.boilerplate(table(spark, d, "job_postings"))


_TEXTS = f"""bp AS ({_BOILERPLATE}), ln AS ({_LINES}),
kept AS (SELECT id, string_agg(line || chr(10), '' ORDER BY pos) AS kept FROM ln WHERE (company_id, md5(line)) NOT IN (SELECT (company_id, line_hash) FROM bp) GROUP BY id),
roles AS (SELECT p.id, CASE WHEN p.company_id IN (SELECT company_id FROM bp) THEN coalesce(k.kept, '') ELSE p.description END AS role_text, p.description FROM job_postings p LEFT JOIN kept k ON k.id = p.id),
texts AS (SELECT id, CASE WHEN length(role_text) + len(regexp_extract_all(role_text, '[\\x{{10000}}-\\x{{10FFFF}}]')) < 300 THEN description ELSE role_text END AS text FROM roles)""".replace("{{", "{").replace("}}", "}")


@query(f"WITH {_TEXTS} SELECT id, text FROM texts")
def stripped_descriptions(spark, d):
    p = table(spark, d, "job_postings")
    return boilerplate.compared_text(p, boilerplate.boilerplate(p))


_TOKENS = r"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}+#]+'), lambda x: x <> '')"
_SHINGLES = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END"


@query(f"SELECT id, len({_SHINGLES}) AS n FROM (SELECT id, {_TOKENS.format(c='description')} AS w FROM job_postings)")
def shingle_counts(spark, d):
    return table(spark, d, "job_postings").select("id", F.size(X.shingles(F.col("description"), 4)).cast("long").alias("n"))


_CANDIDATES = """cand AS (SELECT p.id, p.company_id, p.normalized_title, p.posted_at FROM job_postings p JOIN (SELECT company_id, normalized_title FROM job_postings
WHERE closed_at IS NULL GROUP BY company_id, normalized_title HAVING count(*) > 1) g ON g.company_id = p.company_id AND g.normalized_title = p.normalized_title WHERE p.closed_at IS NULL)"""


@query(f"WITH {_CANDIDATES} SELECT id, company_id, normalized_title FROM cand")
def dedup_candidates(spark, d):
    return cluster.candidates(table(spark, d, "job_postings")).select("id", "company_id", "normalized_title")


@query(f"""WITH {_CANDIDATES},
w AS (SELECT c.id, c.company_id, c.normalized_title, {_TOKENS.format(c='p.description')} AS w FROM cand c JOIN job_postings p USING (id)),
s AS (SELECT id, company_id, normalized_title, {_SHINGLES} AS s FROM w)
SELECT company_id, normalized_title, count(*) AS pairs, floor(max(CASE WHEN len(a.s) = 0 AND len(b.s) = 0 THEN 1 ELSE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END) * 10000 + 0.5) / 10000 AS most
FROM s a JOIN s b USING (company_id, normalized_title) WHERE a.id = (SELECT min(id) FROM s m WHERE m.company_id = a.company_id AND m.normalized_title = a.normalized_title) AND b.id > a.id GROUP BY company_id, normalized_title""")
def head_similarity(spark, d):
    """Each group's first posting against the others."""
    c = cluster.candidates(table(spark, d, "job_postings")).select("id", "company_id", "normalized_title", "description")
    heads = c.groupBy("company_id", "normalized_title").agg(F.min_by(F.struct("id", "description"), "id").alias("h"))
    both = c.join(heads, ["company_id", "normalized_title"]).where(F.col("id") > F.col("h.id"))
    sets = both.select("company_id", "normalized_title", X.shingles(F.col("h.description"), 4).alias("a"), X.shingles(F.col("description"), 4).alias("b"))
    most = vectors.round_half_up(F.max(X.jaccard(F.col("a"), F.col("b"))), 4)
    return sets.groupBy("company_id", "normalized_title").agg(F.count("*").alias("pairs"), most.alias("most"))


_LEADERS = f"""WITH RECURSIVE {_CANDIDATES}, {_TEXTS},
r AS (SELECT c.id, c.company_id, c.normalized_title, row_number() OVER (PARTITION BY c.company_id, c.normalized_title ORDER BY c.posted_at NULLS LAST, c.id) AS k, {_TOKENS.format(c='t.text')} AS w FROM cand c JOIN texts t USING (id)),
s AS (SELECT id, company_id, normalized_title, k, {_SHINGLES} AS s FROM r),
e AS (SELECT b.id, list(a.k ORDER BY a.k) AS earlier FROM s a JOIN s b ON a.company_id = b.company_id AND a.normalized_title = b.normalized_title AND a.k < b.k
  WHERE (len(a.s) = 0 AND len(b.s) = 0) OR (len(list_intersect(a.s, b.s)) > 0 AND 10 * len(list_intersect(a.s, b.s)) >= 7 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))) GROUP BY b.id),
n AS (SELECT s.id, s.company_id, s.normalized_title, s.k, coalesce(e.earlier, []) AS earlier FROM s LEFT JOIN e USING (id)),
walk AS (SELECT company_id, normalized_title, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS led, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS first FROM (SELECT DISTINCT company_id, normalized_title FROM n)
  UNION ALL SELECT n.company_id, n.normalized_title, n.k, CASE WHEN list_has_any(w.led, n.earlier) THEN w.led ELSE list_append(w.led, n.k) END, n.id, list_min(list_intersect(w.led, n.earlier))
  FROM walk w JOIN n ON n.company_id = w.company_id AND n.normalized_title = w.normalized_title AND n.k = w.k + 1)
"""


@query(_LEADERS + "SELECT w.id, n.id AS canonical_id FROM walk w JOIN n ON n.company_id = w.company_id AND n.normalized_title = w.normalized_title AND n.k = w.first")
def leader_clusters(spark, d):
    return cluster.deduplicate(table(spark, d, "job_postings"))


@query(_LEADERS + "SELECT p.id, l.canonical_id FROM job_postings p LEFT JOIN (SELECT w.id, n.id AS canonical_id FROM walk w JOIN n ON n.company_id = w.company_id AND n.normalized_title = w.normalized_title AND n.k = w.first) l USING (id)")
def replaced_links(spark, d):
    p = table(spark, d, "job_postings")
    return snapshot.replace_links(p, cluster.deduplicate(p)).select("id", "canonical_id")


_TEXT_SQL = "p.title || ' at ' || c.name || CASE WHEN p.location IS NOT NULL THEN chr(10) || 'Location: ' || p.location ELSE '' END || CASE WHEN p.department IS NOT NULL THEN chr(10) || 'Team: ' || p.department ELSE '' END || chr(10) || chr(10) || p.description"


@query(f"SELECT p.id, {_TEXT_SQL} AS text, p.content_hash FROM job_postings p JOIN companies c ON c.id = p.company_id WHERE {_OPEN} AND p.canonical_id IS NULL AND (p.embedding IS NULL OR p.embedding_hash IS DISTINCT FROM p.content_hash)")
def pending_embeddings(spark, d):
    return embed.pending_work(*_pc(spark, d))


_PENDING = f"FROM job_postings p JOIN companies c ON c.id = p.company_id WHERE {_OPEN} AND p.canonical_id IS NULL AND (p.embedding IS NULL OR p.embedding_hash IS DISTINCT FROM p.content_hash)"


@query(f"SELECT p.id, left({_TEXT_SQL}, 500) AS text {_PENDING} ORDER BY p.id LIMIT 120")
def pending_requests(spark, d):
    """The first 120 texts as a remote service that takes 500 characters gets them."""
    return embed.pending_work(*_pc(spark, d), limit=120).select("id", sent_text(F.col("text"), 500).alias("text"))


# every word of more than two characters counts at the remainder of its 31-polynomial
_SLOT = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(w, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda h, ch: (h * 31 + ch) % 256)"


@query(f"SELECT id, embedding_hash, 256 AS n, CAST(coalesce(list_sum(list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+'), lambda w: length(w) > 2), lambda w: {_SLOT} + 1)), 0) * 1000 AS BIGINT) AS weighed FROM (SELECT p.id, p.content_hash AS embedding_hash, {_TEXT_SQL} AS text {_PENDING})")
def embedded_pending(spark, d):
    out = embed.embed_pending(*_pc(spark, d), embed.word_counts)
    return out.select("id", "embedding_hash", F.size("embedding").alias("n"), _weighed("embedding").alias("weighed"))


@query("""WITH s AS (SELECT company_id, lower(trim(external_id)) AS external_id, title, run_id, arrival_seq FROM board_snapshots)
SELECT run_id, company_id, external_id, title FROM s QUALIFY row_number() OVER (PARTITION BY run_id, company_id, external_id ORDER BY arrival_seq DESC) = 1""")
def last_seen_wins(spark, d):
    rows = table(spark, d, "board_snapshots").select("run_id", "company_id", F.lower(F.trim("external_id")).alias("external_id"), "title", "arrival_seq")
    return snapshot.last_per_key(rows, ["run_id", "company_id", "external_id"], "arrival_seq").select("run_id", "company_id", "external_id", "title")


def _last_run(spark, d) -> int:
    return table(spark, d, "ingestion_runs").where("finished_at is not null").agg(F.max("id")).head()[0]


def _merge_input(spark, d):
    """The last successful run's snapshots, as rows of the state's shape; state: the postings."""
    run = _last_run(spark, d)
    rows = table(spark, d, "board_snapshots").where(F.col("run_id") == run)
    snap = rows.select(
        "company_id", F.lower(F.trim("external_id")).alias("external_id"), "title", X.title_key(F.col("title"), F.col("location")).alias("normalized_title"), "location", "department", "url",
        F.concat(F.lit("About "), "title").alias("description"), F.lower(F.trim("content_hash")).alias("content_hash"), "posted_at", "arrival_seq",
    )
    polls = table(spark, d, "board_polls").where(F.col("run_id") == run).select("company_id", F.col("poll_error").alias("error"))
    return snap, polls


_AT = "TIMESTAMP '2026-09-05 00:00:00'"
_MERGE = """WITH run AS (SELECT max(id) AS id FROM ingestion_runs WHERE finished_at IS NOT NULL),
ok AS (SELECT company_id FROM board_polls, run WHERE run_id = run.id AND poll_error IS NULL),
snap AS (SELECT company_id, lower(trim(external_id)) AS external_id, title, location, department, url, lower(trim(content_hash)) AS content_hash, posted_at FROM board_snapshots s, run WHERE s.run_id = run.id AND company_id IN (SELECT company_id FROM ok)
  QUALIFY row_number() OVER (PARTITION BY company_id, lower(trim(external_id)) ORDER BY arrival_seq DESC) = 1),
merged AS (SELECT coalesce(p.company_id, s.company_id) AS company_id, coalesce(p.external_id, s.external_id) AS external_id, p.id, s.company_id IS NOT NULL AS there, p.closed_at, p.canonical_id, p.first_seen_at, p.embedding, p.embedding_hash,
  CASE WHEN s.company_id IS NOT NULL THEN s.location ELSE p.location END AS location, CASE WHEN s.company_id IS NOT NULL THEN s.department ELSE p.department END AS department,
  CASE WHEN s.company_id IS NOT NULL THEN s.url ELSE p.url END AS url, CASE WHEN s.company_id IS NOT NULL THEN s.content_hash ELSE p.content_hash END AS content_hash,
  CASE WHEN s.company_id IS NOT NULL THEN 'About ' || s.title ELSE p.description END AS description,
  CASE WHEN s.company_id IS NOT NULL THEN s.title ELSE p.title END AS title, CASE WHEN s.company_id IS NOT NULL THEN coalesce(p.posted_at, s.posted_at) ELSE p.posted_at END AS posted_at, p.last_seen_at
  FROM job_postings p FULL JOIN snap s ON s.company_id = p.company_id AND s.external_id = p.external_id),
told AS (SELECT *, CASE WHEN there AND id IS NULL THEN 'created' WHEN there AND closed_at IS NOT NULL THEN 'reopened' WHEN there THEN 'seen'
  WHEN closed_at IS NULL AND company_id IN (SELECT company_id FROM ok) THEN 'closed' END AS change FROM merged)
"""


@query(
    _MERGE
    + f"""SELECT CASE WHEN id IS NULL THEN (SELECT max(id) FROM job_postings) + row_number() OVER (PARTITION BY id IS NULL ORDER BY company_id, external_id) ELSE id END AS id, company_id, external_id, title, posted_at AT TIME ZONE 'UTC' AS posted_at,
CASE WHEN there THEN {_AT} ELSE last_seen_at AT TIME ZONE 'UTC' END AS last_seen_at, CASE WHEN there THEN NULL WHEN change = 'closed' THEN {_AT} ELSE closed_at AT TIME ZONE 'UTC' END AS closed_at,
CASE WHEN change = 'closed' THEN NULL ELSE canonical_id END AS canonical_id, change, location, department, url, content_hash, description, embedding_hash,
CASE WHEN embedding IS NOT NULL THEN {_WEIGHED.format(v="embedding")} END AS weighed, coalesce(first_seen_at AT TIME ZONE 'UTC', {_AT}) AS first_seen_at FROM told"""
)
def snapshot_merge(spark, d):
    snap, polls = _merge_input(spark, d)
    at = F.lit("2026-09-05 00:00:00 UTC").cast("timestamp")
    merged = snapshot.merge(table(spark, d, "job_postings"), snapshot.last_per_key(snap, snapshot.KEY, "arrival_seq"), polls.where("error is null"), at)
    return merged.select("id", "company_id", "external_id", "title", "posted_at", "last_seen_at", "closed_at", "canonical_id", "change", "location", "department", "url", "content_hash", "description", "embedding_hash", _weighed("embedding").alias("weighed"), "first_seen_at")


@query(
    _MERGE
    + """SELECT CAST((SELECT count(*) FROM ok) AS INT) AS companies_polled, CAST((SELECT count(*) FROM board_polls b, run WHERE b.run_id = run.id AND poll_error IS NOT NULL) AS INT) AS companies_failed,
CAST((SELECT count(*) FROM board_snapshots s, run WHERE s.run_id = run.id AND s.company_id IN (SELECT company_id FROM ok)) AS INT) AS postings_seen,
CAST(count(*) FILTER (WHERE change = 'created') AS INT) AS postings_new, CAST(count(*) FILTER (WHERE change = 'closed') AS INT) AS postings_closed FROM told"""
)
def run_counters(spark, d):
    snap, polls = _merge_input(spark, d)
    at = F.lit("2026-09-05 00:00:00 UTC").cast("timestamp")
    merged = snapshot.merge(table(spark, d, "job_postings"), snapshot.last_per_key(snap, snapshot.KEY, "arrival_seq"), polls.where("error is null"), at)
    return snapshot.poll_counters(merged, snap, polls)


@query(f"""WITH run AS (SELECT max(id) AS id FROM ingestion_runs WHERE finished_at IS NOT NULL)
SELECT c.id, c.name, CASE WHEN b.company_id IS NOT NULL THEN {_AT} ELSE c.last_polled_at AT TIME ZONE 'UTC' END AS last_polled_at, CASE WHEN b.company_id IS NOT NULL THEN b.poll_error ELSE c.last_poll_error END AS last_poll_error
FROM companies c LEFT JOIN (SELECT b.* FROM board_polls b, run WHERE b.run_id = run.id) b ON b.company_id = c.id""")
def recorded_polls(spark, d):
    _, polls = _merge_input(spark, d)
    return snapshot.record_polls(table(spark, d, "companies"), polls, F.lit("2026-09-05 00:00:00 UTC").cast("timestamp")).select("id", "name", "last_polled_at", "last_poll_error")


@query("""SELECT id, CASE WHEN board_token = (SELECT min(board_token) FROM companies) THEN 'Renamed' ELSE name END AS name, source, board_token, CASE WHEN board_token = (SELECT min(board_token) FROM companies) THEN TRUE ELSE enabled END AS enabled FROM companies
UNION ALL SELECT (SELECT max(id) FROM companies) + 1, 'New', 'LEVER', 'zz-new-board', TRUE""")
def added_companies(spark, d):
    c = table(spark, d, "companies")
    first = c.agg(F.min("board_token").alias("board_token"))
    known = c.join(first, "board_token").select(F.lit("Renamed").alias("name"), "source", F.concat(F.lit(" "), "board_token", F.lit("\t")).alias("board_token"))
    new = spark.createDataFrame([("New", "LEVER", "zz-new-board")], "name string, source string, board_token string")
    return snapshot.add_companies(c, known.unionByName(new)).select("id", "name", "source", "board_token", "enabled")


@query("""WITH v AS (SELECT id, content_hash, CAST([id, 1] AS FLOAT[]) AS e FROM job_postings WHERE canonical_id IS NOT NULL)
SELECT p.id, CASE WHEN coalesce(v.e, p.embedding) IS NOT NULL THEN """ + _WEIGHED.format(v="coalesce(v.e, p.embedding)") + """ END AS weighed, CASE WHEN v.id IS NOT NULL THEN v.content_hash ELSE p.embedding_hash END AS embedding_hash FROM job_postings p LEFT JOIN v USING (id)""")
def saved_embeddings(spark, d):
    p = table(spark, d, "job_postings")
    v = p.where(F.col("canonical_id").isNotNull()).select("id", F.array(F.col("id").cast("float"), F.lit(1).cast("float")).alias("embedding"), F.col("content_hash").alias("embedding_hash"))
    return snapshot.save_embeddings(p, v).select("id", _weighed("embedding").alias("weighed"), "embedding_hash")
