"""Queries of the text and vector operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import encoding, leakage, markup, mojibake, near_duplicates, nearest, repeated_lines, survivors
from postmill.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.found(table(spark, sf_dir, "job_postings"), "id", "embedding", k=5, dim=64)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = repeated_lines.repeated_lines(table(spark, sf_dir, "job_postings"), "id", "company_id", "normalized_title", "description", min_documents=3)
    return lines.selectExpr("cast(doc as long) posting_id", "cast(line_no as long) line_no")


P3_SQL = r"""
WITH lines AS (SELECT id, company_id, coalesce(normalized_title, '') AS title, unnest(string_split(description, chr(10))) AS line,
    unnest(range(1, len(string_split(description, chr(10))) + 1)) AS line_no FROM job_postings),
keyed AS (SELECT id, company_id, title, line_no, regexp_replace(lower(line), '[^\p{L}\p{N}]+', '', 'g') AS k FROM lines),
often AS (SELECT company_id, k FROM keyed WHERE k <> '' GROUP BY company_id, k HAVING count(DISTINCT title) >= 3)
SELECT DISTINCT CAST(id AS BIGINT) AS posting_id, CAST(line_no AS BIGINT) AS line_no FROM keyed JOIN often USING (company_id, k)
"""

def p3_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every description without the repeated lines."""
    postings = table(spark, sf_dir, "job_postings")
    lines = repeated_lines.repeated_lines(postings, "id", "company_id", "normalized_title", "description", min_documents=3)
    return repeated_lines.stripped(postings, "id", "description", lines)


P3_STRIPPED_SQL = P3_SQL.replace("SELECT DISTINCT CAST(id", ", gone AS (SELECT DISTINCT CAST(id") + """),
kept AS (SELECT l.id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS description FROM lines l LEFT JOIN gone g ON g.posting_id = l.id AND g.line_no = l.line_no WHERE g.posting_id IS NULL GROUP BY l.id)
SELECT p.id, coalesce(k.description, '') AS description FROM job_postings p LEFT JOIN kept k USING (id)"""


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.pairs(table(spark, sf_dir, "job_postings"), "id", "normalized_title", "description", threshold=0.7, shingle=4)


P4_SQL = r"""
WITH words AS (SELECT id, normalized_title AS t, list_filter(regexp_split_to_array(lower(description), '[^\p{L}\p{N}+#]+'), lambda x: x <> '') AS w FROM job_postings WHERE normalized_title IS NOT NULL),
sets AS (SELECT id, t, list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) AS s FROM words WHERE len(w) >= 4)
SELECT id_a, id_b FROM (SELECT a.id AS id_a, b.id AS id_b, len(a.s) AS m, len(b.s) AS n, len(list_intersect(a.s, b.s)) AS k
FROM sets a JOIN sets b ON a.t = b.t AND a.id < b.id AND 10 * least(len(a.s), len(b.s)) >= 7 * greatest(len(a.s), len(b.s)))
WHERE 10 * k >= 7 * (m + n - k)
"""


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting with near-duplicates: its group and the number of its near-duplicates."""
    return near_duplicates.groups(table(spark, sf_dir, "job_postings"), "id", "normalized_title", "description", threshold=0.7, shingle=4)


P4_GROUPS_SQL = P4_SQL.replace("WITH words", "WITH RECURSIVE words").replace("SELECT id_a, id_b FROM (", ", near AS (SELECT id_a, id_b FROM (") + """),
e AS (SELECT id_a AS x, id_b AS y FROM near UNION SELECT id_b, id_a FROM near),
reach(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y)
SELECT x AS id, least(x, min(y)) AS group_id, (SELECT count(*) FROM e WHERE e.x = reach.x) AS links FROM reach GROUP BY x"""


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.surviving_values(table(spark, sf_dir, "job_postings"), table(spark, sf_dir, "ingestion_runs"))


def p7_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location and department by truth discovery with the companies as sources."""
    return survivors.discovered_values(table(spark, sf_dir, "job_postings"), table(spark, sf_dir, "ingestion_runs"))


P7_SQL = r"""
WITH RECURSIVE edges AS (SELECT id AS x, canonical_id AS y FROM job_postings WHERE canonical_id IS NOT NULL AND canonical_id <> id
  UNION SELECT canonical_id, id FROM job_postings WHERE canonical_id IS NOT NULL AND canonical_id <> id),
reach(x, y) AS (SELECT x, x FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
present AS (SELECT r.x, r.y FROM reach r JOIN (SELECT DISTINCT id FROM job_postings) p ON p.id = r.y JOIN (SELECT DISTINCT id FROM job_postings) q ON q.id = r.x),
groups AS (SELECT x AS id, min(y) AS group_id FROM present GROUP BY x HAVING count(DISTINCT y) > 1),
m AS (SELECT g.group_id, p.id, length(regexp_replace(p.description, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS len,
  CASE WHEN upper(regexp_replace(p.location, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) NOT IN ('', 'N/A', '-', 'TBD') THEN p.location END AS location,
  CASE WHEN upper(regexp_replace(p.department, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) NOT IN ('', 'N/A', '-', 'TBD') THEN p.department END AS department,
  CASE WHEN p.posted_at >= TIMESTAMPTZ '2015-01-01 00:00:00+00' AND p.posted_at <= (SELECT arg_max(started_at, id) FROM ingestion_runs) THEN p.posted_at END AS posted
  FROM groups g JOIN job_postings p USING (id))
SELECT group_id, field_name, id AS posting_id FROM (
  SELECT group_id, 'description' AS field_name, id, row_number() OVER (PARTITION BY group_id ORDER BY len DESC, id) AS n FROM m WHERE len > 0
  UNION ALL SELECT group_id, 'location', id, row_number() OVER (PARTITION BY group_id ORDER BY posted DESC NULLS LAST, id) FROM m WHERE location IS NOT NULL
  UNION ALL SELECT group_id, 'department', id, row_number() OVER (PARTITION BY group_id ORDER BY posted DESC NULLS LAST, id) FROM m WHERE department IS NOT NULL
  UNION ALL SELECT group_id, 'posted_at', id, row_number() OVER (PARTITION BY group_id ORDER BY posted, id) FROM m WHERE posted IS NOT NULL) WHERE n = 1
"""

def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ids = encoding.encoded(table(spark, sf_dir, "documents"), "doc_id", "text", str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return ids.select(F.col("id").alias("doc_id"), "ids")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", window=12, budget=0)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p9_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 12 words with up to one word edited."""
    found = leakage.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", window=12, budget=1)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


P9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) AS g FROM d WHERE len(w) >= 12),
ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k+11], ' '))) AS g FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""

# a window with one word left out, exchanged or put in, as strings of 11 words, or of 12 or 13 with a blank inside
P9_EDITED_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM eval_items WHERE text IS NOT NULL),
iw AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: w[k:k+11])) AS g FROM i WHERE len(w) >= 12),
ig AS (SELECT DISTINCT item_id, unnest(list_concat(list_concat(
    list_transform(range(1, 13), lambda j: array_to_string(list_concat(g[1:j-1], g[j+1:12]), ' ')),
    list_transform(range(2, 12), lambda j: array_to_string(list_concat(list_append(g[1:j-1], '_'), g[j+1:12]), ' '))),
    list_transform(range(1, 12), lambda j: array_to_string(list_concat(list_append(g[1:j], '_'), g[j+1:12]), ' ')))) AS g FROM iw),
dw AS (SELECT doc_id, w, unnest(range(1, len(w) - 9)) AS k FROM d WHERE len(w) >= 11),
dg AS (SELECT doc_id, unnest(list_concat(list_concat([array_to_string(w[k:k+10], ' ')],
    CASE WHEN k + 11 <= len(w) THEN list_transform(range(1, 11), lambda j: array_to_string(list_concat(list_append(w[k:k+j-1], '_'), w[k+j+1:k+11]), ' ')) ELSE [] END),
    CASE WHEN k + 12 <= len(w) THEN list_transform(range(1, 12), lambda j: array_to_string(list_concat(list_append(w[k:k+j-1], '_'), w[k+j+1:k+12]), ' ')) ELSE [] END)) AS g FROM dw)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mojibake.restored(table(spark, sf_dir, "documents"), "doc_id", "text").distinct()
    return found.select(F.col("id").alias("doc_id"), F.coalesce(F.md5(F.encode("restored", "UTF-8")), F.lit("")).alias("restored_md5"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.found(table(spark, sf_dir, "greenhouse"), "id", "content")


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text of every job's content."""
    return markup.clean_text(table(spark, sf_dir, "greenhouse"), "id", "content")


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_stripped": p3_stripped, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_text": p5_text, "p7_found": p7_found, "p7_truth": p7_truth, "p8_ids": p8_ids, "p9_found": p9_found, "p9_edited": p9_edited, "p10_found": p10_found}
SQL = {"p3_found": P3_SQL, "p3_stripped": P3_STRIPPED_SQL, "p4_found": P4_SQL, "p4_groups": P4_GROUPS_SQL, "p7_found": P7_SQL, "p9_found": P9_SQL, "p9_edited": P9_EDITED_SQL}
