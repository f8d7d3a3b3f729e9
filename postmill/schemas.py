"""Schemas of the tables and of the board payloads."""

from pyspark.sql import types as T

_S, _L, _TS = T.StringType(), T.LongType(), T.TimestampType()


def _struct(**columns) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


COMPANIES = _struct(id=_L, name=_S, source=_S, board_token=_S, enabled=T.BooleanType(), last_polled_at=_TS, last_poll_error=_S)
NORMALIZED = _struct(external_id=_S, title=_S, location=_S, department=_S, url=_S, description=_S, posted_at=_TS)
POSTINGS = _struct(
    id=_L, company_id=_L, external_id=_S, title=_S, normalized_title=_S, location=_S, department=_S, url=_S, description=_S, content_hash=_S,
    posted_at=_TS, first_seen_at=_TS, last_seen_at=_TS, closed_at=_TS, canonical_id=_L, embedding=T.ArrayType(T.FloatType()), embedding_hash=_S,
)
COUNTERS = ("companies_polled", "companies_failed", "postings_seen", "postings_new", "postings_closed", "duplicates_found", "postings_embedded")
RUNS = T.StructType([*_struct(id=_L, started_at=_TS, finished_at=_TS).fields, *(T.StructField(c, T.IntegerType()) for c in COUNTERS)])
SOURCES = ("GREENHOUSE", "LEVER")

_NAMED = _struct(name=_S)
GREENHOUSE_JOB = _struct(id=_L, title=_S, absolute_url=_S, updated_at=_S, first_published=_S, location=_NAMED, departments=T.ArrayType(_NAMED), content=_S)
GREENHOUSE_BOARD = _struct(jobs=T.ArrayType(GREENHOUSE_JOB))
LEVER_POSTING = _struct(
    id=_S, text=_S, hostedUrl=_S, createdAt=_L, categories=_struct(location=_S, team=_S, department=_S, commitment=_S),
    descriptionPlain=_S, lists=T.ArrayType(_struct(text=_S, content=_S)), additionalPlain=_S,
)
