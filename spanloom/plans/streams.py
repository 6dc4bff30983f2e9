"""Queries on streams, each compared with the same result over the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import norm_sql
from ..registry import QUERIES, query
from ..sources.tables import table
from ..streaming import ops


def _stream(spark, sf_dir: str, name: str, files: int | None = None):
    """The parquet file or folder of a table as a stream."""
    one = table(spark, sf_dir, name)
    where = f"{sf_dir}/{{{name}.parquet,{name}.parquet/*.parquet}}"
    return ops.scan(spark, where, one.schema, files)


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS begins, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_windows(t):
    return ops.windowed_counts(t("events"), "1 day", "1 day", "event_type").withColumn("value", F.round("value", 4))


@query("""WITH d AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '4 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM d)
SELECT min(ts) AS begins, max(ts) + INTERVAL '4 hours' AS ends, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(t):
    return ops.session_counts(t("events"), "4 hours", "1 day", "user_id")


def stream_scan(spark, sf_dir: str):
    """Resumable scan of all documents with their normal form's digest."""
    s = _stream(spark, sf_dir, "documents", 4).where("text is not null")
    return ops.collect_once(s.select("doc_id", F.sha2(norm_sql(F.col("text")), 256).alias("key")), "scan")


def stream_ledger(spark, sf_dir: str):
    """Distinct texts, each admitted once to an append-only ledger."""
    ledger, check = ops.folder(spark, "ledger"), ops.folder(spark, "ledger-checkpoint")
    s = _stream(spark, sf_dir, "documents", 4).where("text is not null").select(F.sha2(norm_sql(F.col("text")), 256).alias("key"))
    ops.drain(s, ops.ledger_append(ledger, "key"), check)
    return spark.read.option("basePath", ledger).parquet(ledger).select("key")


def stream_quota(spark, sf_dir: str):
    """The first 20 documents of each language."""
    s = _stream(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "lang")
    return ops.collect_once(ops.quota(s, "lang", 20, "doc_id"), "quota")


def stream_event_counts(spark, sf_dir: str):
    """Event counts per day from the stream, with a watermark for late rows; the last open windows are not out yet."""
    return ops.collect_once(ops.windowed_counts(_stream(spark, sf_dir, "events"), "1 day", "1 hour", "event_type"), "events")


QUERIES |= {f.__name__: f for f in (stream_scan, stream_ledger, stream_quota, stream_event_counts)}
_NORM = r"trim(regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g'))"
STREAM_ORACLE = {
    "stream_scan": f"SELECT doc_id, sha256({_NORM}) AS key FROM documents WHERE text IS NOT NULL",
    "stream_ledger": f"SELECT DISTINCT sha256({_NORM}) AS key FROM documents WHERE text IS NOT NULL",
    "stream_quota": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE lang IS NOT NULL) WHERE r <= 20",
}

from ..registry import ORACLE  # noqa: E402

ORACLE |= STREAM_ORACLE
