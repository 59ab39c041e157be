"""Incremental jobs over events and new records."""

import uuid

from pyspark.sql import functions as F

from lucerna.functions.identifiers import strip_arxiv_version
from lucerna.plans.base import query, table
from lucerna.runtime import ensure_checkpoint_dir
from lucerna.streaming import monitor


_KEYWORDS = {"globular cluster": "球状星团", "dwarf galaxy": "矮星系", "dwarf galaxies": "矮星系", "stellar stream": "星流", "near-field cosmology": "近场宇宙学", "galactic archaeology": "星系考古学", "open cluster": "疏散星团", "stellar population": "星族"}
_HITS = "[x FOR x IN [" + ", ".join(f"CASE WHEN contains(t, '{p}') THEN '{v}' END" for p, v in [*_KEYWORDS.items(), *((v, v) for v in ("球状星团", "矮星系", "星流", "近场宇宙学", "星系考古学", "疏散星团", "星族"))]) + "] IF x IS NOT NULL]"
_RECORDS = f"""t AS (SELECT lower(regexp_replace(regexp_replace(trim(arxiv_id), '(?i)^arxiv:\\s*', ''), '(?i)v[0-9]+$', '')) AS key, published, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS t, matched_keywords FROM papers WHERE arxiv_id IS NOT NULL AND trim(arxiv_id) <> ''),
r AS (SELECT key, published, list_concat({_HITS}, [lower(x) FOR x IN matched_keywords]) AS labels FROM t WHERE published >= '2005-01-01')"""


def _records(x):
    """Monitor records of papers: key, date and labels, from the cutoff on; works on batches and streams."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    rows = x.where("arxiv_id is not null and trim(arxiv_id) <> ''").select(F.lower(strip_arxiv_version(F.col("arxiv_id"))).alias("key"), "published", F.concat(monitor.keyword_labels(text), F.transform("matched_keywords", lambda w: F.lower(w))).alias("labels"))
    return rows.where((F.col("published") >= "2005-01-01") & (F.size("labels") > 0))


@query("x1_monitor", f"WITH {_RECORDS} SELECT DISTINCT key FROM r WHERE len(labels) > 0")
def _(s, d):
    path = f"{d}/papers.parquet"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.read.parquet(path).schema)
    build = lambda x: _records(x).select("key", F.to_timestamp("published").alias("at"))
    return monitor.run_available(s, path, schema, build, "3650 days", "at", "key", f"{ensure_checkpoint_dir(s)}/monitor-{uuid.uuid4().hex}").select("key")


@query("x2_merge_by_id", f"""WITH {_RECORDS}, u AS (SELECT key, published, unnest(labels) AS l FROM r WHERE len(labels) > 0)
SELECT key, max(published) AS published, string_agg(DISTINCT l, ',' ORDER BY l) AS labels FROM u GROUP BY key""")
def _(s, d):
    return monitor.merge_by_id(_records(table(s, d, "papers")), "key", "published").select("key", "published", F.array_join("labels", ",").alias("labels"))


@query("x3_not_late", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY")
def _(s, d):
    e = table(s, d, "events")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("last")))).where(F.col("ts") >= F.col("last") - F.expr("interval 30 days")).select("event_id")


@query("x5_sink_state", f"WITH {_RECORDS} SELECT key, max(published) AS published FROM r WHERE len(labels) > 0 GROUP BY key")
def _(s, d):
    """The monitor into a sink that keeps the newest row of a key: every batch is added under its number, then read as one state."""
    path, base = f"{d}/papers.parquet", f"{ensure_checkpoint_dir(s)}/sink-{uuid.uuid4().hex}"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.read.parquet(path).schema)
    stream = _records(monitor.stream_of(s, path, schema)).select("key", "published")
    write = lambda batch, n: batch.groupBy("key").agg(F.max("published").alias("published")).write.mode("overwrite").parquet(f"{base}/state/batch={n}")
    monitor.upsert_batches(stream, write, f"{base}/log").awaitTermination()
    return s.read.parquet(f"{base}/state").groupBy("key").agg(F.max("published").alias("published"))


@query("x4_newest", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 500")
def _(s, d):
    return monitor.newest(table(s, d, "events"), "ts", "event_id", 500).select("event_id")


@query("x6_only_missing", "SELECT id FROM papers WHERE id NOT IN (SELECT paper_id FROM paper_chunks)")
def _(s, d):
    return table(s, d, "papers").select("id").join(table(s, d, "paper_chunks").select(F.col("paper_id").alias("id")), "id", "left_anti")
