"""Queries of the training-data operators over the whole tables, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm import canonical, leak, linkage, names, pack, residue, scan, split, survivor

#: The tokenizer's file: the setting ``spark.lucerna.vocabulary``, a path that every executor has, else this one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
CAPACITY = 2048


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(_t(spark, d, "paper_chunks")).withColumnRenamed("item_id", "chunk_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).where("piece = 0 and n_pieces > 1").select("chunk_id")


def p2_titles(spark: SparkSession, d: str) -> DataFrame:
    return canonical.with_canonical(_t(spark, d, "papers").select(F.col("id").alias("paper_id"), "title"), "title")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.same_looking(_t(spark, d, "papers"), _t(spark, d, "candidates"), "id", "cand_id").toDF("paper_id", "cand_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.surviving_rows(_t(spark, d, "papers"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return survivor.golden_records(_t(spark, d, "papers"))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan.repair_scans(_t(spark, d, "paper_chunks"), _t(spark, d, "chunk_proofs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scan.scanned(p4_repaired(spark, d))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link_records(_t(spark, d, "parsed_references"), _t(spark, d, "candidates"), _t(spark, d, "journals"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_links(spark, d).select("ref_id", "cand_id")


def p6_authors(spark: SparkSession, d: str) -> DataFrame:
    return names.link_names(names.author_names(_t(spark, d, "papers"), _t(spark, d, "parsed_references")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(p6_authors(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = pack.token_lengths(_t(spark, d, "documents"), "doc_id", "text", spark.conf.get("spark.lucerna.vocabulary", VOCABULARY))
    return pack.fill_containers(pack.kept(sizes), CAPACITY)


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leak.find_leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("item_id", "doc_id")


def p9_residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(_t(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_residue(spark, d).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_titles, p3_found, p3_records, p4_found, p4_repaired, p5_found, p5_links, p6_found, p6_authors, p7_containers, p8_found, p8_leaks, p9_found, p9_residue)}

_ABSENT = "('', '-', '--', '?', 'n/a', 'na', 'nan', 'nil', 'none', 'null', 'tbd', 'undefined', 'unknown', 'missing', 'not available')"
SQL = {
    "p1_found": "SELECT id AS chunk_id FROM paper_chunks WHERE length(text) > 1200",
    "p3_found": rf"""
WITH RECURSIVE s AS (
  SELECT id, updated_at, trim(regexp_replace(bibcode, '\s+', ' ', 'g')) AS b, trim(regexp_replace(arxiv_id, '\s+', ' ', 'g')) AS a, trim(regexp_replace(pdf_relpath, '\s+', ' ', 'g')) AS p FROM papers),
k AS (
  SELECT id, updated_at,
    CASE WHEN lower(b) IN {_ABSENT} THEN NULL ELSE upper(replace(replace(replace(b, '&amp;', '&'), '%26', '&'), ' ', '')) END AS b,
    CASE WHEN lower(a) IN {_ABSENT} THEN NULL ELSE nullif(regexp_replace(regexp_replace(lower(replace(a, ' ', '')), '^arxiv:', ''), 'v[0-9]+$', ''), '') END AS a,
    CASE WHEN lower(p) IN {_ABSENT} THEN NULL ELSE nullif(regexp_replace(regexp_replace(regexp_replace(lower(p), '^file://|\\', '/', 'g'), '/+', '/', 'g'), '^(\./)+', ''), '') END AS p
  FROM s),
v AS (SELECT id, 'b' || b AS x FROM k WHERE b IS NOT NULL UNION SELECT id, 'a' || a FROM k WHERE a IS NOT NULL UNION SELECT id, 'p' || p FROM k WHERE p IS NOT NULL),
m AS (SELECT x, min(id) AS low FROM v GROUP BY x HAVING count(*) > 1),
e AS (SELECT v.id AS i, m.low AS j FROM v JOIN m USING (x) WHERE v.id <> m.low),
e2 AS (SELECT i, j FROM e UNION SELECT j, i FROM e),
r AS (SELECT i, i AS j FROM e2 UNION SELECT r.i, e2.j FROM r JOIN e2 ON r.j = e2.i),
g AS (SELECT i AS id, min(j) AS group_id FROM r GROUP BY i),
o AS (SELECT g.group_id, k.id, row_number() OVER (PARTITION BY g.group_id ORDER BY (b IS NOT NULL)::int + (a IS NOT NULL)::int + (p IS NOT NULL)::int DESC, updated_at DESC NULLS LAST, k.id) AS n FROM k JOIN g ON g.id = k.id)
SELECT group_id, id AS keep_id FROM o WHERE n = 1""",
}
