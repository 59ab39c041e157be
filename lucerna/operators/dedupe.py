"""Merging of duplicate papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions.text import nonblank
from lucerna.operators.components import connected_components, key_edges


def duplicate_clusters(papers: DataFrame) -> DataFrame:
    """``id, cluster`` of papers linked by bibcode (capitals), arXiv id (without version) or pdf path (small letters); plain blanks link nothing."""
    from lucerna.functions.identifiers import strip_arxiv_version

    keys = F.array(
        F.when(nonblank(F.col("bibcode")), F.concat(F.lit("b"), F.upper(F.trim("bibcode")))),
        F.when(nonblank(F.col("arxiv_id")), F.concat(F.lit("a"), F.lower(strip_arxiv_version(F.col("arxiv_id"))))),
        F.when(nonblank(F.col("pdf_relpath")), F.concat(F.lit("p"), F.lower(F.regexp_replace(F.trim("pdf_relpath"), r"\\", "/")))),
    )
    rows = papers.select(F.col("id").alias("node"), F.explode(keys).alias("key"))
    return connected_components(key_edges(rows)).toDF("id", "cluster")


def merge_plan(papers: DataFrame, chunks: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """``cluster, keep_id``: the paper with chunks, then a pdf, then a bibcode, then the smallest id."""
    have = chunks.groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("chunks"))
    rows = (clusters if clusters is not None else duplicate_clusters(papers)).join(papers.select("id", nonblank(F.col("pdf_relpath")).alias("pdf"), nonblank(F.col("bibcode")).alias("bib")), "id").join(have, "id", "left")
    rank = F.struct((F.coalesce("chunks", F.lit(0)) > 0).alias("c"), F.coalesce("pdf", F.lit(False)).alias("p"), F.coalesce("bib", F.lit(False)).alias("b"), (-F.col("id")).alias("i"))
    return rows.groupBy("cluster").agg(F.max_by("id", rank).alias("keep_id"))


FILL = ("arxiv_id", "bibcode", "title", "abstract", "published", "source", "pdf_relpath")


def merged_papers(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per cluster: the kept paper with its blank fields filled from the others, larger ids first."""
    clusters = duplicate_clusters(papers)
    plan = clusters.join(merge_plan(papers, chunks, clusters), "cluster")
    rows = plan.join(papers.select("id", *FILL), "id")
    order = F.struct((F.col("id") == F.col("keep_id")).alias("k"), F.col("id").alias("i"))
    return rows.groupBy("keep_id").agg(*[F.max_by(c, F.when(nonblank(F.col(c)), order)).alias(c) for c in FILL])


def merged_edges(papers: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with those of merged papers moved to the kept one, each once."""
    clusters = duplicate_clusters(papers)
    moved = clusters.join(merge_plan(papers, chunks, clusters), "cluster").select(F.col("id").alias("from_paper_id"), "keep_id")
    return edges.select("from_paper_id", "ref_bibcode").distinct().join(moved, "from_paper_id", "left").select(F.coalesce("keep_id", "from_paper_id").alias("from_paper_id"), "ref_bibcode").distinct()
