"""Gathering of passages on a topic over several queries, and the texts built from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.operators import bm25
from lucerna.operators.retrieval import top_per_group, within_budget


def expansions(topic: str, extra: list[str] | None = None) -> list[str]:
    """The queries of a topic: itself and the given ones, or itself and two set expansions; each once in any case."""
    t = topic.strip()
    queries = [t, *(extra or [f"{t} methodology", f"{t} results observational implications"])] if t else []
    return list({q.strip().lower(): q.strip() for q in reversed(queries) if q.strip()}.values())[::-1]


def gather(chunks: DataFrame, queries: list[str], per_query: int = 12) -> DataFrame:
    """``id, distance, query_no, matched_query, dropped``: the best passages of each query, each in its first query.

    ``distance`` is the BM25 rank value (lower is better); ``dropped`` counts the later hits of the passage.
    """
    lists = []
    for k, q in enumerate(queries):
        hits = bm25.search(chunks, "id", F.col("text"), bm25.query_terms(q), False).select("id", F.round("bm25", 6).alias("distance"))
        lists.append(hits.orderBy("distance", "id").limit(per_query).select("*", F.lit(k).alias("query_no"), F.lit(q).alias("matched_query")))
    union = reduce(DataFrame.unionByName, lists)
    return top_per_group(union.withColumn("dropped", F.count("*").over(Window.partitionBy("id")) - 1), ["id"], [F.col("query_no")])


def with_metadata(hits: DataFrame, chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """Hits with their passage and the title and identifiers of their paper, in one join each."""
    c = chunks.select("id", "paper_id", "chunk_ord", "text")
    p = papers.select(F.col("id").alias("paper_id"), "title", "bibcode", "arxiv_id")
    return hits.join(c, "id").join(p, "paper_id", "left")


def _line(c: Column, most: int) -> Column:
    return F.substring(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), 1, most)


def numbered(df: DataFrame) -> DataFrame:
    """Adds ``no`` = 1, 2, …: by distance (missing ones last), then query and id. The rows are the few of a gathering."""
    return df.withColumn("no", F.row_number().over(Window.orderBy(F.coalesce("distance", F.lit(9e9)), "query_no", "id")))


def dossier(hits: DataFrame, most: int = 48_000) -> DataFrame:
    """``no, id, block``: one block of text for each passage that fits the budget; the first always does."""
    value = F.when(F.col("distance").isNull(), "n/a").otherwise(F.format_string("%.4f", "distance"))
    head = F.format_string("### Source %d (paper_id=%d, bibcode=%s, chunk_id=%d, distance=%s)\n", "no", "paper_id", F.coalesce("bibcode", F.lit("")), "id", value)
    block = F.concat(head, F.lit("Title: "), _line(F.col("title"), 120), F.lit("\nMatched query: "), F.col("matched_query"), F.lit("\n\n"), F.trim("text"), F.lit("\n"))
    rows = numbered(hits).withColumn("block", block).withColumn("one", F.lit(1))
    return within_budget(rows, ["one"], [F.col("no")], F.length("block"), most).select("no", "id", "block")


def report(hits: DataFrame, edges: DataFrame, most: int = 56_000, refs: int = 30, shown: int = 40) -> DataFrame:
    """``tag, paper_id, id, bibcode, arxiv_id, title, block``: the passages of a report with the references of their papers (``R1``, ``R2``, …).

    ``edges`` are resolved edges (``from_paper_id, ref_bibcode, title, has_local_pdf``); only those of the
    papers at hand are gathered, ``refs`` a paper.
    """
    mine = edges.select(F.col("from_paper_id").alias("paper_id"), "ref_bibcode", F.col("title").alias("rt"), "has_local_pdf").join(hits.select("paper_id").distinct(), "paper_id", "left_semi")
    kept = mine.withColumn("r", F.row_number().over(Window.partitionBy("paper_id").orderBy("ref_bibcode"))).where(F.col("r") <= min(refs, shown))
    line = F.concat(F.lit("  - R"), F.col("r"), F.lit(": "), F.col("ref_bibcode"), F.when(F.col("has_local_pdf"), " [in library]").otherwise(""), F.lit(" — "), _line(F.trim("rt"), 120))
    lists = kept.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("t")))), lambda x: x.t), "\n").alias("listed"))
    dash = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("—"))
    value = F.when(F.col("distance").isNull(), "n/a").otherwise(F.format_string("%.4f", "distance"))
    rows = numbered(hits.join(lists, "paper_id", "left")).withColumn("tag", F.concat(F.lit("S"), F.col("no")))
    block = F.concat(
        F.lit("### "), "tag", F.lit(" — retrieved excerpt\n- **paper_id**: "), "paper_id", F.lit("\n- **bibcode**: "), dash("bibcode"), F.lit("\n- **arxiv_id**: "), dash("arxiv_id"),
        F.lit("\n- **title**: "), _line(F.col("title"), 200), F.lit("\n- **retrieval distance**: "), value, F.lit("\n- **matched_query**: "), "matched_query",
        F.lit("\n\n**Excerpt:**\n"), F.trim("text"), F.lit("\n\n**References from this paper**:\n"), F.coalesce("listed", F.lit("  (no references of this paper in the library)")), F.lit("\n"))
    rows = rows.withColumn("block", block).withColumn("one", F.lit(1))
    return within_budget(rows, ["one"], [F.col("no")], F.length("block"), most).select("tag", "paper_id", "id", "bibcode", "arxiv_id", _line(F.col("title"), 200).alias("title"), "block")


def per_paper_context(chunks: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """``paper_id, id, pos``: for each paper the ``k`` best of ``hits`` (``paper_id, id, distance``), filled up with its first chunks."""
    first = hits.select("paper_id", "id", F.lit(0).alias("kind"), F.col("distance").alias("o1"), F.lit(0).alias("o2"))
    fill = chunks.join(hits.select("id"), "id", "left_anti").select("paper_id", "id", F.lit(1).alias("kind"), F.lit(0.0).alias("o1"), F.col("chunk_ord").alias("o2"))
    w = Window.partitionBy("paper_id").orderBy("kind", "o1", "o2", "id")
    return first.unionByName(fill).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select("paper_id", "id", "pos")


def context_text(picks: DataFrame, chunks: DataFrame, most: int = 24_000, most_chunks: int = 16) -> DataFrame:
    """``by, context``: the passages of each query in order, each behind ``[chunk_id=N]``, as far as the budget goes; empty ones are left out."""
    rows = picks.join(chunks.select("id", "text"), "id").where((F.trim("text") != "") & (F.col("pick") <= most_chunks)).withColumn("part", F.concat(F.lit("[chunk_id="), "id", F.lit("]\n"), F.trim("text")))
    kept = within_budget(rows, ["by"], [F.col("pick")], F.length("part"), most, 2)
    return kept.groupBy("by").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pick", "part"))), lambda x: x.part), "\n\n").alias("context"))
