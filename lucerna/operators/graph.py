"""Citation graph: edges, hubs, traversal and renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions.text import nonblank
from lucerna.operators.retrieval import top_per_group
from lucerna.runtime import cut


def library_nodes(papers: DataFrame) -> DataFrame:
    """One row per bibcode of the library: the latest paper (largest id) that carries it."""
    p = papers.where(nonblank(F.col("bibcode"))).select(F.trim("bibcode").alias("key"), "id", "title", nonblank(F.col("pdf_relpath")).alias("has_local_pdf"))
    return p.groupBy("key").agg(F.max_by(F.struct("id", "title", "has_local_pdf"), "id").alias("p")).select("key", F.col("p.id").alias("to_paper_id"), "p.title", "p.has_local_pdf")


def resolve_edges(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """``from_paper_id, ref_bibcode, to_paper_id, title, has_local_pdf, in_library`` of all distinct edges."""
    e = edges.where(nonblank(F.col("ref_bibcode"))).select("from_paper_id", F.trim("ref_bibcode").alias("ref_bibcode")).distinct()
    nodes = library_nodes(papers)
    return e.join(nodes, e.ref_bibcode == nodes.key, "left").select("from_paper_id", "ref_bibcode", "to_paper_id", "title", F.coalesce("has_local_pdf", F.lit(False)).alias("has_local_pdf"), F.col("to_paper_id").isNotNull().alias("in_library"))


def missing_hubs(edges: DataFrame, papers: DataFrame, least: int = 2) -> DataFrame:
    """``ref_bibcode, n`` of works outside the library that ``least`` papers or more cite."""
    e = edges.where(nonblank(F.col("ref_bibcode"))).select("from_paper_id", F.trim("ref_bibcode").alias("ref_bibcode")).distinct()
    have = papers.where(nonblank(F.col("bibcode"))).select(F.trim("bibcode").alias("ref_bibcode")).distinct()
    counts = e.groupBy("ref_bibcode").agg(F.count("*").alias("n"))  # combined before the shuffle, so a hub is a few rows
    return counts.where(F.col("n") >= least).join(have, "ref_bibcode", "left_anti")


def hub_citers(edges: DataFrame, hubs: DataFrame, most: int = 8) -> DataFrame:
    """The first ``most`` citing papers of each hub."""
    e = edges.select("from_paper_id", F.trim("ref_bibcode").alias("ref_bibcode")).distinct().join(hubs.select("ref_bibcode"), "ref_bibcode", "left_semi")
    return top_per_group(e, ["ref_bibcode"], [F.col("from_paper_id")], most).groupBy("ref_bibcode").agg(F.array_sort(F.collect_list("from_paper_id")).alias("papers"))


def graph_nodes(edges: DataFrame, papers: DataFrame, least: int = 2) -> DataFrame:
    """Papers and ghost hubs as ``node, kind, label, citing``."""
    hubs = missing_hubs(edges, papers, least)
    label = F.coalesce(F.nullif(F.trim("bibcode"), F.lit("")), F.nullif(F.trim("arxiv_id"), F.lit("")), F.concat(F.lit("paper "), F.col("id")))
    return papers.select(F.concat(F.lit("p"), F.col("id")).alias("node"), F.lit("paper").alias("kind"), label.alias("label"), F.lit(None).cast("long").alias("citing")).unionByName(
        hubs.select(F.concat(F.lit("h:"), F.col("ref_bibcode")).alias("node"), F.lit("hub").alias("kind"), F.col("ref_bibcode").alias("label"), F.col("n").alias("citing")))


def graph_stats(edges: DataFrame, papers: DataFrame, least: int = 2) -> DataFrame:
    r = resolve_edges(edges, papers).agg(F.count("*").alias("edges"), F.count_if("in_library").alias("internal_edges"))
    return papers.agg(F.count("*").alias("papers")).crossJoin(r).crossJoin(missing_hubs(edges, papers, least).agg(F.count("*").alias("hubs")))


def reach(edges: DataFrame, papers: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """``seed, paper_id, depth``: papers of the library reached from each seed, breadth first, each once.

    One job a hop: frontier ⋈ edges, less what was visited; state is cut to the checkpoint folder so the plan
    does not grow with depth.
    """
    inner = cut(resolve_edges(edges, papers).where("in_library").select(F.col("from_paper_id").alias("u"), F.col("to_paper_id").alias("v")).distinct())
    seen = cut(seeds.select("seed", F.col("seed").alias("paper_id"), F.lit(0).alias("depth")))
    front = seen
    for hop in range(1, max_hops + 1):
        step = front.select("seed", F.col("paper_id").alias("u")).join(inner, "u").select("seed", F.col("v").alias("paper_id")).distinct()
        front = cut(step.join(seen.select("seed", "paper_id"), ["seed", "paper_id"], "left_anti").withColumn("depth", F.lit(hop)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def visit_key(bibcode: Column, arxiv: Column, doi: Column, line: Column) -> Column:
    """Key under which a reference counts as visited: bibcode, else arXiv id, else DOI, else a hash of its text."""
    v = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(F.concat(F.lit("bib:"), v(bibcode)), F.concat(F.lit("arxiv:"), F.lower(v(arxiv))), F.concat(F.lit("doi:"), F.lower(v(doi))), F.concat(F.lit("line:"), F.substring(F.sha2(F.coalesce(line, F.lit("")), 256), 1, 20)))


def mindmap(hubs_with_papers: DataFrame, most_hubs: int = 12) -> DataFrame:
    """Mind map text of the most cited hubs with their papers, as one row."""
    safe = F.regexp_replace("ref_bibcode", r"[()\[\]{}\"`]", " ")
    top = hubs_with_papers.orderBy(F.desc("n"), "ref_bibcode").limit(most_hubs)
    part = F.concat(F.lit("    "), safe, F.lit("\n"), F.array_join(F.transform("papers", lambda p: F.concat(F.lit("      p"), p)), "\n"))
    rows = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("ref_bibcode").alias("b"), part.alias("t")))).alias("x"))
    return rows.select(F.concat(F.lit("mindmap\n  root((citations))\n"), F.array_join(F.transform("x", lambda s: s.t), "\n")).alias("mindmap"))
