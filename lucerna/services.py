"""The library's operations by name, as functions of a catalogue that return frames, and a small command line over them."""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.functions import references
from lucerna.functions.documents import document_identifiers
from lucerna.functions.text import nonblank
from lucerna.operators import bm25, dedupe, graph, resolve, topics
from lucerna.sources import formats
from lucerna.sources.catalog import Catalog


@dataclass(frozen=True)
class Settings:
    """What a session of the library needs to know; from ``LUCERNA_*`` variables where not given."""

    base: str = ""
    backend: str = "fts"
    chunk_size: int = 1200
    chunk_overlap: int = 200

    @classmethod
    def of_environment(cls) -> Settings:
        get = lambda k, default: type(default)(os.environ.get(f"LUCERNA_{k.upper()}", default))
        s = cls(**{k: get(k, getattr(cls, k)) for k in ("base", "backend", "chunk_size", "chunk_overlap")})
        if s.backend not in ("fts", "vector"):
            raise ValueError("backend is fts or vector")
        return s


class Library:
    """Every operation takes plain values and returns a frame."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.catalog = spark, Catalog(spark, base)

    def _t(self, name: str) -> DataFrame:
        return self.catalog.table(name)

    def _lines(self, text: str) -> DataFrame:
        rows = [(k, x.strip()) for k, x in enumerate(text.split("\n")) if x.strip() and not x.strip().startswith("#")]
        return self.spark.createDataFrame(rows, "line_id long, line string")

    def library_stats(self) -> DataFrame:
        return self._t("papers").agg(F.count("*").alias("papers"), F.max("updated_at").alias("last_update"))

    def library_search(self, query: str, limit: int = 15) -> DataFrame:
        q = self.spark.createDataFrame([(0, query)], "query_id long, q string")
        return resolve.local_search(q, self._t("papers"), limit).join(self._t("papers").select("id", "title", "bibcode"), "id").drop("query_id")

    def library_semantic_search(self, query: str, limit: int = 10) -> DataFrame:
        c = self._t("paper_chunks")
        hits = bm25.search(c, "id", F.col("text"), bm25.query_terms(query), False).withColumnRenamed("bm25", "distance").orderBy("distance", "id").limit(max(1, min(limit, 100)))
        return topics.with_metadata(hits, c, self._t("papers"))

    def library_semantic_status(self) -> DataFrame:
        c = self._t("paper_chunks").agg(F.count("*").alias("chunks"), F.countDistinct("paper_id").alias("indexed"))
        return self._t("papers").agg(F.count("*").alias("papers"), F.count_if(nonblank(F.col("pdf_relpath"))).alias("with_pdf")).crossJoin(c)

    def library_get_related_papers(self, paper_id: int, limit: int = 10) -> DataFrame:
        from lucerna.plans.ranking import related_papers

        return related_papers(self._t("papers"), self._t("paper_chunks"), F.col("id") == paper_id, limit)

    def library_topic_dossier(self, topic: str, extra: list[str] | None = None) -> DataFrame:
        c = self._t("paper_chunks")
        return topics.dossier(topics.with_metadata(topics.gather(c, topics.expansions(topic, extra)), c, self._t("papers")))

    def library_semantic_report(self, question: str, expand: bool = False) -> DataFrame:
        c = self._t("paper_chunks")
        hits = topics.with_metadata(topics.gather(c, topics.expansions(question) if expand else [question.strip()]), c, self._t("papers"))
        return topics.report(hits, graph.resolve_edges(self._t("paper_references"), self._t("papers")))

    def library_compare_topic(self, topic: str, k: int = 4) -> DataFrame:
        c = self._t("paper_chunks")
        hits = bm25.search(c, "id", F.col("text"), bm25.query_terms(topic), False).withColumnRenamed("bm25", "distance").join(c.select("id", "paper_id"), "id")
        return topics.per_paper_context(c.select("id", "paper_id", "chunk_ord"), hits, k)

    def library_citation_graph(self, least: int = 2) -> DataFrame:
        return graph.graph_nodes(self._t("paper_references"), self._t("papers"), least)

    def library_citation_edges(self) -> DataFrame:
        return graph.resolve_edges(self._t("paper_references"), self._t("papers"))

    def library_dedupe(self) -> DataFrame:
        """The planned merges; nothing is changed."""
        return dedupe.merge_plan(self._t("papers"), self._t("paper_chunks"))

    def library_bib_export(self, text: str) -> DataFrame:
        lines = resolve.parse_lines(self._lines(text), self._t("papers")).where("bibcode is not null").select("line_id", F.col("bibcode").alias("b"))
        p = self._t("papers").where(nonblank(F.col("bibcode"))).groupBy(F.trim("bibcode").alias("b")).agg(F.max_by(F.struct("title", "published", "arxiv_id"), "id").alias("p"))
        entry = formats.to_bibtex(F.col("b"), F.col("p.title"), F.lit(None).cast("string"), F.substring("p.published", 1, 4), F.col("p.arxiv_id"))
        return lines.groupBy("b").agg(F.min("line_id").alias("line_id")).join(p, "b").select("line_id", "b", entry.alias("entry"))

    def lookup_ref(self, text: str) -> DataFrame:
        return resolve.parse_lines(self._lines(text), self._t("papers"))

    def references_classify(self) -> DataFrame:
        return references.reference_category(references.citation_contexts(self._t("paper_chunks"), "id", "text"), "cited", "context")

    def ads_data_products(self) -> DataFrame:
        return references.catalog_mentions(self._t("paper_chunks"), "id", "text")

    def pdf_identifiers(self, texts: DataFrame) -> DataFrame:
        return texts.select("path", document_identifiers(F.col("clean"), F.col("raw")).alias("x")).select("path", "x.*")

    def pdf_reference_chain(self, seeds: list[int], max_hops: int = 2, most_follow: int = 0) -> DataFrame:
        s = self.spark.createDataFrame([(x,) for x in seeds], "seed long")
        return resolve.chain(self._t("paper_references"), self._t("papers"), s, max_hops, most_follow)


def operations() -> dict[str, Callable]:
    """The public operations of a library by name."""
    return {k: f for k, f in vars(Library).items() if callable(f) and not k.startswith("_")}


def main(argv: list[str] | None = None) -> None:
    """``lucerna NAME [ARGUMENT]``: run an operation that takes at most one text, print its rows."""
    p = argparse.ArgumentParser(prog="lucerna")
    p.add_argument("operation", choices=sorted(operations()))
    p.add_argument("argument", nargs="*")
    p.add_argument("--base", default=Settings.of_environment().base)
    p.add_argument("--rows", type=int, default=20)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    getattr(Library(spark, a.base), a.operation)(*a.argument).show(a.rows, truncate=120)


if __name__ == "__main__":
    main()
