"""Ingest of documents and references: identify, resolve, place, upsert, index."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions.chunk import chunk_texts
from lucerna.functions.documents import document_identifiers, similarity
from lucerna.functions.identifiers import all_dois, is_eprint, safe_stem, text_hash
from lucerna.functions.text import nonblank
from lucerna.operators import mutate, vectors
from lucerna.sources import formats
from lucerna.sources.providers import Provider, lookup


def archive_files(df: DataFrame, by: str, content: str) -> DataFrame:
    """``by, path, content``: the text files of source archives (tar, gzip of a tar or of one file); a PDF gives none."""
    kind = df.schema[by].dataType.simpleString()

    def members(data: bytes) -> Iterator[tuple[str, bytes]]:
        if data[:4] == b"%PDF":
            return
        if data[:2] == b"\x1f\x8b":
            data = gzip.decompress(data)
        try:
            with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                for m in tar:
                    if m.isfile():
                        yield m.name, tar.extractfile(m).read()
        except tarfile.ReadError:
            yield "main.tex", data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, data in zip(b[by], b[content]):
                rows = [(k, name, body.decode("utf-8", "replace")) for name, body in members(bytes(data)) if not body.startswith(b"%PDF")] if data is not None else []
                yield pd.DataFrame(rows, columns=[by, "path", "content"])

    return df.select(by, content).mapInPandas(run, f"{by} {kind}, path string, content string")


def choose_match(asked: DataFrame, docs: DataFrame, least: float = 0.6) -> DataFrame:
    """``asked_id, bibcode, how``: the document of each asked record (``asked_id, doi, arxiv, title``) among those found for it (``asked_id, doc``).

    A document with the DOI comes first, then one with the arXiv id, then the most similar title of at least
    ``least``; among equals a journal before an e-print, the later year, the smaller bibcode.
    """
    d = docs.select("asked_id", F.col("doc.bibcode").alias("bibcode"), F.col("doc.year").alias("year"), all_dois(F.try_element_at("doc.doi", F.lit(1)), F.col("doc.identifier")).alias("dois"), F.lower(formats.last_with(F.col("doc.identifier"), "arxiv:")).alias("ax"), F.try_element_at("doc.title", F.lit(1)).alias("t"))
    x = asked.join(d, "asked_id").withColumn("like", similarity(F.col("title"), F.col("t")))
    how = F.when(F.array_contains("dois", F.lower("doi")), "doi").when(F.col("ax") == F.lower("arxiv"), "arxiv").when(F.col("like") >= least, "title")
    x = x.withColumn("how", how).where("how is not null").withColumn("o", F.when(F.col("how") == "doi", 0).when(F.col("how") == "arxiv", 1).otherwise(2))
    w = Window.partitionBy("asked_id").orderBy("o", F.when(F.col("o") == 2, -F.col("like")).otherwise(0.0), is_eprint(F.col("bibcode")).cast("int"), F.desc("year"), "bibcode")
    return x.withColumn("n", F.row_number().over(w)).where("n = 1").select("asked_id", "bibcode", "how")


def ingest_documents(files: DataFrame, papers: DataFrame, search: Provider, at: Column, strong_only: bool = False) -> DataFrame:
    """Papers after an ingest of ``path, clean, raw``: identified, resolved by a provider of search answers, placed and upserted.

    The provider is asked once for each DOI, arXiv id or title. Files that match nothing change nothing; with
    ``strong_only`` a title alone is not asked for.
    """
    ids = files.select("path", document_identifiers(F.col("clean"), F.col("raw")).alias("x")).select("path", F.col("path").alias("asked_id"), "x.*")
    if strong_only:
        ids = ids.where("doi is not null or arxiv is not null")
    keyed = ids.withColumn("key", F.coalesce("doi", "arxiv", "title")).where("key is not null")
    found = keyed.join(lookup(keyed, "key", search), "key").select("asked_id", F.explode(formats.ads_docs(F.col("answer"))).alias("doc"))
    best = choose_match(keyed.select("asked_id", "doi", "arxiv", "title"), found)
    rows = found.withColumn("bibcode", F.col("doc.bibcode")).join(best, ["asked_id", "bibcode"]).select("asked_id", formats.paper_of(F.col("doc")).alias("p"))
    new = rows.select("p.arxiv_id", "p.bibcode", "p.title", "p.abstract", "p.published", "p.source", F.concat(F.lit("pdfs/"), safe_stem(F.col("p.bibcode")), F.lit(".pdf")).alias("pdf_relpath"), at.alias("at"))
    return mutate.upsert_papers(papers, new.dropDuplicates(["bibcode"]))


def index_papers(sources: DataFrame, chunks: DataFrame, force: bool = False, client=None) -> DataFrame:
    """New chunk rows (with vectors) of ``paper_id, text``: papers that have chunks are left out unless ``force``."""
    todo = sources if force else sources.join(chunks.select("paper_id").distinct(), "paper_id", "left_anti")
    cut = mutate.number_rows(chunk_texts(todo, "paper_id", "text"), ["paper_id", "chunk_ord"])
    top = chunks.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = cut.crossJoin(F.broadcast(top)).select((F.col("top") + F.col("n")).alias("id"), "paper_id", "chunk_ord", "char_start", "char_end", "text", text_hash(F.col("text")).alias("text_hash"))
    return vectors.embed(rows, "text", client=client)


def sync_references(papers: DataFrame, edges: DataFrame, references: Provider, missing_only: bool = True) -> DataFrame:
    """Edges after a synchronisation: each paper with a bibcode is asked for once (a JSON list of bibcodes); its edges are replaced by a non-empty answer."""
    p = papers.where(nonblank(F.col("bibcode"))).select(F.col("id").alias("from_paper_id"), F.trim("bibcode").alias("key"))
    if missing_only:
        p = p.join(edges.select("from_paper_id"), "from_paper_id", "left_anti")
    got = p.join(lookup(p, "key", references), "key").select("from_paper_id", F.explode(F.from_json("answer", "array<string>")).alias("ref_bibcode"))
    return mutate.replace_references(edges, got)


def ingest_hubs(papers: DataFrame, hubs: DataFrame, search: Provider, at: Column) -> DataFrame:
    """Papers after the works in ``hubs`` (``ref_bibcode``) were looked up and added."""
    asked = hubs.select(F.col("ref_bibcode").alias("key"))
    doc = asked.join(lookup(asked, "key", search), "key").select(F.explode(formats.ads_docs(F.col("answer"))).alias("doc")).select(formats.paper_of(F.col("doc")).alias("p"))
    new = doc.select("p.arxiv_id", "p.bibcode", "p.title", "p.abstract", "p.published", "p.source", F.lit(None).cast("string").alias("pdf_relpath"), at.alias("at"))
    return mutate.upsert_papers(papers, new.dropDuplicates(["bibcode"]))


def write_sources(texts: DataFrame, path: str) -> None:
    """``paper_id, text, sections`` as one folder of JSON rows a paper bucket; readable in parallel, one snapshot a call."""
    texts.withColumn("bucket", F.pmod(F.xxhash64("paper_id"), F.lit(256)).cast("int")).write.mode("errorifexists").partitionBy("bucket").json(path)
