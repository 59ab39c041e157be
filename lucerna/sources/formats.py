"""Records in the formats of other services: BibTeX, Atom, JSON documents, cache entries and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions.identifiers import doi_from_text, strip_arxiv_version
from lucerna.functions.text import nonblank


def bibtex_field(entry: Column, name: str) -> Column:
    """A field of a BibTeX entry, in braces (one level inside) or quotes; null without one."""
    braced = F.regexp_extract(entry, rf"(?is)\b{name}\s*=\s*\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}", 1)
    quoted = F.regexp_extract(entry, rf'(?is)\b{name}\s*=\s*"([^"]*)"', 1)
    return F.nullif(F.trim(F.when(braced != "", braced).otherwise(quoted)), F.lit(""))


def read_bibtex(texts: DataFrame, text: str) -> DataFrame:
    """``pos, key, title, year, doi, arxiv, files``: the entries of BibTeX texts; ``files`` are the names of attached PDFs."""
    e = texts.select(F.posexplode(F.filter(F.split(F.col(text), r"\n(?=@\w+\{)"), lambda x: F.trim(x).startswith("@"))).alias("pos", "entry"))
    one = F.col("entry")
    names = F.filter(F.split(F.coalesce(bibtex_field(one, "file"), F.lit("")), r"[;:]"), lambda x: F.lower(x).endswith(".pdf"))
    arxiv = F.coalesce(bibtex_field(one, "eprint"), bibtex_field(one, "arxivid"), F.nullif(F.regexp_extract(one, r"(?i)arxiv[:/. ]*(?:abs/)?(\d{4}\.\d{4,5})", 1), F.lit("")))
    return e.select(
        "pos", F.nullif(F.regexp_extract(one, r"@\w+\{\s*([^,\s]+)", 1), F.lit("")).alias("key"), bibtex_field(one, "title").alias("title"), bibtex_field(one, "year").alias("year"),
        doi_from_text(bibtex_field(one, "doi")).alias("doi"), strip_arxiv_version(arxiv).alias("arxiv"), F.transform(names, lambda x: F.element_at(F.split(x, r"[/\\]"), -1)).alias("files"))


def to_bibtex(key: Column, title: Column, author: Column, year: Column, eprint: Column) -> Column:
    """One BibTeX entry; fields without a value are left out."""
    field = lambda name, c: F.when(nonblank(c), F.concat(F.lit(f"  {name} = {{"), c, F.lit("}")))
    lines = F.array_join(F.array_compact(F.array(field("title", title), field("author", author), field("year", year), field("eprint", eprint))), ",\n")
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), lines, F.lit("\n}"))


def last_by_file(entries: DataFrame) -> DataFrame:
    """``name, key``: the last entry that names each attached file, in any case."""
    return entries.select("pos", "key", F.explode("files").alias("f")).groupBy(F.lower("f").alias("name")).agg(F.max_by("key", "pos").alias("key"))


def failed_files(lines: DataFrame, line: str) -> DataFrame:
    """``rel, name``: the files of the ``FAIL`` lines of a log, each once."""
    rel = F.trim(F.regexp_extract(line, r"^\s*FAIL[:\s]+(.+?\.pdf)\b", 1))
    return lines.select(rel.alias("rel")).where("rel <> ''").distinct().withColumn("name", F.lower(F.element_at(F.split("rel", r"[/\\]"), -1)))


def retry_plan(failed: DataFrame, entries: DataFrame) -> DataFrame:
    """``rel, key, found``: failed files with the entry that names them; those without one are reported."""
    return failed.join(last_by_file(entries), "name", "left").select("rel", "key", F.col("key").isNotNull().alias("found"))


_ATOM = "entry array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>>>"


def parse_atom(xml: Column) -> Column:
    """Records of an Atom page: ``id`` (the tail of its address), ``title``, ``summary``, ``published`` (date), the first three ``authors``."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    page = F.from_xml(xml, _ATOM)
    return F.transform(page.getField("entry"), lambda e: F.struct(
        F.element_at(F.split(F.trim(e.id), "/"), -1).alias("id"), squeeze(e.title).alias("title"), squeeze(e.summary).alias("summary"),
        F.substring(F.trim(e.published), 1, 10).alias("published"), F.coalesce(F.slice(F.transform(e.author, lambda a: squeeze(a["name"])), 1, 3), F.array().cast("array<string>")).alias("authors")))


_DOC = "bibcode string, title array<string>, author array<string>, year string, pub string, volume string, page array<string>, eid string, doi array<string>, identifier array<string>, abstract string, issue string, property array<string>"


def ads_docs(response: Column) -> Column:
    """The documents of a search answer ``{"response": {"docs": [...]}}``; empty where there are none."""
    return F.coalesce(F.from_json(response, f"response struct<docs:array<struct<{_DOC.replace(' ', ':').replace(',:', ',')}>>>").getField("response").getField("docs"), F.array())


def _first(c: Column) -> Column:
    return F.try_element_at(c, F.lit(1))


def last_with(c: Column, prefix: str) -> Column:
    hits = F.filter(c, lambda x: F.startswith(F.lower(x), F.lit(prefix)))
    return F.substring(F.try_element_at(hits, F.lit(-1)), len(prefix) + 1, 10_000)


def candidate_of(doc: Column, source: str = "ads", score: float = 100.0) -> Column:
    """A document as a candidate; the page falls back to the electronic id, DOI and arXiv id to the identifiers."""
    return F.struct(
        F.lit(source).alias("source"), F.lit(score).alias("score"), F.coalesce(_first(doc["title"]), F.lit("")).alias("title"), F.coalesce(doc["author"], F.array().cast("array<string>")).alias("authors"),
        doc["year"].alias("year"), doc["pub"].alias("journal"), doc["volume"].alias("volume"), F.coalesce(_first(doc["page"]), doc["eid"]).alias("page"), doc["bibcode"].alias("bibcode"),
        F.coalesce(_first(doc["doi"]), last_with(doc["identifier"], "doi:")).alias("doi"), last_with(doc["identifier"], "arxiv:").alias("arxiv_id"))


def paper_of(doc: Column) -> Column:
    """A document as a row of papers; a year alone becomes its first day."""
    return F.struct(
        last_with(doc["identifier"], "arxiv:").alias("arxiv_id"), doc["bibcode"].alias("bibcode"), F.coalesce(_first(doc["title"]), F.lit("")).alias("title"), F.coalesce(doc["abstract"], F.lit("")).alias("abstract"),
        F.to_json(F.coalesce(doc["author"], F.array().cast("array<string>"))).alias("authors_json"), F.when(nonblank(doc["year"]), F.concat(doc["year"], F.lit("-01-01"))).alias("published"), F.lit("ads").alias("source"))


def cache_record(df: DataFrame) -> DataFrame:
    """``arxiv_id, title, abstract, published, authors, categories, matched_keywords`` of cache records under either of their field names."""
    have = set(df.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have])
    return df.select(pick("arxiv_id", "id").alias("arxiv_id"), pick("title").alias("title"), F.coalesce(pick("abstract", "summary"), F.lit("")).alias("abstract"), pick("published").alias("published"), pick("matched_keywords", "matched_kw").alias("matched_keywords"))


def split_invalid(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows fit for an import and the rejected ones."""
    good = F.coalesce(ok, F.lit(False))
    return df.where(good), df.where(~good)


#: Where a PDF is taken from, best first.
SOURCES = ("local", "pub", "ads", "eprint", "arxiv")


def source_rank(kind: Column) -> Column:
    """Order of a source of PDFs; unknown ones are last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.lower(kind)), F.lit(0)), F.lit(len(SOURCES) + 1))


def link_kind(url: Column, link_type: Column) -> Column:
    """The source a resolver record belongs to: ``pub``, ``ads`` or ``eprint`` PDFs; null for anything else."""
    t = F.upper(F.coalesce(link_type, F.lit("")))
    return F.when(F.contains(t, F.lit("PUB_PDF")), "pub").when(F.contains(t, F.lit("ADS_PDF")), "ads").when(F.contains(t, F.lit("EPRINT_PDF")) | F.contains(F.lower(url), F.lit("arxiv.org/pdf")), "eprint")


def best_source(df: DataFrame, by: str, kind: str, url: str) -> DataFrame:
    """``by, url, kind``: the best source of each work; the smaller address on ties."""
    best = df.where(nonblank(F.col(url))).groupBy(by).agg(F.min(F.struct(source_rank(F.col(kind)).alias("r"), F.col(url).alias("u"), F.col(kind).alias("k"))).alias("b"))
    return best.select(by, F.col("b.u").alias(url), F.col("b.k").alias(kind))


def is_pdf(content: Column) -> Column:
    """Whether bytes are a PDF: not empty, with its mark in the first 20."""
    head = F.decode(F.substring(content, 1, 20), "ISO-8859-1")
    return F.coalesce((F.length(content) > 0) & F.contains(head, F.lit("%PDF")), F.lit(False))
