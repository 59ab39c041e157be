"""Lines, references and documents resolved against the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions.identifiers import bibcode_from_text, catalog_identifiers, doi_from_text, line_kind, strip_arxiv_version
from lucerna.functions.references import parse_reference
from lucerna.functions.text import nonblank
from lucerna.operators import bm25
from lucerna.runtime import cut


def _arxiv(c: Column) -> Column:
    return F.lower(strip_arxiv_version(c))


def library_keys(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``bib → id`` and ``arxiv → id, bibcode`` of the library: the latest paper (largest id) of a key."""
    b = papers.where(nonblank(F.col("bibcode"))).groupBy(F.trim("bibcode").alias("bib")).agg(F.max("id").alias("by_bib"))
    a = papers.where(nonblank(F.col("arxiv_id"))).groupBy(_arxiv(F.col("arxiv_id")).alias("ax")).agg(F.max_by(F.struct(F.col("id"), F.trim("bibcode").alias("bibcode")), "id").alias("p"))
    return b, a.select("ax", F.col("p.id").alias("by_arxiv"), F.col("p.bibcode").alias("arxiv_bib"))


def author_year_hits(lines: DataFrame, papers: DataFrame) -> DataFrame:
    """``line_id, n, id``: how many papers have the author and year of a line, and the smallest of them.

    Names are matched by equality on folded words, so the join is keyed; a name in many papers of a year is
    counted before it meets the lines.
    """
    names = F.from_json("authors_json", "array<string>")
    words = papers.select("id", F.substring("published", 1, 4).alias("y"), F.explode(F.array_distinct(F.flatten(F.transform(names, lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}'’-]{2,})"), F.lit(1)))))).alias("w")).where("y is not null")
    keys = words.groupBy("w", "y").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return lines.select("line_id", F.lower("author").alias("w"), F.substring("year", 1, 4).alias("y")).join(keys, ["w", "y"]).select("line_id", "n", "id")


def parse_lines(lines: DataFrame, papers: DataFrame) -> DataFrame:
    """``line_id, kind, bibcode, arxiv, doi, library_hit, note`` of catalogue lines (``line_id, line``).

    A line is an identifier or free text. Identifiers are looked up in the library (bibcode, then arXiv id);
    free text whose author and year only one paper has becomes that paper. The rest keeps what it says and
    is left to a provider (``note`` is ``unresolved``).
    """
    bibs, arxivs = library_keys(papers)
    parsed = lines.withColumn("kind", line_kind(F.col("line"))).withColumn("x", catalog_identifiers(F.col("line"))).withColumn("r", parse_reference(F.col("line")))
    rows = parsed.select("line_id", "kind", F.col("x.bibcode").alias("bib"), _arxiv(F.col("x.arxiv")).alias("ax"), F.col("x.doi").alias("doi"), F.col("r.first_author").alias("author"), F.col("r.year").alias("year"))
    free = rows.where((F.col("kind") == "text") & F.col("author").isNotNull() & F.col("year").isNotNull())
    one = author_year_hits(free, papers).where("n = 1").join(papers.select("id", F.trim("bibcode").alias("only_bib")), "id").where("only_bib <> ''").select("line_id", "only_bib")
    got = rows.join(bibs, "bib", "left").join(arxivs, "ax", "left").join(one, "line_id", "left")
    by_id = F.when(F.col("by_bib").isNotNull(), F.col("bib")).otherwise(F.nullif(F.col("arxiv_bib"), F.lit("")))
    return got.select(
        "line_id", "kind", F.coalesce(by_id, "only_bib").alias("bibcode"), F.col("ax").alias("arxiv"), "doi", (by_id.isNotNull() | F.col("only_bib").isNotNull()).alias("library_hit"),
        F.when(by_id.isNotNull(), "database").when(F.col("only_bib").isNotNull(), "library_author_year").otherwise("unresolved").alias("note"))


def parse_fragments(lines: DataFrame, papers: DataFrame) -> DataFrame:
    """``line_id, bibcode, arxiv, doi, note`` of bibliography lines by the identifiers they hold, a DOI before an arXiv id."""
    from lucerna.functions.identifiers import arxiv_from_text

    bibs, arxivs = library_keys(papers)
    rows = lines.select("line_id", bibcode_from_text(F.col("line")).alias("bib"), F.lower(arxiv_from_text(F.col("line"))).alias("ax"), doi_from_text(F.col("line")).alias("doi"))
    got = rows.join(bibs, "bib", "left").join(arxivs, "ax", "left")
    found = F.when(F.col("by_bib").isNotNull(), F.col("bib")).otherwise(F.nullif(F.col("arxiv_bib"), F.lit("")))
    note = F.when(found.isNotNull(), "database").when(F.col("doi").isNotNull(), "ask_doi").when(F.col("ax").isNotNull(), "ask_arxiv").otherwise("unresolved")
    return got.select("line_id", found.alias("bibcode"), F.col("ax").alias("arxiv"), "doi", note.alias("note"))


def local_search(queries: DataFrame, papers: DataFrame, limit: int = 15) -> DataFrame:
    """``query_id, id, tier``: the first tier that finds papers for a query (``query_id, q``).

    Tiers: bibcode, arXiv id, DOI as words, author and year, the parsed fields as words, all words. Words must
    all stand in title or abstract; they are looked up in the inverted index for all queries at once, and
    only those that no earlier tier answered.
    """
    rows = queries.withColumn("kind", line_kind(F.col("q"))).withColumn("x", catalog_identifiers(F.col("q"))).withColumn("r", parse_reference(F.col("q")))
    bib = rows.select("query_id", F.col("x.bibcode").alias("k")).join(papers.where(nonblank(F.col("bibcode"))).select("id", F.trim("bibcode").alias("k")), "k").select("query_id", "id", F.lit(1).alias("tier"))
    ax = rows.select("query_id", _arxiv(F.col("x.arxiv")).alias("k")).join(papers.where(nonblank(F.col("arxiv_id"))).select("id", _arxiv(F.col("arxiv_id")).alias("k")), "k").select("query_id", "id", F.lit(2).alias("tier"))
    names = F.from_json("authors_json", "array<string>")
    people = papers.select("id", F.substring("published", 1, 4).alias("y"), F.explode(F.array_distinct(F.flatten(F.transform(names, lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}'’-]{2,})"), F.lit(1)))))).alias("w"))
    best = people.withColumn("n", F.row_number().over(Window.partitionBy("w", "y").orderBy("id"))).where(F.col("n") <= limit)  # a top list of each key, as many as can be shown
    ay = rows.where("kind = 'text'").select("query_id", F.lower("r.first_author").alias("w"), F.substring("r.year", 1, 4).alias("y")).join(best, ["w", "y"]).select("query_id", "id", F.lit(4).alias("tier"))
    found = cut(bib.unionByName(ax).unionByName(ay))  # every tier reads what the earlier ones found: written, so that plans do not nest
    text = F.concat_ws(" ", "title", "abstract")
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)), lambda x: ~x.isin(*bm25.RESERVED)))
    fields = F.concat_ws(" ", "r.first_author", "r.year", "r.journal", "r.volume", "r.page")
    for tier, cond, source in ((3, F.col("kind") == "doi", F.translate(F.col("x.doi"), "/:", "  ")), (5, F.col("kind") == "text", fields), (6, F.lit(True), F.substring("q", 1, 800))):
        left = rows.where(cond).join(found.select("query_id").distinct(), "query_id", "left_anti")
        terms = left.select("query_id", F.explode(F.slice(words(source), 1, 24)).alias("term"))
        hits = bm25.search_many(papers, "id", text, terms, True)
        top = hits.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("bm25", 9), "id"))).where(F.col("n") <= limit)
        found = found.unionByName(cut(top.select("query_id", "id", F.lit(tier).alias("tier"))))
    first = found.groupBy("query_id").agg(F.min("tier").alias("tier"))
    kept = found.join(first, ["query_id", "tier"]).distinct()
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).where(F.col("n") <= limit).drop("n")


def chain(edges: DataFrame, papers: DataFrame, seeds: DataFrame, max_hops: int, most_follow: int = 0) -> DataFrame:
    """``seed, paper_id, depth, parent``: the reference chain of each seed, every paper once, with the parent that reached it first.

    One join a hop between the papers reached last and the resolved edges, less what was visited; state is
    cut after each hop. ``most_follow`` keeps the first references (by bibcode) of a paper. The parent is the
    smallest id among those of the hop.
    """
    from lucerna.operators.graph import resolve_edges

    inner = resolve_edges(edges, papers).where("in_library").select(F.col("from_paper_id").alias("u"), F.col("to_paper_id").alias("v"), "ref_bibcode")
    if most_follow:
        inner = inner.withColumn("n", F.row_number().over(Window.partitionBy("u").orderBy("ref_bibcode"))).where(F.col("n") <= most_follow)
    inner = cut(inner.select("u", "v").distinct())
    seen = cut(seeds.select("seed", F.col("seed").alias("paper_id"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")))
    front = seen
    for hop in range(1, max_hops + 1):
        step = front.select("seed", F.col("paper_id").alias("u")).join(inner, "u").groupBy("seed", F.col("v").alias("paper_id")).agg(F.min("u").alias("parent"))
        front = cut(step.join(seen.select("seed", "paper_id"), ["seed", "paper_id"], "left_anti").select("seed", "paper_id", F.lit(hop).alias("depth"), "parent"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def narrowed(lines: DataFrame, by: str, n: str, score: str, above: int = 60, most: int = 80, must: int = 12) -> DataFrame:
    """Adds ``pos`` to the reference lines of each paper and keeps ``most`` where there are more than ``above``: the ``must`` best with points by number, then by points, renumbered."""
    size = F.count("*").over(Window.partitionBy(by))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), n))
    rows = lines.withColumn("_size", size).withColumn("_rank", rank)
    first = (F.col("_rank") <= must) & (F.col(score) > 0)
    order = F.when(F.col("_size") <= above, F.struct(F.lit(0).alias("k"), F.col(n).cast("long").alias("o"))).when(first, F.struct(F.lit(0).alias("k"), F.col(n).cast("long").alias("o"))).otherwise(F.struct(F.lit(1).alias("k"), F.col("_rank").cast("long").alias("o")))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(order))).where((F.col("_size") <= above) | (F.col("pos") <= most)).drop("_size", "_rank")
