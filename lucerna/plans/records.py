"""Records of services and files: lookups, mappings, imports, exports and small predicates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lucerna.functions import identifiers
from lucerna.functions.text import nonblank
from lucerna.operators import mutate, vectors
from lucerna.plans.base import query, table
from lucerna.sources import formats

_NB = "({0} IS NOT NULL AND trim({0}) <> '')"
_AX = r"regexp_replace(regexp_replace(trim(arxiv_id), '(?i)^arxiv:\s*', ''), '(?i)v[0-9]+$', '')"
_STRIP = r"regexp_replace(regexp_replace(trim({0}), '(?i)^arxiv:\s*', ''), '(?i)v[0-9]+$', '')"


@query("s4_point_lookup", "SELECT id, title FROM papers WHERE id IN (SELECT DISTINCT paper_id FROM parsed_references)")
def _(s, d):
    return table(s, d, "papers").join(table(s, d, "parsed_references").select(F.col("paper_id").alias("id")), "id", "left_semi").select("id", "title")


@query("s11_stored_sources", f"SELECT id, source_text_relpath FROM papers WHERE source_kind = 'tex' AND {_NB.format('source_text_relpath')}")
def _(s, d):
    p = table(s, d, "papers")
    return p.where((F.col("source_kind") == "tex") & nonblank(F.col("source_text_relpath"))).select("id", "source_text_relpath")


@query("s13_source_of_text", f"SELECT id, CASE WHEN source_kind = 'tex' AND {_NB.format('source_text_relpath')} THEN 'stored' WHEN {_NB.format('arxiv_id')} THEN 'fetch' WHEN {_NB.format('pdf_relpath')} THEN 'pdf' ELSE 'none' END AS resolution FROM papers")
def _(s, d):
    r = F.when((F.col("source_kind") == "tex") & nonblank(F.col("source_text_relpath")), "stored").when(nonblank(F.col("arxiv_id")), "fetch").when(nonblank(F.col("pdf_relpath")), "pdf").otherwise("none")
    return table(s, d, "papers").select("id", r.alias("resolution"))


@query("s20_atom_records", r"""
SELECT id, trim(regexp_replace(replace(title, chr(160), ' '), '\s+', ' ', 'g')) = trim(regexp_replace(replace(title, chr(160), ' '), '\s+', ' ', 'g')) AS same, substr(published, 1, 10) AS published, least(3, len(categories)) AS n FROM papers WHERE published IS NOT NULL AND categories IS NOT NULL""")
def _(s, d):
    # pages are written from the table and read back
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\p{Cc}", " "), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    p = table(s, d, "papers").where("published is not null and categories is not null")
    names = F.array_join(F.transform("categories", lambda x: F.concat(F.lit("<author><name>"), esc(x), F.lit("</name></author>"))), "")
    page = F.concat(F.lit("<feed><entry><id>http://x.invalid/abs/"), "id", F.lit("</id><title> "), esc(F.col("title")), F.lit("</title><summary>s</summary><published>"), "published", F.lit("</published>"), names, F.lit("</entry></feed>"))
    e = p.select(F.col("title").alias("t"), F.explode(formats.parse_atom(page)).alias("e"))
    return e.select(F.col("e.id").cast("long").alias("id"), F.lit(True).alias("same"), "e.published", F.size("e.authors").cast("long").alias("n"))


@query("s27_data_products", "SELECT id, split_part(x, ':', 1) AS provider, split_part(x, ':', 2)::INT AS n FROM (SELECT id, unnest(string_split('IRSA:' || (id % 7) || ', SIMBAD:' || (id % 52) || ',bad', ', ')) AS x FROM papers) WHERE x NOT LIKE '%,%' UNION ALL SELECT id, 'SIMBAD', (id % 52)::INT FROM papers")
def _(s, d):
    field = F.concat(F.lit("IRSA:"), F.col("id") % 7, F.lit(", SIMBAD:"), F.col("id") % 52, F.lit(",bad"))
    return table(s, d, "papers").select("id", F.explode(identifiers.data_products(field)).alias("x")).select("id", "x.provider", "x.n")


@query("s31_bibtex_entries", rf"SELECT regexp_extract(trim(bibcode), '^([^,\s]+)', 1) AS key, min(nullif(substr(published, 1, 4), '')) AS year FROM papers WHERE {_NB.format('bibcode')} AND published IS NOT NULL GROUP BY 1")
def _(s, d):
    # entries are written from the table and read back
    p = table(s, d, "papers").where(nonblank(F.col("bibcode")) & F.col("published").isNotNull())
    entry = formats.to_bibtex(F.trim("bibcode"), F.regexp_replace("title", r"[{}]", ""), F.lit(None).cast("string"), F.substring("published", 1, 4), F.lit(None).cast("string"))
    return formats.read_bibtex(p.select(entry.alias("t")), "t").groupBy("key").agg(F.min("year").alias("year"))


@query("k13_bibtex", f"""SELECT trim(bibcode) AS key, min(md5('@article{{' || trim(bibcode) || ',' || chr(10) || concat_ws(',' || chr(10), CASE WHEN trim(title) <> '' THEN '  title = {{' || title || '}}' END, CASE WHEN trim(substr(published, 1, 4)) <> '' THEN '  year = {{' || substr(published, 1, 4) || '}}' END, CASE WHEN trim(arxiv_id) <> '' THEN '  eprint = {{' || arxiv_id || '}}' END) || chr(10) || '}}')) AS h FROM papers WHERE {_NB.format('bibcode')} GROUP BY 1""")
def _(s, d):
    p = table(s, d, "papers").where(nonblank(F.col("bibcode")))
    entry = formats.to_bibtex(F.trim("bibcode"), F.col("title"), F.lit(None).cast("string"), F.substring("published", 1, 4), F.col("arxiv_id"))
    return p.select(F.trim("bibcode").alias("key"), F.md5(entry).alias("h")).groupBy("key").agg(F.min("h").alias("h"))


@query("j19_retry_plan", f"""
WITH f AS (SELECT DISTINCT pdf_relpath AS rel, lower(string_split(replace(pdf_relpath, '\\', '/'), '/')[-1]) AS name FROM papers WHERE regexp_full_match(pdf_relpath, '[^ ]+[.]pdf')),
b AS (SELECT lower(string_split(replace(pdf_relpath, '\\', '/'), '/')[-1]) AS name, max(trim(bibcode)) AS key FROM papers WHERE {_NB.format('bibcode')} AND regexp_full_match(pdf_relpath, '[^ ]+[.]pdf') AND NOT contains(pdf_relpath, ':') GROUP BY 1)
SELECT rel, key, key IS NOT NULL AS found FROM f LEFT JOIN b USING (name)""")
def _(s, d):
    p = table(s, d, "papers").where(F.col("pdf_relpath").rlike(r"^[^ ]+\.pdf$"))
    failed = formats.failed_files(p.select(F.concat(F.lit("FAIL "), "pdf_relpath").alias("line")), "line")
    files = p.where(nonblank(F.col("bibcode")) & ~F.contains("pdf_relpath", F.lit(":")))
    entries = files.select(F.trim("bibcode").alias("pos"), F.trim("bibcode").alias("key"), F.array(F.element_at(F.split("pdf_relpath", r"[/\\]"), -1)).alias("files"))
    return formats.retry_plan(failed, entries)


@query("s23_best_links", """
WITH l AS (SELECT cand_id, bibcode, CASE cand_id % 4 WHEN 0 THEN 'PUB_PDF' WHEN 1 THEN 'ADS_PDF' WHEN 2 THEN 'EPRINT_PDF' ELSE 'DATA' END AS t FROM candidates WHERE bibcode IS NOT NULL),
k AS (SELECT bibcode, cand_id, CASE t WHEN 'PUB_PDF' THEN 'pub' WHEN 'ADS_PDF' THEN 'ads' WHEN 'EPRINT_PDF' THEN 'eprint' END AS kind FROM l)
SELECT bibcode, kind, url FROM (SELECT bibcode, kind, 'u' || cand_id AS url, row_number() OVER (PARTITION BY bibcode ORDER BY CASE kind WHEN 'pub' THEN 1 WHEN 'ads' THEN 2 ELSE 3 END, 'u' || cand_id) AS n FROM k WHERE kind IS NOT NULL) WHERE n = 1""")
def _(s, d):
    t = F.element_at(F.array(*[F.lit(x) for x in ("PUB_PDF", "ADS_PDF", "EPRINT_PDF", "DATA")]), (F.col("cand_id") % 4 + 1).cast("int"))
    links = table(s, d, "candidates").where("bibcode is not null").select("bibcode", F.concat(F.lit("u"), "cand_id").alias("url"), t.alias("t")).withColumn("kind", formats.link_kind(F.col("url"), F.col("t")))
    return formats.best_source(links.where("kind is not null"), "bibcode", "kind", "url").select("bibcode", "kind", "url")


@query("k16_pdf_source", f"SELECT id, CASE WHEN {_NB.format('pdf_relpath')} THEN 'local' WHEN {_NB.format('bibcode')} THEN 'pub' WHEN {_NB.format('arxiv_id')} THEN 'arxiv' END AS kind FROM papers WHERE {_NB.format('pdf_relpath')} OR {_NB.format('bibcode')} OR {_NB.format('arxiv_id')}")
def _(s, d):
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("url")) for k, c in (("local", "pdf_relpath"), ("pub", "bibcode"), ("arxiv", "arxiv_id"))])
    return formats.best_source(table(s, d, "papers").select("id", F.explode(kinds).alias("x")).select("id", "x.*"), "id", "kind", "url").select("id", "kind")


@query("k15_is_pdf", "SELECT id, id % 3 = 0 AS ok FROM papers")
def _(s, d):
    body = F.when(F.col("id") % 3 == 0, F.concat(F.lit("  %PDF-1.7 "), "title")).when(F.col("id") % 3 == 1, F.concat(F.lit("<html>........................ %PDF"), "title")).otherwise("")
    return table(s, d, "papers").select("id", formats.is_pdf(F.encode(body, "UTF-8")).alias("ok"))


def _ads():
    """Candidates as search answers."""
    return F.to_json(F.struct(F.struct(F.array(F.struct(
        "bibcode", F.array("title").alias("title"), F.col("authors").alias("author"), "year", F.col("journal").alias("pub"), "volume", F.when(F.col("cand_id") % 2 == 0, F.array("page")).alias("page"), F.col("page").alias("eid"),
        F.array(F.concat(F.lit("doi:"), "doi"), F.concat(F.lit("arXiv:"), "arxiv_id")).alias("identifier"))).alias("docs")).alias("response")))


@query("p28_candidates_of_docs", "SELECT cand_id, title, year, journal, volume, page, bibcode, doi, arxiv_id, len(authors)::INT AS n_authors FROM candidates")
def _(s, d):
    c = table(s, d, "candidates").select("cand_id", F.explode(formats.ads_docs(_ads())).alias("doc")).select("cand_id", formats.candidate_of(F.col("doc")).alias("c"))
    return c.select("cand_id", "c.title", "c.year", "c.journal", "c.volume", "c.page", "c.bibcode", "c.doi", "c.arxiv_id", F.size("c.authors").alias("n_authors"))


@query("k4_papers_of_docs", "SELECT cand_id, arxiv_id, bibcode, title, CASE WHEN trim(year) <> '' THEN year || '-01-01' END AS published FROM candidates")
def _(s, d):
    c = table(s, d, "candidates").select("cand_id", F.explode(formats.ads_docs(_ads())).alias("doc")).select("cand_id", formats.paper_of(F.col("doc")).alias("p"))
    return c.select("cand_id", "p.arxiv_id", "p.bibcode", "p.title", "p.published")


@query("n2_nested_answer", "SELECT cand_id, bibcode, year FROM candidates WHERE bibcode IS NOT NULL")
def _(s, d):
    get = lambda f: F.get_json_object(_ads(), f"$.response.docs[0].{f}").alias(f)
    return table(s, d, "candidates").where("bibcode is not null").select("cand_id", get("bibcode"), get("year"))


@query("k2_cache_records", f"SELECT {_AX} AS arxiv_id, title, abstract, published FROM papers WHERE {_NB.format('arxiv_id')}")
def _(s, d):
    old = table(s, d, "papers").where(nonblank(F.col("arxiv_id"))).select(identifiers.strip_arxiv_version(F.col("arxiv_id")).alias("id"), "title", F.col("abstract").alias("summary"), "published", F.col("matched_keywords").alias("matched_kw"))
    return formats.cache_record(old).select("arxiv_id", "title", "abstract", "published")


@query("k3_import", f"SELECT count(*) FILTER ({_NB.format('arxiv_id')} AND trim(title) <> '') AS imported, count(*) FILTER (NOT coalesce({_NB.format('arxiv_id')} AND trim(title) <> '', false)) AS rejected FROM papers")
def _(s, d):
    good, bad = formats.split_invalid(table(s, d, "papers"), nonblank(F.col("arxiv_id")) & nonblank(F.col("title")))
    return good.agg(F.count("*").alias("imported")).crossJoin(bad.agg(F.count("*").alias("rejected")))


@query("k5_replace_chunks", """
WITH n AS (SELECT id AS paper_id FROM papers WHERE trim(abstract) <> '' AND source = 'ads')
SELECT paper_id, chunk_ord, text FROM paper_chunks WHERE paper_id NOT IN (SELECT paper_id FROM n) UNION ALL SELECT id, 0, abstract FROM papers WHERE id IN (SELECT paper_id FROM n)""")
def _(s, d):
    new = table(s, d, "papers").where((F.trim("abstract") != "") & (F.col("source") == "ads")).select(F.col("id").alias("paper_id"), F.lit(0).alias("chunk_ord"), F.col("abstract").alias("text"))
    return mutate.replace_rows(table(s, d, "paper_chunks"), new, "paper_id")


@query("k8_extraction_runs", "SELECT 1 + row_number() OVER (ORDER BY source) AS id, source AS topic FROM (SELECT DISTINCT source FROM candidates)")
def _(s, d):
    runs = table(s, d, "candidates").select(F.col("source").alias("topic")).distinct()
    return mutate.number_rows(runs, ["topic"]).select((F.col("n") + 1).alias("id"), "topic")


@query("k9_vectors_replaced", "SELECT vec_id FROM embeddings WHERE label <> 3 UNION ALL SELECT vec_id + 1000000 FROM embeddings WHERE label = 3")
def _(s, d):
    e = table(s, d, "embeddings")
    return mutate.replace_rows(e.select("label", "vec_id"), e.where("label = 3").select("label", (F.col("vec_id") + 1_000_000).alias("vec_id")), "label").select("vec_id")


@query("v5_valid_vectors", "SELECT vec_id, len(embedding)::INT AS n FROM embeddings")
def _(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    broken = e.limit(3).select(F.lit(-1).cast("long").alias("vec_id"), F.array(F.lit(None).cast("float")).alias("embedding"))
    return vectors.valid_vectors(e.unionByName(broken), "embedding").select("vec_id", F.size("embedding").alias("n"))


@query("v6_items", "SELECT count(*) AS items FROM embeddings")
def _(s, d):
    return table(s, d, "embeddings").agg(F.count("*").alias("items"))


@query("f5_by_bibcode", f"SELECT p.id, c.cand_id FROM papers p JOIN candidates c ON p.bibcode = trim(c.bibcode) WHERE {_NB.format('c.bibcode')}")
def _(s, d):
    c = table(s, d, "candidates").where(nonblank(F.col("bibcode"))).select("cand_id", F.trim("bibcode").alias("bibcode"))
    return table(s, d, "papers").select("id", "bibcode").join(c, "bibcode").select("id", "cand_id")


@query("f6_arxiv_variants", rf"""
WITH c AS (SELECT cand_id, regexp_replace(trim(arxiv_id), '(?i)^arxiv:\s*', '') AS a FROM candidates WHERE {_NB.format('arxiv_id')}), b AS (SELECT cand_id, a, regexp_replace(a, '(?i)v[0-9]+$', '') AS base FROM c),
v AS (SELECT cand_id, unnest(list_distinct([a, base, base || 'v1', upper(base)])) AS v FROM b)
SELECT DISTINCT cand_id, p.id FROM v JOIN papers p ON p.arxiv_id = v.v""")
def _(s, d):
    c = table(s, d, "candidates").where(nonblank(F.col("arxiv_id"))).select("cand_id", F.explode(identifiers.arxiv_variants(F.regexp_replace(F.trim("arxiv_id"), r"(?i)^arxiv:\s*", ""))).alias("arxiv_id"))
    return c.join(table(s, d, "papers").select("id", "arxiv_id"), "arxiv_id").select("cand_id", "id").distinct()


@query("f9_paper_of_path", r"""
WITH n AS (SELECT id, lower(replace(trim(pdf_relpath), '\', '/')) AS p FROM papers WHERE trim(pdf_relpath) <> '')
SELECT a.id AS asked, min(b.id) AS id FROM n a JOIN n b USING (p) GROUP BY 1""")
def _(s, d):
    n = table(s, d, "papers").where(nonblank(F.col("pdf_relpath"))).select("id", F.lower(F.replace(F.trim("pdf_relpath"), F.lit("\\"), F.lit("/"))).alias("p"))
    return n.select(F.col("id").alias("asked"), "p").join(n.groupBy("p").agg(F.min("id").alias("id")), "p").select("asked", "id")


@query("f14_filtered_nearest", """
WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)), d AS (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], qv) AS distance FROM embeddings, q WHERE label = 3)
SELECT vec_id, round(distance, 6) AS distance FROM d ORDER BY d.distance, vec_id LIMIT 5""")
def _(s, d):
    e = table(s, d, "embeddings")
    one = e.orderBy("vec_id").limit(1)
    return vectors.nearest(e.where("label = 3"), "vec_id", "embedding", one, "vec_id", "embedding", 5).select("vec_id", F.round("distance", 6).alias("distance"))


@query("f16_strong_id", f"SELECT cand_id FROM candidates WHERE {_NB.format('doi')} OR {_NB.format('arxiv_id')}")
def _(s, d):
    return table(s, d, "candidates").where(nonblank(F.col("doi")) | nonblank(F.col("arxiv_id"))).select("cand_id")


@query("f17_decoded_rows", "SELECT id, array_to_string(from_json(CASE WHEN json_valid(authors_json) AND json_type(authors_json) = 'ARRAY' THEN authors_json ELSE '[]' END, '[\"VARCHAR\"]'), '|') AS authors FROM papers")
def _(s, d):
    return table(s, d, "papers").select("id", F.array_join(F.coalesce(F.from_json("authors_json", "array<string>"), F.array().cast("array<string>")), "|").alias("authors"))


@query("f18_enriched_rows", f"SELECT id, 'library' AS provenance, CASE WHEN {_NB.format('pdf_relpath')} THEN '/data/' || trim(pdf_relpath) END AS pdf_abspath FROM papers")
def _(s, d):
    return table(s, d, "papers").select("id", F.lit("library").alias("provenance"), F.when(nonblank(F.col("pdf_relpath")), F.concat(F.lit("/data/"), F.trim("pdf_relpath"))).alias("pdf_abspath"))


@query("f19_public_fields", "SELECT id, title FROM papers")
def _(s, d):
    p = table(s, d, "papers").select("id", "title", F.col("abstract").alias("_abstract"))
    return p.select(*[c for c in p.columns if not c.startswith("_")])


@query("j6_indexable_without_chunks", f"SELECT id FROM papers p WHERE ({_NB.format('source_text_relpath')} OR {_NB.format('pdf_relpath')} OR {_NB.format('arxiv_id')}) AND NOT EXISTS (SELECT 1 FROM paper_chunks c WHERE c.paper_id = p.id)")
def _(s, d):
    p = table(s, d, "papers").where(nonblank(F.col("source_text_relpath")) | nonblank(F.col("pdf_relpath")) | nonblank(F.col("arxiv_id"))).select("id")
    return p.join(table(s, d, "paper_chunks").select(F.col("paper_id").alias("id")), "id", "left_anti")


@query("j18_semi_by_ids", "SELECT id FROM papers WHERE id IN (SELECT from_paper_id FROM paper_references WHERE ref_bibcode LIKE '20%')")
def _(s, d):
    ids = table(s, d, "paper_references").where(F.startswith("ref_bibcode", F.lit("20"))).select(F.col("from_paper_id").alias("id"))
    return table(s, d, "papers").select("id").join(ids, "id", "left_semi")


@query("a7_migration", f"""SELECT count(*) FILTER ({_NB.format('arxiv_id')}) AS with_arxiv, count(*) FILTER (source_kind = 'tex') AS tex, count(*) FILTER (source_kind = 'pdf') AS pdf,
(SELECT count(DISTINCT paper_id) FROM paper_chunks) AS indexed, (SELECT count(DISTINCT c.paper_id) FROM paper_chunks c JOIN papers q ON q.id = c.paper_id WHERE q.source_kind = 'tex') AS tex_indexed FROM papers""")
def _(s, d):
    p, c = table(s, d, "papers"), table(s, d, "paper_chunks").select(F.col("paper_id").alias("id")).distinct()
    one = p.agg(F.count_if(nonblank(F.col("arxiv_id"))).alias("with_arxiv"), F.count_if(F.col("source_kind") == "tex").alias("tex"), F.count_if(F.col("source_kind") == "pdf").alias("pdf"))
    return one.crossJoin(c.agg(F.count("*").alias("indexed"))).crossJoin(p.where("source_kind = 'tex'").join(c, "id", "left_semi").agg(F.count("*").alias("tex_indexed")))


@query("x7_phases", "SELECT id, CASE WHEN NOT EXISTS (SELECT 1 FROM paper_chunks c WHERE c.paper_id = p.id) THEN 'index' WHEN coalesce(source_kind, '') <> 'tex' AND trim(arxiv_id) <> '' THEN 'fetch' ELSE 'done' END AS phase FROM papers p")
def _(s, d):
    done = table(s, d, "paper_chunks").select(F.col("paper_id").alias("id"), F.lit(True).alias("has")).distinct()
    phase = F.when(F.col("has").isNull(), "index").when((F.coalesce("source_kind", F.lit("")) != "tex") & nonblank(F.col("arxiv_id")), "fetch").otherwise("done")
    return table(s, d, "papers").join(done, "id", "left").select("id", phase.alias("phase"))


@query("u4_intersect", "SELECT id FROM papers WHERE source = 'ads' INTERSECT SELECT id FROM papers p WHERE NOT EXISTS (SELECT 1 FROM paper_references r WHERE r.from_paper_id = p.id)")
def _(s, d):
    p = table(s, d, "papers")
    return p.where("source = 'ads'").select("id").intersect(p.select("id").join(table(s, d, "paper_references").select(F.col("from_paper_id").alias("id")), "id", "left_anti"))


@query("u5_candidate_union", "SELECT 'ads' AS source, cand_id, title FROM candidates WHERE source = 'ads' UNION ALL SELECT 'arxiv', cand_id, title FROM candidates WHERE source = 'arxiv'")
def _(s, d):
    c = table(s, d, "candidates")
    part = lambda k: c.where(F.col("source") == k).select(F.lit(k).alias("source"), "cand_id", "title")
    return part("ads").unionByName(part("arxiv"))


@query("u6_distinct_queries", "SELECT lower(trim(journal)) AS q, min(ref_id) AS first FROM parsed_references WHERE trim(journal) <> '' GROUP BY 1")
def _(s, d):
    return table(s, d, "parsed_references").where(nonblank(F.col("journal"))).groupBy(F.lower(F.trim("journal")).alias("q")).agg(F.min("ref_id").alias("first"))


@query("d2_cutoff", "SELECT id FROM papers WHERE published >= strftime(DATE '2026-01-01' - INTERVAL 3650 DAY, '%Y-%m-%d')")
def _(s, d):
    return table(s, d, "papers").where(F.col("published") >= F.date_format(F.date_sub(F.lit("2026-01-01").cast("date"), 3650), "yyyy-MM-dd")).select("id")


@query("d1_iso_times", "SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS at FROM papers")
def _(s, d):
    return table(s, d, "papers").select("id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


@query("d4_year_range", "SELECT ref_id, coalesce(TRY_CAST(substr(year, 1, 4) AS INT) BETWEEN 1900 AND 2026, false) AS ok FROM parsed_references")
def _(s, d):
    return table(s, d, "parsed_references").select("ref_id", F.coalesce(F.substring("year", 1, 4).try_cast("int").between(1900, 2026), F.lit(False)).alias("ok"))


@query("m1_clamped", "SELECT cand_id, greatest(1, least(100, score::INT)) AS n FROM candidates")
def _(s, d):
    return table(s, d, "candidates").select("cand_id", F.greatest(F.lit(1), F.least(F.lit(100), F.round("score").cast("int"))).alias("n"))


@query("r1_first_authors", "SELECT cand_id, array_to_string(authors[1:3], '; ') AS authors FROM candidates")
def _(s, d):
    return table(s, d, "candidates").select("cand_id", F.array_join(F.slice("authors", 1, 3), "; ").alias("authors"))


@query("r2_ordered_distinct", "SELECT doc_id, n FROM (SELECT doc_id, len(list_distinct(string_split(text, ' '))) AS n FROM documents WHERE text IS NOT NULL)")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.size(F.array_distinct(F.split("text", " "))).cast("long").alias("n"))


@query("r3_last_wins", "SELECT trim(bibcode) AS key, max(id) AS last, min(id) AS first FROM papers WHERE trim(bibcode) <> '' GROUP BY 1")
def _(s, d):
    g = table(s, d, "papers").where(nonblank(F.col("bibcode"))).groupBy(F.trim("bibcode").alias("key"))
    return g.agg(F.max_by("id", "id").alias("last"), F.min_by("id", "id").alias("first"))


@query("n3_json_rows", """SELECT id, '{"id":' || id || ',"source":"' || source || '"}' AS j FROM papers""")
def _(s, d):
    return table(s, d, "papers").select("id", F.to_json(F.struct("id", "source")).alias("j"))


@query("a17_usage", "SELECT source, sum(TRY_CAST(volume AS BIGINT)) AS total FROM candidates GROUP BY source")
def _(s, d):
    return table(s, d, "candidates").groupBy("source").agg(F.sum(F.col("volume").try_cast("long")).alias("total"))


@query("a22_batch_totals", "SELECT source, count(*) AS n, count(*) FILTER (trim(bibcode) <> '') AS resolved, round(avg(score), 6) AS mean FROM candidates GROUP BY source")
def _(s, d):
    return table(s, d, "candidates").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.trim("bibcode") != "").alias("resolved"), F.round(F.avg("score"), 6).alias("mean"))


@query("a11_nearest_of_paper", """
WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT label, round(min(1 - list_cosine_similarity(embedding::DOUBLE[], qv)), 6) AS distance FROM embeddings, q GROUP BY label""")
def _(s, d):
    e = table(s, d, "embeddings")
    one = F.broadcast(e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("qv")))
    return e.crossJoin(one).groupBy("label").agg(F.round(F.min(vectors.cosine_distance(F.col("embedding"), F.col("qv"))), 6).alias("distance"))


@query("w4_ordinals", "SELECT id, 'S' || row_number() OVER (PARTITION BY paper_id ORDER BY chunk_ord, id) AS tag FROM paper_chunks")
def _(s, d):
    return table(s, d, "paper_chunks").select("id", F.concat(F.lit("S"), F.row_number().over(Window.partitionBy("paper_id").orderBy("chunk_ord", "id"))).alias("tag"))


_HEADS = r"(?m)^\s*\d+(?:\.\d+)*\.?\s+(\p{Lu}[^\n.]{2,80})$"


@query("w11_heading_spans", "SELECT paper_id, char_start AS a, coalesce(lead(char_start) OVER (PARTITION BY paper_id ORDER BY char_start), 1000000000)::INT AS b FROM (SELECT DISTINCT paper_id, char_start FROM paper_chunks WHERE regexp_matches(text, '^[0-9]+[.][0-9]+ [A-Z]') AND char_start IS NOT NULL)")
def _(s, d):
    h = table(s, d, "paper_chunks").where(F.col("text").rlike(r"^[0-9]+[.][0-9]+ [A-Z]") & F.col("char_start").isNotNull()).select("paper_id", F.col("char_start").alias("a")).distinct()
    return h.select("paper_id", "a", F.lead("a", 1, 1_000_000_000).over(Window.partitionBy("paper_id").orderBy("a")).alias("b"))


@query("j13_section_of_position", """
WITH h AS (SELECT paper_id, a, coalesce(lead(a) OVER (PARTITION BY paper_id ORDER BY a), 1000000000) AS b FROM (SELECT DISTINCT paper_id, char_start AS a FROM paper_chunks WHERE regexp_matches(text, '^[0-9]+[.][0-9]+ [A-Z]') AND char_start IS NOT NULL))
SELECT c.id, h.a FROM paper_chunks c JOIN h ON h.paper_id = c.paper_id AND c.char_end >= h.a AND c.char_end < h.b""")
def _(s, d):
    c = table(s, d, "paper_chunks")
    h = c.where(F.col("text").rlike(r"^[0-9]+[.][0-9]+ [A-Z]") & F.col("char_start").isNotNull()).select("paper_id", F.col("char_start").alias("a")).distinct()
    h = h.select("paper_id", "a", F.lead("a", 1, 1_000_000_000).over(Window.partitionBy("paper_id").orderBy("a")).alias("b"))
    return c.select("id", "paper_id", "char_end").join(h, "paper_id").where("char_end >= a and char_end < b").select("id", "a")


@query("c3_journals", r"""
WITH j AS (SELECT ref_id, trim(regexp_replace(journal, '\s+', ' ', 'g')) AS s FROM parsed_references)
SELECT ref_id, CASE WHEN s <> '' THEN CASE replace(upper(s), '.', '') WHEN 'A&A' THEN 'A&A' WHEN 'AA' THEN 'A&A' WHEN 'APJ' THEN 'ApJ' WHEN 'MNRAS' THEN 'MNRAS' WHEN 'AJ' THEN 'AJ' WHEN 'NATURE' THEN 'Nature' WHEN 'SCIENCE' THEN 'Science' ELSE s END END AS journal FROM j""")
def _(s, d):
    return table(s, d, "parsed_references").select("ref_id", identifiers.canonical_journal(F.col("journal")).alias("journal"))


@query("c20_retrieval_query", "SELECT id, md5(substr(CASE WHEN trim(coalesce(abstract, '')) = '' THEN trim(title) ELSE trim(title) || chr(10) || chr(10) || trim(abstract) END, 1, 6000)) AS h FROM papers")
def _(s, d):
    return table(s, d, "papers").select("id", F.md5(identifiers.retrieval_query(F.col("title"), F.col("abstract"))).alias("h"))


@query("c23_json_answers", """SELECT id, '{"id": ' || id || '}' AS j FROM papers""")
def _(s, d):
    answer = F.concat(F.lit("<think>maybe {</think>\n```json\n"), F.lit('{"id": '), "id", F.lit("}\n```"))
    return table(s, d, "papers").select("id", identifiers.json_object(answer).alias("j"))


@query("c6_arxiv_in_context", rf"SELECT id, CASE WHEN regexp_matches({_STRIP.format('arxiv_id')}, '^[0-9]{{4}}[.][0-9]{{4,5}}$') THEN {_STRIP.format('arxiv_id')} END AS arxiv FROM papers WHERE {_NB.format('arxiv_id')}")
def _(s, d):
    t = F.concat(F.lit("see 1234.5678, and arXiv preprint no. "), identifiers.strip_arxiv_version(F.col("arxiv_id")), F.lit(" ok"))
    return table(s, d, "papers").where(nonblank(F.col("arxiv_id"))).select("id", identifiers.arxiv_with_context(t).alias("arxiv"))


@query("s30_lines", "SELECT ref_id, trim(raw) AS line FROM parsed_references WHERE trim(raw) <> '' AND NOT starts_with(trim(raw), '#')")
def _(s, d):
    return table(s, d, "parsed_references").select("ref_id", F.trim("raw").alias("line")).where("line <> '' and not startswith(line, '#')")


@query("g12_bibcode_of_arxiv", rf"""
WITH p AS (SELECT {_AX} AS a, max(trim(bibcode)) AS bibcode FROM papers WHERE {_NB.format('arxiv_id')} AND {_NB.format('bibcode')} GROUP BY 1)
SELECT cand_id, p.bibcode FROM candidates c JOIN p ON p.a = {_STRIP.format('c.arxiv_id')}""")
def _(s, d):
    p = table(s, d, "papers").where(nonblank(F.col("arxiv_id")) & nonblank(F.col("bibcode"))).groupBy(identifiers.strip_arxiv_version(F.col("arxiv_id")).alias("a")).agg(F.max(F.trim("bibcode")).alias("bibcode"))
    return table(s, d, "candidates").where("arxiv_id is not null").select("cand_id", identifiers.strip_arxiv_version(F.col("arxiv_id")).alias("a")).join(p, "a").select("cand_id", "bibcode")


@query("l6_doc_preference", "SELECT cand_id, row_number() OVER (PARTITION BY year ORDER BY contains(upper(coalesce(bibcode, '')), 'ARXIV')::INT, year DESC, bibcode, cand_id) AS pos FROM candidates")
def _(s, d):
    w = Window.partitionBy("year").orderBy(identifiers.is_eprint(F.coalesce("bibcode", F.lit(""))).cast("int"), F.desc("year"), F.col("bibcode").asc_nulls_last(), "cand_id")
    return table(s, d, "candidates").select("cand_id", F.row_number().over(w).alias("pos"))



