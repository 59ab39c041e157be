"""Scans, filters, joins, aggregations and windows over the library's tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lucerna.functions.text import nonblank
from lucerna.operators import mutate
from lucerna.operators.retrieval import first_of_union, top_per_group, within_budget
from lucerna.plans.base import query, table
from lucerna.runtime import small
from lucerna.streaming.monitor import keyword_labels

_NB = "({0} IS NOT NULL AND trim({0}) <> '')"


@query("f1_has_pdf", "SELECT id FROM papers WHERE pdf_relpath IS NOT NULL AND trim(pdf_relpath) <> ''")
def _(s, d):
    return table(s, d, "papers").where(nonblank(F.col("pdf_relpath"))).select("id")


@query("f2_has_arxiv", "SELECT id FROM papers WHERE arxiv_id IS NOT NULL AND trim(arxiv_id) <> ''")
def _(s, d):
    return table(s, d, "papers").where(nonblank(F.col("arxiv_id"))).select("id")


@query("f3_indexable", f"SELECT id FROM papers WHERE {_NB.format('source_text_relpath')} OR {_NB.format('pdf_relpath')} OR {_NB.format('arxiv_id')}")
def _(s, d):
    return table(s, d, "papers").where(nonblank(F.col("source_text_relpath")) | nonblank(F.col("pdf_relpath")) | nonblank(F.col("arxiv_id"))).select("id")


@query("f4_arxiv_no_tex", f"SELECT id FROM papers WHERE {_NB.format('arxiv_id')} AND coalesce(source_kind, '') <> 'tex'")
def _(s, d):
    return table(s, d, "papers").where(nonblank(F.col("arxiv_id")) & (F.coalesce("source_kind", F.lit("")) != "tex")).select("id")


@query("f6_arxiv_lookup", """
WITH r AS (SELECT cand_id, regexp_replace(regexp_replace(trim(arxiv_id), '(?i)^arxiv:\\s*', ''), '(?i)v[0-9]+$', '') AS k FROM candidates WHERE arxiv_id IS NOT NULL AND trim(arxiv_id) <> ''),
p AS (SELECT id, regexp_replace(regexp_replace(trim(arxiv_id), '(?i)^arxiv:\\s*', ''), '(?i)v[0-9]+$', '') AS k FROM papers WHERE arxiv_id IS NOT NULL AND trim(arxiv_id) <> '')
SELECT DISTINCT cand_id, id FROM r JOIN p USING (k)""")
def _(s, d):
    from lucerna.functions.identifiers import strip_arxiv_version

    k = lambda t, i: table(s, d, t).where(nonblank(F.col("arxiv_id"))).select(i, strip_arxiv_version(F.col("arxiv_id")).alias("k"))
    return k("candidates", "cand_id").join(k("papers", "id"), "k").select("cand_id", "id").distinct()


@query("f7_author_year", "SELECT id FROM papers WHERE authors_json ILIKE '%hohevutro%' AND published LIKE '20%'")
def _(s, d):
    return table(s, d, "papers").where(F.col("authors_json").ilike("%hohevutro%") & F.startswith(F.col("published"), F.lit("20"))).select("id")


@query("f8_local_pdf", """
WITH n AS (SELECT cand_id, trim(bibcode) AS b FROM candidates WHERE bibcode IS NOT NULL AND trim(bibcode) <> ''),
p AS (SELECT trim(bibcode) AS b, id, pdf_relpath FROM papers WHERE bibcode IS NOT NULL AND trim(bibcode) <> '' AND pdf_relpath IS NOT NULL AND trim(pdf_relpath) <> '')
SELECT cand_id, arg_min(pdf_relpath, id) AS pdf_relpath FROM n JOIN p USING (b) GROUP BY cand_id""")
def _(s, d):
    n = table(s, d, "candidates").where(nonblank(F.col("bibcode"))).select("cand_id", F.trim("bibcode").alias("b"))
    p = table(s, d, "papers").where(nonblank(F.col("bibcode")) & nonblank(F.col("pdf_relpath"))).select(F.trim("bibcode").alias("b"), "id", "pdf_relpath")
    return n.join(p, "b").groupBy("cand_id").agg(F.min_by("pdf_relpath", "id").alias("pdf_relpath"))


@query("f10_authors_nonempty", "SELECT id, len(from_json(CASE WHEN json_valid(authors_json) AND json_type(authors_json) = 'ARRAY' THEN authors_json ELSE '[]' END, '[\"VARCHAR\"]')) AS n_authors FROM papers")
def _(s, d):
    arr = F.coalesce(F.from_json("authors_json", "array<string>"), F.array().cast("array<string>"))
    return table(s, d, "papers").select("id", F.size(arr).cast("long").alias("n_authors"))


@query("f11_cutoff", "SELECT id, published FROM papers WHERE published >= '2015-01-01'")
def _(s, d):
    return table(s, d, "papers").where(F.col("published") >= "2015-01-01").select("id", "published")


_TOPICS = {"dynamical friction": "dynamics", "stellar feedback": "feedback", "late merger": "mergers", "mass segregation": "dynamics"}
_LABELS = "[x FOR x IN [" + ", ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{p}') THEN '{v}' END" for p, v in (("dynamical friction", "dynamics"), ("stellar feedback", "feedback"), ("late merger", "mergers"), ("mass segregation", "dynamics"))) + "] IF x IS NOT NULL]"


@query("f12_keywords", f"SELECT doc_id, array_to_string({_LABELS}, ',') AS labels FROM documents WHERE len({_LABELS}) > 0")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(keyword_labels(F.col("text"), _TOPICS), ",").alias("labels")).where("labels <> ''")


@query("j2_edges", """
WITH n AS (SELECT trim(bibcode) AS b, max(id) AS to_paper_id FROM papers WHERE bibcode IS NOT NULL AND trim(bibcode) <> '' GROUP BY 1),
e AS (SELECT DISTINCT from_paper_id, trim(ref_bibcode) AS ref_bibcode FROM paper_references WHERE ref_bibcode IS NOT NULL AND trim(ref_bibcode) <> '')
SELECT e.from_paper_id, e.ref_bibcode, n.to_paper_id, n.to_paper_id IS NOT NULL AS in_library FROM e LEFT JOIN n ON e.ref_bibcode = n.b""")
def _(s, d):
    from lucerna.operators.graph import resolve_edges

    return resolve_edges(table(s, d, "paper_references"), table(s, d, "papers")).select("from_paper_id", "ref_bibcode", "to_paper_id", "in_library")


@query("j4_papers_without_edges", f"SELECT id FROM papers p WHERE ({_NB.format('bibcode')} OR {_NB.format('arxiv_id')}) AND NOT EXISTS (SELECT 1 FROM paper_references r WHERE r.from_paper_id = p.id)")
def _(s, d):
    return table(s, d, "papers").where(nonblank(F.col("bibcode")) | nonblank(F.col("arxiv_id"))).select("id").join(table(s, d, "paper_references").select(F.col("from_paper_id").alias("id")), "id", "left_anti")


@query("j5_pdf_without_chunks", f"SELECT id FROM papers p WHERE {_NB.format('pdf_relpath')} AND NOT EXISTS (SELECT 1 FROM paper_chunks c WHERE c.paper_id = p.id)")
def _(s, d):
    return table(s, d, "papers").where(nonblank(F.col("pdf_relpath"))).select("id").join(table(s, d, "paper_chunks").select(F.col("paper_id").alias("id")), "id", "left_anti")


@query("j7_papers_with_chunks", "SELECT count(DISTINCT p.id) AS n FROM papers p JOIN paper_chunks c ON c.paper_id = p.id")
def _(s, d):
    return table(s, d, "papers").select("id").join(table(s, d, "paper_chunks").select(F.col("paper_id").alias("id")), "id", "left_semi").agg(F.countDistinct("id").alias("n"))


@query("j10_references_of_papers", """
WITH e AS (SELECT DISTINCT from_paper_id, trim(ref_bibcode) AS b FROM paper_references WHERE trim(ref_bibcode) <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY from_paper_id ORDER BY b) AS n FROM e)
SELECT from_paper_id AS paper_id, string_agg(b, ' ' ORDER BY b) AS refs, count(*) AS n FROM r WHERE n <= 30 GROUP BY 1""")
def _(s, d):
    e = table(s, d, "paper_references").select("from_paper_id", F.trim("ref_bibcode").alias("b")).where("b <> ''").distinct()
    top = top_per_group(e, ["from_paper_id"], [F.col("b")], 30)
    return top.groupBy(F.col("from_paper_id").alias("paper_id")).agg(F.array_join(F.array_sort(F.collect_list("b")), " ").alias("refs"), F.count("*").alias("n"))


_HEAD = "([0-9]+[.][0-9]+ [A-Z][a-z]+( [a-z]+)*)"


@query("j11_section_of_chunk", rf"""
WITH h AS (SELECT paper_id, char_start AS pos, id, regexp_extract(text, '^{_HEAD}', 1) AS title FROM paper_chunks),
m AS (SELECT paper_id, pos, max(title) AS title FROM h WHERE title <> '' GROUP BY 1, 2)
SELECT c.id, m.title AS section FROM paper_chunks c ASOF LEFT JOIN m ON m.paper_id = c.paper_id AND c.char_start >= m.pos""")
def _(s, d):
    c = table(s, d, "paper_chunks").select("id", "paper_id", F.col("char_start").alias("pos"), F.nullif(F.regexp_extract("text", f"^{_HEAD}", 1), F.lit("")).alias("title"))
    heads = c.where("title is not null").groupBy("paper_id", "pos").agg(F.max("title").alias("title")).select("paper_id", "pos", F.lit(None).cast("long").alias("id"), "title", F.lit(0).alias("k"))
    both = heads.unionByName(c.select("paper_id", "pos", "id", F.lit(None).cast("string").alias("title"), F.lit(1).alias("k")))
    w = Window.partitionBy("paper_id").orderBy("pos", "k", "id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("section", F.last("title", ignorenulls=True).over(w)).where("k = 1").select("id", "section")


@query("j12_page_of_chunk", """
WITH c AS (SELECT k.id, k.paper_id, k.char_start, k.text FROM paper_chunks k JOIN papers p ON p.id = k.paper_id WHERE p.source_kind = 'pdf'),
b AS (SELECT DISTINCT paper_id, pos FROM (SELECT paper_id, char_start + i - 1 AS pos, substring(text, i, 1) AS x FROM (SELECT *, unnest(generate_series(1, length(text))) AS i FROM c WHERE contains(text, chr(12)))) WHERE x = chr(12))
SELECT id, (SELECT count(*) FROM b WHERE b.paper_id = c.paper_id AND pos <= char_start) + 1 AS page FROM c WHERE char_start IS NOT NULL AND paper_id IN (SELECT paper_id FROM b)""")
def _(s, d):
    # the whole text of a source is what its chunks hold at their places; a page break in an overlap is one break
    pdf = table(s, d, "papers").where("source_kind = 'pdf'").select(F.col("id").alias("paper_id"))
    c = table(s, d, "paper_chunks").select("id", "paper_id", F.col("char_start").cast("long").alias("pos"), "text").where("pos is not null").join(pdf, "paper_id", "left_semi")
    at = F.filter(F.sequence(F.lit(1), F.length("text")), lambda i: F.substring(F.col("text"), i, F.lit(1)) == "\f")
    breaks = c.where(F.contains("text", F.lit("\f"))).select("paper_id", F.explode(F.transform(at, lambda i: F.col("pos") + i - 1)).alias("pos")).distinct()
    both = breaks.select("paper_id", "pos", F.lit(None).cast("long").alias("id"), F.lit(0).alias("k")).unionByName(c.select("paper_id", "pos", "id", F.lit(1).alias("k")).join(breaks.select("paper_id").distinct(), "paper_id", "left_semi"))
    w = Window.partitionBy("paper_id").orderBy("pos", "k", "id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("page", F.sum(1 - F.col("k")).over(w) + 1).where("k = 1").select("id", "page")


@query("j14_reference_to_candidate", """
WITH r AS (SELECT ref_id, lower(first_author) AS a, substr(year, 1, 4) AS y, row_number() OVER (PARTITION BY lower(first_author), substr(year, 1, 4) ORDER BY ref_id) AS n FROM parsed_references WHERE first_author IS NOT NULL AND year IS NOT NULL),
c AS (SELECT cand_id, a, y, row_number() OVER (PARTITION BY a, y ORDER BY cand_id) AS n FROM (SELECT cand_id, lower(split_part(authors[1], ',', 1)) AS a, substr(year, 1, 4) AS y FROM candidates WHERE len(authors) > 0 AND year IS NOT NULL))
SELECT ref_id, cand_id FROM r JOIN c USING (a, y, n)""")
def _(s, d):
    # the first unused candidate of a key: the n-th reference of the key gets its n-th candidate
    r = table(s, d, "parsed_references").where("first_author is not null and year is not null").select("ref_id", F.lower("first_author").alias("a"), F.substring("year", 1, 4).alias("y"))
    c = table(s, d, "candidates").where("size(authors) > 0 and year is not null").select("cand_id", F.lower(F.split(F.col("authors")[0], ",")[0]).alias("a"), F.substring("year", 1, 4).alias("y"))
    nth = lambda df, i: df.withColumn("n", F.row_number().over(Window.partitionBy("a", "y").orderBy(i)))
    return nth(r, "ref_id").join(nth(c, "cand_id"), ["a", "y", "n"]).select("ref_id", "cand_id")


@query("a1_stats", "SELECT count(*) AS papers, max(updated_at) AS last_update FROM papers")
def _(s, d):
    return table(s, d, "papers").agg(F.count("*").alias("papers"), F.max("updated_at").alias("last_update"))


@query("a2_status", f"""
SELECT (SELECT count(*) FROM papers) AS papers, (SELECT count(*) FROM papers WHERE {_NB.format('pdf_relpath')}) AS with_pdf, (SELECT count(*) FROM papers WHERE source_kind = 'tex') AS with_tex,
(SELECT count(*) FROM paper_chunks) AS chunks, (SELECT count(DISTINCT paper_id) FROM paper_chunks) AS indexed, (SELECT count(*) FROM paper_references) AS edges""")
def _(s, d):
    p = table(s, d, "papers").agg(F.count("*").alias("papers"), F.count_if(nonblank(F.col("pdf_relpath"))).alias("with_pdf"), F.count_if(F.col("source_kind") == "tex").alias("with_tex"))
    c = table(s, d, "paper_chunks").agg(F.count("*").alias("chunks"), F.countDistinct("paper_id").alias("indexed"))
    return p.crossJoin(c).crossJoin(table(s, d, "paper_references").agg(F.count("*").alias("edges")))


@query("a3_chunk_counts", "SELECT paper_id, count(*) AS n, sum(length(text)) AS chars FROM paper_chunks GROUP BY paper_id")
def _(s, d):
    return table(s, d, "paper_chunks").groupBy("paper_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("a5_duplicate_bibcodes", "SELECT upper(trim(bibcode)) AS key, count(*) AS n, min(id) AS first_id FROM papers WHERE bibcode IS NOT NULL AND trim(bibcode) <> '' GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return table(s, d, "papers").where(nonblank(F.col("bibcode"))).groupBy(F.upper(F.trim("bibcode")).alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


@query("a8_cache_histogram", """
SELECT 'category' AS kind, c AS key, count(*) AS n FROM (SELECT unnest(categories) AS c FROM papers) GROUP BY c
UNION ALL SELECT 'keyword', c, count(*) FROM (SELECT unnest(matched_keywords) AS c FROM papers) GROUP BY c
UNION ALL SELECT 'range', coalesce(min(published), '') || '..' || coalesce(max(published), ''), count(*) FROM papers""")
def _(s, d):
    p = table(s, d, "papers")
    hist = lambda kind, c: p.select(F.explode(c).alias("key")).groupBy("key").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    span = p.agg(F.concat(F.coalesce(F.min("published"), F.lit("")), F.lit(".."), F.coalesce(F.max("published"), F.lit(""))).alias("key"), F.count("*").alias("n")).select(F.lit("range").alias("kind"), "key", "n")
    return hist("category", "categories").unionByName(hist("keyword", "matched_keywords")).unionByName(span)


@query("a19_merge_by_id", """
SELECT arxiv_id, string_agg(DISTINCT c, ',' ORDER BY c) AS categories, count(DISTINCT id) AS rows_merged FROM (SELECT id, arxiv_id, unnest(categories) AS c FROM papers WHERE arxiv_id IS NOT NULL AND trim(arxiv_id) <> '') GROUP BY arxiv_id""")
def _(s, d):
    x = table(s, d, "papers").where(nonblank(F.col("arxiv_id"))).select("id", "arxiv_id", F.explode("categories").alias("c"))
    return x.groupBy("arxiv_id").agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias("categories"), F.countDistinct("id").alias("rows_merged"))


@query("w2_top_chunks", "SELECT paper_id, id, n FROM (SELECT paper_id, id, row_number() OVER (PARTITION BY paper_id ORDER BY length(text) DESC, id) AS n FROM paper_chunks) WHERE n <= 3")
def _(s, d):
    w = Window.partitionBy("paper_id").orderBy(F.length("text").desc(), "id")
    return table(s, d, "paper_chunks").withColumn("n", F.row_number().over(w)).where("n <= 3").select("paper_id", "id", "n")


@query("w3_first_chunk", "SELECT paper_id, arg_min(id, chunk_ord * 10000000000 + id) AS first_id FROM paper_chunks GROUP BY paper_id")
def _(s, d):
    return table(s, d, "paper_chunks").groupBy("paper_id").agg(F.min_by("id", F.struct("chunk_ord", "id")).alias("first_id"))


@query("w5_budget", """
SELECT paper_id, id, used FROM (SELECT paper_id, id, sum(length(text) + 2) OVER (PARTITION BY paper_id ORDER BY chunk_ord, id ROWS UNBOUNDED PRECEDING) AS used,
row_number() OVER (PARTITION BY paper_id ORDER BY chunk_ord, id) AS rn FROM paper_chunks) WHERE used <= 4000 OR rn = 1""")
def _(s, d):
    return within_budget(table(s, d, "paper_chunks"), ["paper_id"], [F.col("chunk_ord"), F.col("id")], F.length("text"), 4000, 2).select("paper_id", "id", "used")


@query("w8_best_candidate", """
SELECT source, bibcode, cand_id, score FROM (SELECT source, bibcode, cand_id, score, row_number() OVER (PARTITION BY source, bibcode ORDER BY score DESC, cand_id) AS n FROM candidates WHERE bibcode IS NOT NULL) WHERE n = 1""")
def _(s, d):
    return top_per_group(table(s, d, "candidates").where("bibcode is not null"), ["source", "bibcode"], [F.desc("score"), F.col("cand_id")]).select("source", "bibcode", "cand_id", "score")


@query("l5_candidate_order", "SELECT cand_id, row_number() OVER (ORDER BY (source <> 'ads')::int, score DESC, coalesce(year, ''), cand_id) AS pos FROM candidates ORDER BY pos LIMIT 50")
def _(s, d):
    order = [(F.col("source") != "ads").cast("int"), F.desc("score"), F.coalesce("year", F.lit("")), F.col("cand_id")]
    top = table(s, d, "candidates").orderBy(*order).limit(50)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order))).select("cand_id", "pos")


@query("l9_newest", "SELECT id, published FROM papers WHERE published IS NOT NULL ORDER BY published DESC, id LIMIT 200")
def _(s, d):
    return table(s, d, "papers").where("published is not null").orderBy(F.desc("published"), "id").limit(200).select("id", "published")


@query("u1_first_of_union", """
WITH u AS (SELECT id, 0 AS q, 1 AS rank FROM paper_chunks WHERE contains(lower(text), 'dynamical friction') UNION ALL SELECT id, 1, 1 FROM paper_chunks WHERE contains(lower(text), 'stellar feedback'))
SELECT id, min(q) AS q, count(*) - 1 AS dropped FROM u GROUP BY id""")
def _(s, d):
    c = table(s, d, "paper_chunks").select("id", F.lower("text").alias("t"))
    u = c.where(F.contains("t", F.lit("dynamical friction"))).select("id", F.lit(0).alias("q")).unionByName(c.where(F.contains("t", F.lit("stellar feedback"))).select("id", F.lit(1).alias("q")))
    return first_of_union(u.withColumn("dropped", F.count("*").over(Window.partitionBy("id")) - 1), ["id"], [F.col("q")])


@query("u2_insert_or_ignore", "SELECT DISTINCT from_paper_id, trim(ref_bibcode) AS ref_bibcode FROM paper_references WHERE trim(ref_bibcode) <> '' UNION SELECT id, 'added' FROM papers WHERE id % 2 = 0")
def _(s, d):
    new = table(s, d, "papers").where("id % 2 = 0").select(F.col("id").alias("from_paper_id"), F.lit("added").alias("ref_bibcode"))
    old = table(s, d, "paper_references").select("from_paper_id", F.trim("ref_bibcode").alias("ref_bibcode")).where("ref_bibcode <> ''")
    return old.unionByName(new).distinct()


@query("k1_upsert", """
WITH n AS (SELECT bibcode, title, year || '-01-01' AS published FROM (SELECT *, row_number() OVER (PARTITION BY bibcode ORDER BY cand_id) AS k FROM candidates WHERE bibcode IS NOT NULL AND trim(bibcode) <> '') WHERE k = 1),
h AS (SELECT p.id, n.title, n.published FROM papers p JOIN n ON n.bibcode = p.bibcode QUALIFY p.id = min(p.id) OVER (PARTITION BY n.bibcode)),
m AS (SELECT max(id) AS top FROM papers)
SELECT p.id, p.bibcode, CASE WHEN h.id IS NULL THEN p.title ELSE h.title END AS title, coalesce(h.published, p.published) AS published FROM papers p LEFT JOIN h USING (id)
UNION ALL SELECT m.top + row_number() OVER (ORDER BY n.bibcode), n.bibcode, n.title, n.published FROM n, m WHERE NOT EXISTS (SELECT 1 FROM papers p WHERE p.bibcode = n.bibcode)""")
def _(s, d):
    c = top_per_group(table(s, d, "candidates").where(nonblank(F.col("bibcode"))), ["bibcode"], [F.col("cand_id")])
    none = F.lit(None).cast("string")
    new = c.select(none.alias("arxiv_id"), "bibcode", "title", F.lit("").alias("abstract"), F.concat("year", F.lit("-01-01")).alias("published"), "source", none.alias("pdf_relpath"), F.lit("2026-01-01").cast("timestamp").alias("at"))
    return mutate.upsert_papers(table(s, d, "papers"), new).select("id", "bibcode", "title", "published")


@query("k6_replace_references", """
WITH n AS (SELECT id AS from_paper_id, bibcode AS ref_bibcode FROM papers WHERE published >= '2015-01-01' AND bibcode IS NOT NULL)
SELECT from_paper_id, ref_bibcode FROM paper_references WHERE from_paper_id NOT IN (SELECT from_paper_id FROM n) UNION ALL SELECT DISTINCT from_paper_id, trim(ref_bibcode) FROM n WHERE trim(ref_bibcode) <> ''""")
def _(s, d):
    new = table(s, d, "papers").where("published >= '2015-01-01' and bibcode is not null").select(F.col("id").alias("from_paper_id"), F.col("bibcode").alias("ref_bibcode"))
    return mutate.replace_references(table(s, d, "paper_references"), new)


@query("k7_patch", "SELECT id, CASE WHEN source = 'ads' THEN NULL ELSE source_backend END AS source_backend, CASE WHEN source = 'ads' THEN 'tex' ELSE source_kind END AS source_kind FROM papers")
def _(s, d):
    p = table(s, d, "papers")
    delta = p.where("source = 'ads'").select("id", F.lit("tex").alias("source_kind"))
    return mutate.patch(p.select("id", "source_kind", "source_backend"), delta, "id", ("source_backend",)).select("id", "source_backend", "source_kind")


@query("k12_metric_pivot", "SELECT source, count(*) FILTER (reason = 'author+year') AS author_year, count(*) FILTER (reason = 'journal+volume+page') AS journal_volume_page, count(*) FILTER (reason = 'title overlap') AS title_overlap FROM candidates GROUP BY source")
def _(s, d):
    c = table(s, d, "candidates").withColumn("reason", F.regexp_replace("reason", "[^A-Za-z0-9]+", "_"))
    keys = sorted(r["reason"] for r in small(c.select("reason").where("reason is not null").distinct(), 1000).collect())  # columns of a table: checked
    return c.groupBy("source").pivot("reason", keys).count().fillna(0)
