"""Resolution of lines and documents, candidate scores, reference lines and chains."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lucerna.functions import documents, identifiers, references
from lucerna.functions.text import nonblank
from lucerna.operators import bm25, graph, resolve, retrieval
from lucerna.plans.base import query, table
from lucerna.plans.graphs import _E, _N

_AX = r"lower(regexp_replace(regexp_replace(trim({0}), '(?i)^arxiv:\s*', ''), '(?i)v[0-9]+$', ''))"
_KIND = r"""CASE WHEN regexp_full_match(s, '(19|20)[0-9]{2}[A-Za-z&.]{5}[A-Za-z0-9.]{4}[A-Za-z.][A-Za-z0-9.]{4}[A-Z]') THEN 'bibcode' WHEN regexp_matches(s, '(?i)^(doi:\s*|https?://(dx\.)?doi\.org/)?10\.[0-9]{4,}/\S+$') THEN 'doi'
WHEN regexp_matches(s, '(?i)^(arxiv:\s*)?([0-9]{4}\.[0-9]{4,5}|[a-z\-]+(\.[a-z]{2})?/[0-9]{7})(v[0-9]+)?$') THEN 'arxiv' ELSE 'text' END"""


def _lines(s, d):
    return table(s, d, "candidates").select(F.col("cand_id").alias("line_id"), F.coalesce("bibcode", F.concat(F.lit("arXiv:"), identifiers.strip_arxiv_version(F.col("arxiv_id"))), "title").alias("line"))


@query("p2_catalog_lines", rf"""
WITH l AS (SELECT cand_id AS line_id, trim(coalesce(bibcode, 'arXiv:' || regexp_replace(regexp_replace(trim(arxiv_id), '(?i)^arxiv:\s*', ''), '(?i)v[0-9]+$', ''), title)) AS s FROM candidates), k AS (SELECT line_id, s, {_KIND} AS kind FROM l),
b AS (SELECT DISTINCT trim(bibcode) AS bib FROM papers WHERE trim(bibcode) <> ''), a AS (SELECT {_AX.format('arxiv_id')} AS ax, arg_max(trim(coalesce(bibcode, '')), id) AS bc FROM papers WHERE trim(arxiv_id) <> '' GROUP BY 1)
SELECT line_id, kind, coalesce(CASE WHEN kind = 'bibcode' THEN b.bib END, nullif(a.bc, '')) AS bibcode FROM k LEFT JOIN b ON b.bib = k.s AND kind = 'bibcode' LEFT JOIN a ON kind = 'arxiv' AND a.ax = {_AX.format('k.s')} WHERE kind <> 'text'""")
def _(s, d):
    return resolve.parse_lines(_lines(s, d), table(s, d, "papers")).where("kind <> 'text'").select("line_id", "kind", "bibcode")


@query("p2_author_year_lines", r"""
WITH w AS (SELECT DISTINCT id, y, unnest(regexp_extract_all(lower(n), '[\p{L}''’-]{2,}')) AS w FROM (SELECT id, substr(published, 1, 4) AS y, unnest(from_json(CASE WHEN json_valid(authors_json) AND json_type(authors_json) = 'ARRAY' THEN authors_json ELSE '[]' END, '["VARCHAR"]')) AS n FROM papers WHERE published IS NOT NULL)),
k AS (SELECT w, y, count(*) AS n, min(id) AS id FROM w GROUP BY 1, 2)
SELECT ref_id AS line_id, n, id FROM parsed_references r JOIN k ON k.w = lower(r.first_author) AND k.y = substr(r.year, 1, 4)""")
def _(s, d):
    lines = table(s, d, "parsed_references").select(F.col("ref_id").alias("line_id"), F.col("first_author").alias("author"), "year")
    return resolve.author_year_hits(lines, table(s, d, "papers"))


@query("p3_fragments", rf"""
WITH l AS (SELECT cand_id AS line_id, {_AX.format('arxiv_id')} AS ax FROM candidates WHERE regexp_matches({_AX.format('arxiv_id')}, '^[0-9]{{4}}\.[0-9]{{4,5}}$')), a AS (SELECT {_AX.format('arxiv_id')} AS ax, arg_max(trim(coalesce(bibcode, '')), id) AS bc FROM papers WHERE trim(arxiv_id) <> '' GROUP BY 1)
SELECT line_id, nullif(bc, '') AS bibcode, CASE WHEN nullif(bc, '') IS NULL THEN 'ask_arxiv' ELSE 'database' END AS note FROM l LEFT JOIN a USING (ax)""")
def _(s, d):
    ax = F.lower(identifiers.strip_arxiv_version(F.col("arxiv_id")))
    lines = table(s, d, "candidates").where(ax.rlike(r"^\d{4}\.\d{4,5}$")).select(F.col("cand_id").alias("line_id"), F.concat(F.lit("Someone et al., see arXiv:"), ax, F.lit(" for more")).alias("line"))
    return resolve.parse_fragments(lines, table(s, d, "papers")).select("line_id", "bibcode", "note")


@query("t13_identifier_tiers", rf"""
WITH q AS (SELECT cand_id AS query_id, trim(coalesce(bibcode, 'arXiv:' || {_AX.format('arxiv_id')})) AS s FROM candidates WHERE coalesce(bibcode, arxiv_id) IS NOT NULL), k AS (SELECT query_id, s, {_KIND} AS kind FROM q),
h AS (SELECT query_id, id, 1 AS tier FROM k JOIN papers p ON kind = 'bibcode' AND trim(p.bibcode) = s UNION SELECT query_id, id, 2 FROM k JOIN papers p ON kind = 'arxiv' AND trim(p.arxiv_id) <> '' AND {_AX.format('p.arxiv_id')} = {_AX.format('s')})
SELECT query_id, id, tier FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 15""")
def _(s, d):
    q = table(s, d, "candidates").where("coalesce(bibcode, arxiv_id) is not null").select(F.col("cand_id").alias("query_id"), F.coalesce("bibcode", F.concat(F.lit("arXiv:"), F.lower(identifiers.strip_arxiv_version(F.col("arxiv_id"))))).alias("q"))
    return resolve.local_search(q, table(s, d, "papers")).where("tier <= 2")


@query("t13_word_tiers")
def _(s, d):
    return resolve.local_search(table(s, d, "candidates").where("cand_id % 50 = 0").select(F.col("cand_id").alias("query_id"), F.col("title").alias("q")), table(s, d, "papers"))


@query("t14_local_then_remote")
def _(s, d):
    q = table(s, d, "candidates").where("cand_id % 50 = 0").select(F.col("cand_id").alias("query_id"), F.col("title").alias("q"))
    got = resolve.local_search(q, table(s, d, "papers")).groupBy("query_id").agg(F.count("*").alias("n"))
    return q.select("query_id").join(got, "query_id", "left").select("query_id", F.when(F.col("n").isNull(), "remote").otherwise("local").alias("provenance"))


@query("m2_candidate_scores", """
WITH p AS (SELECT r.ref_id, c.cand_id, c.score + CASE WHEN r.year <> '' AND r.year = coalesce(c.year, '') THEN 20 ELSE 0 END + CASE WHEN r.volume <> '' AND r.volume = coalesce(c.volume, '') THEN 15 ELSE 0 END + CASE WHEN coalesce(r.page, '') <> '' AND upper(r.page) = upper(coalesce(c.page, '')) THEN 20 ELSE 0 END
+ CASE WHEN r.journal <> '' AND c.journal <> '' AND contains(lower(c.journal), lower(r.journal)) THEN 15 ELSE 0 END AS score FROM parsed_references r JOIN candidates c ON r.volume = c.volume AND r.year = c.year)
SELECT ref_id, cand_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, cand_id) AS n FROM p) WHERE n = 1""")
def _(s, d):
    r = table(s, d, "parsed_references").select("ref_id", *[F.col(c).alias(f"r_{c}") for c in ("year", "volume", "page", "journal")])
    c = table(s, d, "candidates")
    pairs = r.join(c, (F.col("r_volume") == c.volume) & (F.col("r_year") == c.year))
    pair = lambda x: (F.col(f"r_{x}"), F.col(x))
    none = F.lit(None).cast("string")
    scored = pairs.select("ref_id", "cand_id", (F.col("score") + documents.bonus(pair("year"), pair("volume"), pair("page"), (none, none), pair("journal"))).alias("score"))
    return retrieval.top_per_group(scored, ["ref_id"], [F.desc("score"), F.col("cand_id")]).select("ref_id", "cand_id", F.round("score", 6).alias("score"))


@query("c25_query_ladder", r"""
WITH f AS (SELECT ref_id, CASE WHEN first_author <> '' THEN 'author:"' || first_author || '"' END AS a, CASE WHEN year <> '' THEN 'year:' || year END AS y, CASE WHEN volume <> '' THEN 'volume:' || volume END AS v, CASE WHEN page <> '' THEN '(page:' || page || ' OR eid:' || page || ')' END AS p, CASE WHEN issue <> '' THEN 'issue:' || issue END AS i, CASE WHEN journal <> '' THEN 'pub:"' || journal || '"' END AS j FROM parsed_references),
x AS (SELECT ref_id, unnest([[a, y, j, v, p, i], [a, y, v, p, i], [a, y, v, i], [a, y, j, v], [a, y, v], [a, y, j], [a, y]]) AS parts FROM f),
z AS (SELECT ref_id, [t FOR t IN parts IF t IS NOT NULL] AS t FROM x)
SELECT ref_id, count(DISTINCT array_to_string(t, ' AND ')) AS n FROM z WHERE len(t) >= 2 GROUP BY 1""")
def _(s, d):
    none = F.lit(None).cast("string")
    ladder = documents.query_ladder(F.col("first_author"), F.col("year"), F.col("journal"), none, F.col("volume"), F.col("page"), F.col("issue"), none)
    strict = F.filter(ladder, lambda x: F.contains(x, F.lit(":")) & (F.contains(x, F.lit(" AND "))))
    return table(s, d, "parsed_references").select("ref_id", F.size(strict).cast("long").alias("n")).where("n > 0")


@query("c21_title_similarity")
def _(s, d):
    c = table(s, d, "candidates").where(nonblank(F.col("bibcode"))).select("cand_id", F.trim("bibcode").alias("b"), F.col("title").alias("t"))
    p = table(s, d, "papers").where(nonblank(F.col("bibcode"))).select("id", F.trim("bibcode").alias("b"), "title")
    return p.join(c, "b").select("id", "cand_id", F.round(documents.similarity(F.col("title"), F.col("t")), 6).alias("ratio"))


_HIT = r"""SELECT id, unnest(regexp_extract_all(t, '(\p{Lu}[\p{L}''’-]+) et al\.?,? \(?((?:19|20)[0-9]{2})', 1)) AS a, unnest(regexp_extract_all(t, '(\p{Lu}[\p{L}''’-]+) et al\.?,? \(?((?:19|20)[0-9]{2})', 2)) AS y FROM h"""


def _first_texts(s, d):
    c = table(s, d, "paper_chunks")
    return retrieval.top_per_group(c, ["paper_id"], [F.col("chunk_ord"), F.col("id")]).select("paper_id", "text")


_M3 = rf"""
WITH h AS (SELECT paper_id AS id, text AS t FROM paper_chunks QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY chunk_ord, id) = 1),
l AS (SELECT r.ref_id, r.raw AS line, lower(r.raw) AS low, h.id, lower(regexp_replace(h.t, '\s+', ' ', 'g')) AS hay FROM parsed_references r JOIN h ON h.id = r.paper_id WHERE r.raw IS NOT NULL),
c AS (SELECT DISTINCT id, a, y FROM ({_HIT})),
e AS (SELECT l.ref_id, sum(CASE WHEN NOT contains(line, y) THEN 0 WHEN regexp_matches(low, '(^|[^a-z])' || lower(a) || '($|[^a-z])') THEN 25 WHEN regexp_matches(hay, '(^|[^a-z])' || lower(a) || '($|[^a-z])') THEN 10 ELSE 0 END) AS p FROM l JOIN c USING (id) GROUP BY 1),
y AS (SELECT ref_id, 3 * len([x FOR x IN regexp_extract_all(line, '\b((?:19|20)[0-9]{{2}})\b', 1) IF contains(hay, x)]) AS p FROM l),
n AS (SELECT ref_id, hay, unnest(regexp_extract_all(trim(split_part(line, ',', 1)), '[A-Za-z][A-Za-z''`\-]{{2,}}')) AS w FROM l),
g AS (SELECT ref_id, 2 * count(*) AS p FROM n WHERE lower(w) NOT IN ('the', 'and', 'for', 'von', 'van', 'der', 'los', 'las') AND regexp_matches(hay, '(^|[^a-z])' || lower(w) || '($|[^a-z])') GROUP BY 1)
SELECT l.ref_id, (coalesce(e.p, 0) + y.p + coalesce(g.p, 0))::BIGINT AS score FROM l LEFT JOIN e USING (ref_id) JOIN y USING (ref_id) LEFT JOIN g USING (ref_id)"""


@query("m3_line_scores", _M3)
def _(s, d):
    return _scored(s, d).select("ref_id", F.col("score").cast("long").alias("score"))


def _scored(s, d):
    hay = _first_texts(s, d).select("paper_id", F.lower(F.regexp_replace("text", r"\s+", " ")).alias("hay"), _hits(F.col("text")).alias("hits"))
    lines = table(s, d, "parsed_references").where("raw is not null").select("ref_id", "paper_id", "raw")
    return lines.join(hay, "paper_id").select("ref_id", "paper_id", "raw", documents.line_score(F.col("raw"), F.col("hits"), F.col("hay")).alias("score"))


def _hits(c):
    p = references.CITED[0].replace(r"\b(", "(", 1)
    names, years = F.regexp_extract_all(c, F.lit(p), F.lit(1)), F.regexp_extract_all(c, F.lit(p), F.lit(2))
    return F.array_distinct(F.zip_with(names, years, lambda a, y: F.concat(a, F.lit("|"), y)))


@query("l7_best_lines", f"SELECT paper_id, ref_id, score FROM ({_M3}) JOIN parsed_references r USING (ref_id) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, ref_id) <= 8")
def _(s, d):
    return retrieval.top_per_group(_scored(s, d).where("score > 0"), ["paper_id"], [F.desc("score"), F.col("ref_id")], 8).select("paper_id", "ref_id", F.col("score").cast("long").alias("score"))


@query("l8_narrowed_lines", f"""WITH z AS (SELECT paper_id, ref_id, score, count(*) OVER (PARTITION BY paper_id) AS size, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, ref_id) AS k FROM ({_M3}) JOIN parsed_references r USING (ref_id)),
o AS (SELECT paper_id, ref_id, size, row_number() OVER (PARTITION BY paper_id ORDER BY CASE WHEN size <= 3 OR (k <= 2 AND score > 0) THEN 0 ELSE 1 END, CASE WHEN size <= 3 OR (k <= 2 AND score > 0) THEN ref_id ELSE k END) AS pos FROM z) SELECT paper_id, ref_id, pos FROM o WHERE size <= 3 OR pos <= 5""")
def _(s, d):
    return resolve.narrowed(_scored(s, d), "paper_id", "ref_id", "score", above=3, most=5, must=2).select("paper_id", "ref_id", "pos")


@query("l11_follow_cut", "SELECT from_paper_id, array_to_string(list_sort(list(DISTINCT trim(ref_bibcode)))[1:5], ' ') AS follow FROM paper_references WHERE trim(ref_bibcode) <> '' GROUP BY 1")
def _(s, d):
    e = table(s, d, "paper_references").select("from_paper_id", F.trim("ref_bibcode").alias("b")).where("b <> ''").distinct()
    top = retrieval.top_per_group(e, ["from_paper_id"], [F.col("b")], 5)
    return top.groupBy("from_paper_id").agg(F.array_join(F.array_sort(F.collect_list("b")), " ").alias("follow"))


@query("j15_refs_by_doi", "SELECT c.cand_id, e.cand_id AS other FROM candidates c JOIN candidates e ON lower(trim(c.doi)) = lower(trim(e.doi)) AND c.source <> e.source")
def _(s, d):
    k = lambda i, sc: table(s, d, "candidates").select(F.col("cand_id").alias(i), F.lower(F.trim("doi")).alias("doi"), F.col("source").alias(sc))
    return k("cand_id", "s1").join(k("other", "s2"), "doi").where("s1 <> s2").select("cand_id", "other")


@query("a15_category_lists", """
WITH k AS (SELECT reason, cand_id FROM candidates) SELECT reason AS category, count(*) AS n, string_agg(cand_id::VARCHAR, ' ' ORDER BY cand_id) FILTER (r <= 5) AS first_refs FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY cand_id) AS r FROM k) GROUP BY reason""")
def _(s, d):
    c = table(s, d, "candidates").select(F.col("reason").alias("category"), "cand_id")
    top = c.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy("cand_id"))).where("r <= 5")
    lists = top.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list("cand_id")), lambda x: x.cast("string")), " ").alias("first_refs"))
    counts = c.groupBy("category").agg(F.count("*").alias("n"))
    return counts.join(lists, counts.category.eqNullSafe(lists.category)).select(counts.category, "n", "first_refs")


@query("a16_reference_totals", "SELECT count(*) AS refs, count(*) FILTER (EXISTS (SELECT 1 FROM papers p WHERE trim(p.bibcode) = trim(r.ref_bibcode))) AS resolved, count(DISTINCT from_paper_id) AS sources FROM paper_references r")
def _(s, d):
    e = table(s, d, "paper_references").select("from_paper_id", F.trim("ref_bibcode").alias("b"))
    have = table(s, d, "papers").where(nonblank(F.col("bibcode"))).select(F.trim("bibcode").alias("b"), F.lit(True).alias("has")).distinct()
    return e.join(have, "b", "left").agg(F.count("*").alias("refs"), F.count_if("has").alias("resolved"), F.countDistinct("from_paper_id").alias("sources"))


@query("g1_sync_targets", "SELECT id, count(r.ref_bibcode) AS had FROM papers p LEFT JOIN paper_references r ON r.from_paper_id = p.id WHERE trim(coalesce(bibcode, '')) <> '' GROUP BY id HAVING count(r.ref_bibcode) = 0")
def _(s, d):
    p = table(s, d, "papers").where(nonblank(F.col("bibcode"))).select("id")
    return p.join(table(s, d, "paper_references").select(F.col("from_paper_id").alias("id")), "id", "left_anti").select("id", F.lit(0).cast("long").alias("had"))


@query("g5_hubs_to_ingest", f"WITH {_E}, {_N} SELECT b AS bibcode, substr(b, 1, 4) || '-01-01' AS published FROM e WHERE b NOT IN (SELECT b FROM n) GROUP BY b HAVING count(*) >= 3")
def _(s, d):
    h = graph.missing_hubs(table(s, d, "paper_references"), table(s, d, "papers"), 3)
    return h.select(F.col("ref_bibcode").alias("bibcode"), F.concat(F.substring("ref_bibcode", 1, 4), F.lit("-01-01")).alias("published"))


@query("g10_ref_map", f"""WITH {_E}, {_N} SELECT from_paper_id, row_number() OVER (PARTITION BY from_paper_id ORDER BY e.b) AS n, e.b || CASE WHEN n.id IS NULL THEN '' ELSE ' [in library]' END AS line FROM e LEFT JOIN n USING (b)""")
def _(s, d):
    r = graph.resolve_edges(table(s, d, "paper_references"), table(s, d, "papers"))
    return r.select("from_paper_id", F.row_number().over(Window.partitionBy("from_paper_id").orderBy("ref_bibcode")).alias("n"), F.concat("ref_bibcode", F.when(F.col("in_library"), " [in library]").otherwise("")).alias("line"))


_CHAIN = f"""{_E}, {_N}, i AS (SELECT DISTINCT from_paper_id AS u, n.id AS v FROM e JOIN n USING (b)), s0 AS (SELECT id AS seed, id AS paper_id FROM papers WHERE id % 50 = 0),
s1 AS (SELECT seed, v AS paper_id, min(u) AS parent FROM s0 JOIN i ON i.u = paper_id WHERE v <> seed GROUP BY 1, 2),
s2 AS (SELECT seed, v AS paper_id, min(u) AS parent FROM s1 JOIN i ON i.u = s1.paper_id WHERE v <> seed AND NOT EXISTS (SELECT 1 FROM s1 x WHERE x.seed = s1.seed AND x.paper_id = v) GROUP BY 1, 2),
c AS (SELECT seed, paper_id, 0 AS depth, NULL::BIGINT AS parent FROM s0 UNION ALL SELECT seed, paper_id, 1, parent FROM s1 UNION ALL SELECT seed, paper_id, 2, parent FROM s2)"""


@query("g8_chain", f"WITH {_CHAIN} SELECT seed, paper_id, depth, parent FROM c")
def _(s, d):
    p = table(s, d, "papers")
    return resolve.chain(table(s, d, "paper_references"), p, p.where("id % 50 = 0").select(F.col("id").alias("seed")), 2)


@query("a18_chain_summary", f"WITH {_CHAIN} SELECT seed, count(*) AS nodes, count(*) FILTER (depth = 2) AS leaves, max(depth) AS hops FROM c GROUP BY seed")
def _(s, d):
    p = table(s, d, "papers")
    t = resolve.chain(table(s, d, "paper_references"), p, p.where("id % 50 = 0").select(F.col("id").alias("seed")), 2)
    return t.groupBy("seed").agg(F.count("*").alias("nodes"), F.count_if(F.col("depth") == 2).alias("leaves"), F.max("depth").alias("hops"))


@query("u7_unvisited", f"WITH {_CHAIN} SELECT id FROM papers WHERE id NOT IN (SELECT paper_id FROM c)")
def _(s, d):
    p = table(s, d, "papers")
    t = resolve.chain(table(s, d, "paper_references"), p, p.where("id % 50 = 0").select(F.col("id").alias("seed")), 2)
    return p.select("id").join(t.select(F.col("paper_id").alias("id")), "id", "left_anti")


@query("t2_query_terms", f"""
WITH w AS (SELECT ref_id, list_distinct([x FOR x IN regexp_extract_all(lower(raw), '[\\p{{L}}\\p{{N}}_]+') IF length(x) >= 2 AND x NOT IN ('and', 'or', 'not', 'near', 'ne', 'a', 'an', 'the', 'is', 'are', 'to', 'of', 'in', 'on', 'for')]) AS w FROM parsed_references WHERE raw IS NOT NULL)
SELECT ref_id, least(24, len(w)) AS n FROM w""")
def _(s, d):
    terms = F.slice(F.array_distinct(F.filter(F.regexp_extract_all(F.lower("raw"), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)), lambda x: ~x.isin(*bm25.RESERVED))), 1, 24)
    return table(s, d, "parsed_references").where("raw is not null").select("ref_id", F.size(terms).cast("long").alias("n"))


@query("p8_identifiers", rf"SELECT id, {_AX.format('arxiv_id')} AS arxiv FROM papers WHERE regexp_matches({_AX.format('arxiv_id')}, '^[0-9]{{4}}\.[0-9]{{4,5}}$')")
def _(s, d):
    ax = F.lower(identifiers.strip_arxiv_version(F.col("arxiv_id")))
    p = table(s, d, "papers").where(ax.rlike(r"^\d{4}\.\d{4,5}$")).select("id", F.concat(F.lit("MNRAS 000, 1-5\n\n"), "title", F.lit("\n\nA. Author, B. Writer\n\narXiv:"), ax, F.lit("v2\n\nAbstract\n"), "abstract").alias("t"))
    return p.select("id", documents.document_identifiers(F.col("t"), F.lit("")).alias("x")).select("id", "x.arxiv")
