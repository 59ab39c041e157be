"""Indexing, passage search, topic gathering, dossier, report and comparison."""

from pyspark.sql import functions as F

from lucerna.functions.chunk import chunk_texts
from lucerna.functions.identifiers import text_hash
from lucerna.operators import bm25, graph, mutate, retrieval, topics, vectors
from lucerna.plans.base import query, table
from lucerna.plans.ranking import bm25_sql

_TOPIC = "dynamical friction"
_QUERIES = topics.expansions(_TOPIC)


def _gather_sql() -> str:
    parts = []
    for k, q in enumerate(_QUERIES):
        one = bm25_sql("paper_chunks", "id", "text", bm25.query_terms(q), False, 12)
        parts.append(f"SELECT id, bm25 AS distance, {k} AS query_no, '{q}' AS matched_query FROM ({one})")
    return f"""u AS ({' UNION ALL '.join(parts)}), g AS (SELECT id, distance, query_no, matched_query, count(*) OVER (PARTITION BY id) - 1 AS dropped, row_number() OVER (PARTITION BY id ORDER BY query_no) AS k FROM u),
m AS (SELECT g.id, g.distance, g.query_no, g.matched_query, c.paper_id, c.text, p.title, p.bibcode, p.arxiv_id, row_number() OVER (ORDER BY coalesce(g.distance, 9e9), g.query_no, g.id) AS no FROM g JOIN paper_chunks c ON c.id = g.id LEFT JOIN papers p ON p.id = c.paper_id WHERE k = 1)"""


def _gathered(s, d):
    c = table(s, d, "paper_chunks")
    return topics.with_metadata(topics.gather(c, _QUERIES), c, table(s, d, "papers"))


@query("t5_index_papers", """
SELECT id AS paper_id, 0 AS chunk_ord, 0 AS char_start, length(t) AS char_end, substr(sha256(t), 1, 32) AS text_hash FROM (SELECT id, trim(abstract) AS t FROM papers p WHERE NOT EXISTS (SELECT 1 FROM paper_chunks c WHERE c.paper_id = p.id)) WHERE t <> '' AND length(t) <= 1200""")
def _(s, d):
    p = table(s, d, "papers").select("id", "abstract").join(table(s, d, "paper_chunks").select(F.col("paper_id").alias("id")), "id", "left_anti")
    c = chunk_texts(p.where(F.length(F.trim("abstract")) <= 1200), "id", "abstract")
    return c.select(F.col("id").alias("paper_id"), "chunk_ord", "char_start", "char_end", text_hash(F.col("text")).alias("text_hash"))


@query("t5_index_with_vectors")
def _(s, d):
    """The whole flow: papers without chunks are cut, hashed, numbered after the old chunks and embedded."""
    old = table(s, d, "paper_chunks")
    p = table(s, d, "papers").select("id", "abstract").join(old.select(F.col("paper_id").alias("id")), "id", "left_anti")
    new = mutate.number_rows(chunk_texts(p, "id", "abstract"), ["id", "chunk_ord"]).crossJoin(F.broadcast(old.agg(F.max("id").alias("top"))))
    rows = new.select((F.col("top") + F.col("n")).alias("chunk_id"), F.col("id").alias("paper_id"), "chunk_ord", text_hash(F.col("text")).alias("text_hash"), vectors.hash_embedding_col(F.col("text")).alias("embedding"))
    return rows.select("chunk_id", "paper_id", "chunk_ord", "text_hash", F.size("embedding").alias("dim"))


_T6 = bm25_sql("paper_chunks", "id", "text", bm25.query_terms("tidal stripping of dwarf discs"), False, 10)


@query("t6_chunk_search", f"SELECT h.id, h.bm25 AS distance, c.paper_id, p.bibcode FROM ({_T6}) h JOIN paper_chunks c ON c.id = h.id LEFT JOIN papers p ON p.id = c.paper_id")
def _(s, d):
    c = table(s, d, "paper_chunks")
    hits = bm25.search(c, "id", F.col("text"), bm25.query_terms("tidal stripping of dwarf discs"), False).select("id", F.round("bm25", 6).alias("distance")).orderBy("distance", "id").limit(10)
    return topics.with_metadata(hits, c, table(s, d, "papers")).select("id", "distance", "paper_id", "bibcode")


@query("t6_vector_search", """
WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = (SELECT max(vec_id) FROM embeddings)), d AS (SELECT vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], qv) AS x FROM embeddings, q)
SELECT vec_id, label, round(x, 6) AS distance FROM d ORDER BY x, vec_id LIMIT 10""")
def _(s, d):
    e = table(s, d, "embeddings")
    one = e.orderBy(F.desc("vec_id")).limit(1)
    near = vectors.nearest(e, "vec_id", "embedding", one, "vec_id", "embedding", 10)
    return near.join(e.select("vec_id", "label"), "vec_id").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("u1_topic_union", f"WITH {_gather_sql()} SELECT id, query_no, dropped FROM g WHERE k = 1")
def _(s, d):
    return topics.gather(table(s, d, "paper_chunks"), _QUERIES).select("id", "query_no", "dropped")


@query("l4_by_distance", f"WITH {_gather_sql()} SELECT no, id, distance FROM m")
def _(s, d):
    return topics.numbered(topics.gather(table(s, d, "paper_chunks"), _QUERIES)).select("no", "id", "distance")


@query("j9_hit_metadata", f"WITH {_gather_sql()} SELECT id, paper_id, title, bibcode, arxiv_id FROM m")
def _(s, d):
    return _gathered(s, d).select("id", "paper_id", "title", "bibcode", "arxiv_id")


_LINE = "substr(replace(coalesce({0}, ''), chr(10), ' '), 1, {1})"


@query("t11_dossier", f"""WITH {_gather_sql()}, b AS (SELECT no, id, '### Source ' || no || ' (paper_id=' || paper_id || ', bibcode=' || coalesce(bibcode, '') || ', chunk_id=' || id || ', distance=' || printf('%.4f', distance) || ')' || chr(10) || 'Title: ' || {_LINE.format('title', 120)} || chr(10) || 'Matched query: ' || matched_query || chr(10) || chr(10) || trim(text) || chr(10) AS block FROM m),
w AS (SELECT no, id, block, sum(length(block)) OVER (ORDER BY no) AS used FROM b) SELECT no, id, length(block) AS n FROM w WHERE used <= 8000 OR no = 1""")
def _(s, d):
    return topics.dossier(_gathered(s, d), 8000).select("no", "id", F.length("block").alias("n"))


@query("t12_report", f"""WITH {_gather_sql()}, {"e AS (SELECT DISTINCT from_paper_id, trim(ref_bibcode) AS b FROM paper_references WHERE ref_bibcode IS NOT NULL AND trim(ref_bibcode) <> '')"}, n AS (SELECT trim(bibcode) AS b, arg_max(coalesce(title, ''), id) AS title, arg_max(trim(coalesce(pdf_relpath, '')) <> '', id) AS pdf FROM papers WHERE trim(bibcode) <> '' GROUP BY 1),
r AS (SELECT from_paper_id AS paper_id, row_number() OVER (PARTITION BY from_paper_id ORDER BY e.b) AS r, e.b, n.title AS t, coalesce(n.pdf, false) AS pdf FROM e LEFT JOIN n ON n.b = e.b WHERE from_paper_id IN (SELECT paper_id FROM m)),
l AS (SELECT paper_id, string_agg('  - R' || r || ': ' || b || CASE WHEN pdf THEN ' [in library]' ELSE '' END || ' — ' || {_LINE.format('trim(t)', 120)}, chr(10) ORDER BY r) AS listed FROM r WHERE r <= 30 GROUP BY 1),
b AS (SELECT no, m.paper_id, id, '### S' || no || ' — retrieved excerpt' || chr(10) || '- **paper_id**: ' || m.paper_id || chr(10) || '- **bibcode**: ' || coalesce(nullif(trim(bibcode), ''), '—') || chr(10) || '- **arxiv_id**: ' || coalesce(nullif(trim(arxiv_id), ''), '—') || chr(10) || '- **title**: ' || {_LINE.format('title', 200)} || chr(10) || '- **retrieval distance**: ' || printf('%.4f', distance) || chr(10) || '- **matched_query**: ' || matched_query || chr(10) || chr(10) || '**Excerpt:**' || chr(10) || trim(text) || chr(10) || chr(10) || '**References from this paper**:' || chr(10) || coalesce(listed, '  (no references of this paper in the library)') || chr(10) AS block FROM m LEFT JOIN l ON l.paper_id = m.paper_id),
w AS (SELECT *, sum(length(block)) OVER (ORDER BY no) AS used FROM b) SELECT 'S' || no AS tag, paper_id, id, length(block) AS n FROM w WHERE used <= 56000 OR no = 1""")
def _(s, d):
    edges = graph.resolve_edges(table(s, d, "paper_references"), table(s, d, "papers"))
    return topics.report(_gathered(s, d), edges).select("tag", "paper_id", "id", F.length("block").alias("n"))


@query("t10_compare_context", f"""
WITH h AS (SELECT c.paper_id, b.id, b.bm25 AS o FROM ({bm25_sql('paper_chunks', 'id', 'text', bm25.query_terms(_TOPIC), False, None)}) b JOIN paper_chunks c ON c.id = b.id),
u AS (SELECT paper_id, id, 0 AS k, o, 0 AS o2 FROM h UNION ALL SELECT paper_id, id, 1, 0, chunk_ord FROM paper_chunks WHERE id NOT IN (SELECT id FROM h))
SELECT paper_id, id, pos FROM (SELECT paper_id, id, row_number() OVER (PARTITION BY paper_id ORDER BY k, o, o2, id) AS pos FROM u) WHERE pos <= 4""")
def _(s, d):
    c = table(s, d, "paper_chunks")
    hits = bm25.search(c, "id", F.col("text"), bm25.query_terms(_TOPIC), False).select("id", F.round("bm25", 6).alias("distance")).join(c.select("id", "paper_id"), "id")
    return topics.per_paper_context(c.select("id", "paper_id", "chunk_ord"), hits, 4)


@query("l3_over_fetch", "SELECT paper_id, id FROM (SELECT paper_id, id, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_ord, id) AS n FROM paper_chunks) WHERE n <= greatest(4 * 2, 2 + 4)")
def _(s, d):
    k = 2
    return retrieval.top_per_group(table(s, d, "paper_chunks"), ["paper_id"], [F.col("chunk_ord"), F.col("id")], max(4 * k, k + 4)).select("paper_id", "id")
