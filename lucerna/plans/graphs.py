"""Citation graph and duplicate papers."""

from pyspark.sql import functions as F

from lucerna.operators import dedupe, graph
from lucerna.plans.base import query, table

_E = "e AS (SELECT DISTINCT from_paper_id, trim(ref_bibcode) AS b FROM paper_references WHERE ref_bibcode IS NOT NULL AND trim(ref_bibcode) <> '')"
_N = "n AS (SELECT trim(bibcode) AS b, max(id) AS id FROM papers WHERE bibcode IS NOT NULL AND trim(bibcode) <> '' GROUP BY 1)"


def _t(s, d):
    return table(s, d, "paper_references"), table(s, d, "papers")


@query("g3_missing_hubs", f"WITH {_E}, {_N} SELECT b AS ref_bibcode, count(*) AS n FROM e WHERE b NOT IN (SELECT b FROM n) GROUP BY b HAVING count(*) >= 2")
def _(s, d):
    return graph.missing_hubs(*_t(s, d))


@query("a9_graph_stats", f"""WITH {_E}, {_N}, h AS (SELECT b FROM e WHERE b NOT IN (SELECT b FROM n) GROUP BY b HAVING count(*) >= 2)
SELECT (SELECT count(*) FROM papers) AS papers, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e JOIN n USING (b)) AS internal_edges, (SELECT count(*) FROM h) AS hubs""")
def _(s, d):
    return graph.graph_stats(*_t(s, d))


@query("g2_nodes", f"""WITH {_E}, {_N}
SELECT 'p' || id AS node, 'paper' AS kind, coalesce(nullif(trim(bibcode), ''), nullif(trim(arxiv_id), ''), 'paper ' || id) AS label, NULL::BIGINT AS citing FROM papers
UNION ALL SELECT 'h:' || b, 'hub', b, count(*) FROM e WHERE b NOT IN (SELECT b FROM n) GROUP BY b HAVING count(*) >= 2""")
def _(s, d):
    return graph.graph_nodes(*_t(s, d))


@query("a20_hub_citers", f"""WITH {_E}, {_N}, h AS (SELECT b FROM e WHERE b NOT IN (SELECT b FROM n) GROUP BY b HAVING count(*) >= 2),
r AS (SELECT e.b, from_paper_id, row_number() OVER (PARTITION BY e.b ORDER BY from_paper_id) AS k FROM e JOIN h USING (b))
SELECT b AS ref_bibcode, string_agg(from_paper_id::VARCHAR, ' ' ORDER BY from_paper_id) AS papers FROM r WHERE k <= 8 GROUP BY b""")
def _(s, d):
    e, p = _t(s, d)
    return graph.hub_citers(e, graph.missing_hubs(e, p)).select("ref_bibcode", F.array_join("papers", " ").alias("papers"))


@query("g4_mindmap")
def _(s, d):
    e, p = _t(s, d)
    hubs = graph.missing_hubs(e, p)
    top = hubs.orderBy(F.desc("n"), "ref_bibcode").limit(12)
    return graph.mindmap(top.join(graph.hub_citers(e, top), "ref_bibcode"))


@query("g8_reach", f"""WITH RECURSIVE {_E}, {_N}, i AS (SELECT DISTINCT from_paper_id AS u, n.id AS v FROM e JOIN n USING (b)),
r AS (SELECT id AS seed, id AS paper_id, 0 AS depth FROM papers WHERE id % 50 = 0 UNION SELECT r.seed, i.v, r.depth + 1 FROM r JOIN i ON i.u = r.paper_id WHERE r.depth < 2)
SELECT seed, paper_id, min(depth) AS depth FROM r GROUP BY seed, paper_id""")
def _(s, d):
    e, p = _t(s, d)
    return graph.reach(e, p, p.where("id % 50 = 0").select(F.col("id").alias("seed")), 2)


@query("g9_visit_key", """SELECT cand_id, coalesce('bib:' || nullif(trim(bibcode), ''), 'arxiv:' || lower(nullif(trim(arxiv_id), '')), 'doi:' || lower(nullif(trim(doi), '')), 'line:' || substr(sha256(coalesce(title, '')), 1, 20)) AS key FROM candidates""")
def _(s, d):
    return table(s, d, "candidates").select("cand_id", graph.visit_key(F.col("bibcode"), F.col("arxiv_id"), F.col("doi"), F.col("title")).alias("key"))


_V = r"""v AS (SELECT id, 'b' || upper(trim(bibcode)) AS x FROM papers WHERE trim(bibcode) <> '' UNION SELECT id, 'a' || lower(regexp_replace(regexp_replace(trim(arxiv_id), '(?i)^arxiv:\s*', ''), '(?i)v[0-9]+$', '')) FROM papers WHERE trim(arxiv_id) <> ''
UNION SELECT id, 'p' || lower(replace(trim(pdf_relpath), '\', '/')) FROM papers WHERE trim(pdf_relpath) <> ''),
m AS (SELECT x, min(id) AS low FROM v GROUP BY x HAVING count(*) > 1), e AS (SELECT v.id AS i, m.low AS j FROM v JOIN m USING (x) WHERE v.id <> m.low), e2 AS (SELECT i, j FROM e UNION SELECT j, i FROM e),
r AS (SELECT i, i AS j FROM e2 UNION SELECT r.i, e2.j FROM r JOIN e2 ON r.j = e2.i), g AS (SELECT i AS id, min(j) AS cluster FROM r GROUP BY i)"""


@query("g6_duplicate_clusters", f"WITH RECURSIVE {_V} SELECT id, cluster FROM g")
def _(s, d):
    return dedupe.duplicate_clusters(table(s, d, "papers"))


@query("w7_keep_choice", f"""WITH RECURSIVE {_V}, c AS (SELECT paper_id AS id, count(*) AS n FROM paper_chunks GROUP BY 1)
SELECT cluster, arg_max(g.id, (CASE WHEN c.n > 0 THEN 4 ELSE 0 END + CASE WHEN trim(coalesce(pdf_relpath, '')) <> '' THEN 2 ELSE 0 END + CASE WHEN trim(coalesce(bibcode, '')) <> '' THEN 1 ELSE 0 END) * 1000000000::BIGINT - g.id) AS keep_id
FROM g JOIN papers p ON p.id = g.id LEFT JOIN c ON c.id = g.id GROUP BY cluster""")
def _(s, d):
    return dedupe.merge_plan(table(s, d, "papers"), table(s, d, "paper_chunks"))


_KEEP = """c AS (SELECT paper_id AS id, count(*) AS n FROM paper_chunks GROUP BY 1), k AS (SELECT cluster, arg_max(g.id, (CASE WHEN c.n > 0 THEN 4 ELSE 0 END + CASE WHEN trim(coalesce(pdf_relpath, '')) <> '' THEN 2 ELSE 0 END + CASE WHEN trim(coalesce(bibcode, '')) <> '' THEN 1 ELSE 0 END) * 1000000000::BIGINT - g.id) AS keep_id
FROM g JOIN papers p ON p.id = g.id LEFT JOIN c ON c.id = g.id GROUP BY cluster), v2 AS (SELECT g.id, keep_id FROM g JOIN k USING (cluster))"""
_FILLED = ", ".join(f"arg_max({f}, (p.id = keep_id)::INT * 1000000000000 + p.id) FILTER (trim({f}) <> '') AS {f}" for f in ("arxiv_id", "bibcode", "title", "abstract", "published", "source", "pdf_relpath"))


@query("g7_merged_papers", f"WITH RECURSIVE {_V}, {_KEEP} SELECT keep_id, {_FILLED} FROM v2 JOIN papers p ON p.id = v2.id GROUP BY keep_id")
def _(s, d):
    return dedupe.merged_papers(table(s, d, "papers"), table(s, d, "paper_chunks"))


@query("g7_merged_edges", f"WITH RECURSIVE {_V}, {_KEEP} SELECT DISTINCT coalesce(keep_id, from_paper_id) AS from_paper_id, ref_bibcode FROM paper_references r LEFT JOIN v2 ON v2.id = r.from_paper_id")
def _(s, d):
    return dedupe.merged_edges(table(s, d, "papers"), table(s, d, "paper_chunks"), table(s, d, "paper_references"))
