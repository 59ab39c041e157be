"""Text and vector retrieval."""

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lucerna.functions.chunk import chunk_texts, fixed_chunks
from lucerna.functions.text import words
from lucerna.operators import bm25, retrieval, topics, vectors
from lucerna.plans.base import query, table
from lucerna.runtime import small


def bm25_sql(tbl: str, key: str, text: str, terms: list[str], all_: bool, k: int | None) -> str:
    tf = ", ".join(f"len([x FOR x IN w IF x = '{t}']) AS f{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"sum((f{i} > 0)::int) AS d{i}" for i in range(len(terms)))
    one = " + ".join(f"CASE WHEN f{i} > 0 THEN (CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / a)) ELSE 0 END" for i in range(len(terms)))
    cond = (" AND " if all_ else " OR ").join(f"f{i} > 0" for i in range(len(terms)))
    cut = f" ORDER BY bm25, {key} LIMIT {k}" if k else ""
    return rf"""WITH t AS (SELECT {key}, regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM {tbl}),
r AS (SELECT {key}, len(w) AS l, {tf} FROM t), s AS (SELECT count(*) AS n, avg(l) AS a, {dfs} FROM r)
SELECT {key}, round(-({one}), 6) AS bm25 FROM r, s WHERE {cond}{cut}"""


_T1 = bm25.query_terms("stellar feedback and the dynamical friction")


@query("t1_bm25_top", bm25_sql("documents", "doc_id", "text", _T1, False, 10))
def _(s, d):
    return bm25.search(table(s, d, "documents"), "doc_id", F.col("text"), _T1, False).select("doc_id", F.round("bm25", 6).alias("bm25")).orderBy("bm25", "doc_id").limit(10)


_T2 = bm25.query_terms("magnetic braking metallicity")


@query("t1_bm25_all_terms", bm25_sql("paper_chunks", "id", "text", _T2, True, None))
def _(s, d):
    return bm25.search(table(s, d, "paper_chunks"), "id", F.col("text"), _T2, True).select("id", F.round("bm25", 6).alias("bm25"))


_T3 = bm25.query_terms("neutron stars")


@query("t3_title_abstract", bm25_sql("papers", "id", "concat(coalesce(title, ''), ' ', coalesce(abstract, ''))", _T3, True, 20))
def _(s, d):
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))
    return bm25.search(table(s, d, "papers"), "id", text, _T3, True).select("id", F.round("bm25", 6).alias("bm25")).orderBy("bm25", "id").limit(20)


@query("t1_postings", r"""
WITH t AS (SELECT id, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')) AS term FROM papers) SELECT id, term, count(*) AS tf FROM t GROUP BY id, term""")
def _(s, d):
    return bm25.postings(table(s, d, "papers"), "id", F.col("title"))[0]


@query("t4_fixed_chunks", """
SELECT doc_id, (s // 1000)::int AS chunk_ord, s::int AS char_start, least(s + 1200, length(text))::int AS char_end, md5(substring(text, s + 1, 1200)) AS h
FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, length(text) - 201), 1000)) AS s FROM documents WHERE length(text) > 0)""")
def _(s, d):
    return fixed_chunks(table(s, d, "documents"), "doc_id", "text").select("doc_id", "chunk_ord", "char_start", "char_end", F.md5("text").alias("h"))


@query("t4_boundary_chunks")
def _(s, d):
    return chunk_texts(table(s, d, "documents"), "doc_id", "text").withColumn("text_hash", F.substring(F.sha2("text", 256), 1, 32)).drop("text")


_VEC = "[" + ", ".join(f"('0x' || substr(h, {2 * i + 1}, 2))::INT / 127.5 - 1" for i in range(8)) + "]"
_QTEXT = "magnetic braking metallicity"
_FUSED = f"""b AS (SELECT id, row_number() OVER (ORDER BY bm25, id) - 1 AS r, 0 AS l FROM ({bm25_sql('paper_chunks', 'id', 'text', _T2, False, 24)})),
e AS (SELECT id, {_VEC} AS v FROM (SELECT id, sha256(coalesce(text, '')) AS h FROM paper_chunks)), q AS (SELECT {_VEC} AS v FROM (SELECT sha256('{_QTEXT}') AS h)),
n AS (SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS r, 1 AS l FROM (SELECT id, round(1 - list_cosine_similarity(e.v::DOUBLE[], q.v::DOUBLE[]), 9) AS d FROM e, q ORDER BY d, id LIMIT 24)),
f AS (SELECT id, sum(1.0 / (60 + r + 1)) AS rrf FROM (SELECT * FROM b UNION ALL SELECT * FROM n) GROUP BY id)"""


def _hybrid(c):
    return retrieval.hybrid(c, "id", "text", _T2, vectors.hash_embedding(_QTEXT), vectors.hash_embedding_col(F.col("text")))


@query("t7_hybrid", f"WITH {_FUSED} SELECT id, round(rrf, 9) AS rrf FROM f")
def _(s, d):
    return _hybrid(table(s, d, "paper_chunks")).select("id", F.round("rrf", 9).alias("rrf"))


@query("t8_context_mmr")
def _(s, d):
    c = table(s, d, "paper_chunks").select("id", "paper_id", "text")
    hits = _hybrid(c).select("id", F.col("rrf").alias("score")).join(c, "id").withColumn("by", F.lit(_QTEXT))
    return retrieval.mmr(hits, "by", "id", "text", "score", 16).select("id", "pick")


@query("t8_context", f"""WITH {_FUSED}, k AS (SELECT id, row_number() OVER (ORDER BY round(rrf, 9) DESC, id) AS n FROM f), p AS (SELECT k.n, '[chunk_id=' || k.id || ']' || chr(10) || trim(c.text) AS part FROM k JOIN paper_chunks c USING (id) WHERE k.n <= 16 AND trim(c.text) <> ''),
w AS (SELECT n, part, sum(length(part) + 2) OVER (ORDER BY n) AS used, row_number() OVER (ORDER BY n) AS rn FROM p)
SELECT md5(string_agg(part, chr(10) || chr(10) ORDER BY n)) AS h, count(*) AS n FROM w WHERE used <= 24000 OR rn = 1""")
def _(s, d):
    c = table(s, d, "paper_chunks").select("id", "paper_id", "text")
    picks = _hybrid(c).select(F.lit(1).alias("by"), "id", F.row_number().over(Window.orderBy(F.desc(F.round("rrf", 9)), "id")).alias("pick"))
    text = topics.context_text(picks, c).select("context")
    return text.select(F.md5("context").alias("h"), F.regexp_count("context", F.lit(r"\[chunk_id=")).cast("long").alias("n"))


@query("t8_single_paper_filter", "SELECT id FROM paper_chunks WHERE paper_id = (SELECT min(paper_id) FROM paper_chunks) AND regexp_matches(lower(text), '(^|[^\\pL\\pN_])metallicity($|[^\\pL\\pN_])')")
def _(s, d):
    c = table(s, d, "paper_chunks")
    one = c.join(F.broadcast(c.agg(F.min("paper_id").alias("paper_id"))), "paper_id", "left_semi")
    return bm25.search(one, "id", F.col("text"), ["metallicity"]).select("id")


def related_papers(p, c, asked, k: int = 10):
    """``query_id, id, bm25``: the ``k`` papers nearest to each of the papers ``asked`` (a condition), by their best chunk.

    Terms are the first 14 of title, 600 characters of the abstract and 450 of the first chunk, any of which
    may match; all chunks of other papers are ranked.
    """
    first = retrieval.top_per_group(c.select("paper_id", "chunk_ord", F.col("id").alias("chunk_id"), "text"), ["paper_id"], [F.col("chunk_ord"), F.col("chunk_id")])
    q = p.where(asked).select(F.col("id").alias("query_id"), "title", "abstract").join(first.select(F.col("paper_id").alias("query_id"), F.substring("text", 1, 450).alias("chunk")), "query_id", "left")
    text = F.concat_ws(" ", F.trim("title"), F.substring(F.trim("abstract"), 1, 600), "chunk")
    terms = F.slice(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)), lambda x: ~x.isin(*bm25.RESERVED))), 1, 14)
    asked_terms = q.select("query_id", F.explode(terms).alias("term"))
    toks = c.select("paper_id", words(F.coalesce("text", F.lit(""))).alias("w")).where("paper_id is not null")
    n, avg_len = toks.agg(F.count("*"), F.avg(F.size("w"))).first()
    seen = toks.select(F.explode(F.array_distinct("w")).alias("term")).join(small(asked_terms.select("term").distinct(), 200_000), "term", "left_semi").groupBy("term").agg(F.count("*").alias("d"))
    of: dict[str, tuple[float, list[int]]] = {}
    for r in small(asked_terms.join(seen, "term"), 200_000).collect():  # a stated set of papers, at most 14 terms each
        idf = math.log((n - r["d"] + 0.5) / (r["d"] + 0.5))
        of.setdefault(r["term"], (idf if idf > 0 else 1e-6, []))[1].append(r["query_id"])
    ids = sorted({i for _, x in of.values() for i in x})
    place = {i: j for j, i in enumerate(ids)}
    shared = c.sparkSession.sparkContext.broadcast({t: (idf, [place[i] for i in x]) for t, (idf, x) in of.items()})

    def run(batches):
        for whole in batches:
            for lo in range(0, len(whole), 2000):
                b = whole.iloc[lo : lo + 2000]
                papers, found = b["paper_id"].to_numpy(), {}
                for i, w in enumerate(b["w"]):
                    tf = Counter(t for t in w if t in shared.value)
                    for t, f in tf.items():
                        at, got = found.setdefault(t, ([], []))
                        at.append(i)
                        got.append(shared.value[t][0] * f * (bm25.K1 + 1) / (f + bm25.K1 * (1 - bm25.B + bm25.B * len(w) / avg_len)))
                score = np.zeros((len(ids), len(b)))
                for t, (at, got) in found.items():
                    for j in shared.value[t][1]:
                        score[j, at] += got
                out = []
                for j, i in enumerate(ids):
                    hit = np.flatnonzero((score[j] > 0) & (papers != i))
                    best: dict = {}
                    for x in hit[np.lexsort((papers[hit], np.round(-score[j, hit], 9)))]:
                        best.setdefault(int(papers[x]), -float(score[j, x]))
                        if len(best) == k:
                            break
                    out += [(i, x, v) for x, v in best.items()]
                yield pd.DataFrame(out, columns=["query_id", "id", "bm25"])

    # the best k papers of a part hold every one of the best k of all that has its best chunk there: no posting is shuffled
    papers = toks.mapInPandas(run, "query_id long, id long, bm25 double").groupBy("query_id", "id").agg(F.min("bm25").alias("bm25"))
    return retrieval.top_per_group(papers, ["query_id"], [F.round("bm25", 9), F.col("id")], k).select("query_id", "id", F.round("bm25", 6).alias("bm25"))


@query("t9_related_papers")
def _(s, d):
    return related_papers(table(s, d, "papers"), table(s, d, "paper_chunks"), "id % 50 = 0")


@query("t13_local_search", r"""
WITH q AS (SELECT ref_id, trim(page) AS page, trim(volume) AS volume, lower(first_author) AS a, substr(year, 1, 4) AS y FROM parsed_references),
c AS (SELECT cand_id, trim(page) AS page, trim(volume) AS volume, lower(split_part(authors[1], ',', 1)) AS a, substr(year, 1, 4) AS y FROM candidates WHERE len(authors) > 0),
h AS (SELECT ref_id, cand_id, 1 AS tier FROM q JOIN c USING (volume, page) UNION ALL SELECT ref_id, cand_id, 2 FROM q JOIN c USING (a, y))
SELECT ref_id, cand_id, tier FROM (SELECT DISTINCT * FROM h) QUALIFY tier = min(tier) OVER (PARTITION BY ref_id)""")
def _(s, d):
    q = table(s, d, "parsed_references").select("ref_id", F.trim("page").alias("page"), F.trim("volume").alias("volume"), F.lower("first_author").alias("a"), F.substring("year", 1, 4).alias("y"))
    c = table(s, d, "candidates").where("size(authors) > 0").select("cand_id", F.trim("page").alias("page"), F.trim("volume").alias("volume"), F.lower(F.split(F.col("authors")[0], ",")[0]).alias("a"), F.substring("year", 1, 4).alias("y"))
    one = q.join(c, ["volume", "page"]).select("ref_id", "cand_id", F.lit(1).alias("tier"))
    two = q.join(one.select("ref_id").distinct(), "ref_id", "left_anti").join(c, ["a", "y"]).select("ref_id", "cand_id", F.lit(2).alias("tier"))
    return one.unionByName(two).distinct()


@query("v1_nearest", """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT query_id, vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], qv) AS distance FROM embeddings, q)
SELECT query_id, vec_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS n FROM d) WHERE n <= 5""")
def _(s, d):
    e = table(s, d, "embeddings")
    return vectors.nearest(e, "vec_id", "embedding", e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@query("v2_nearest_of_means", """
WITH p AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, generate_series(1, 64) AS g(i) GROUP BY label, i),
m AS (SELECT label, list(m ORDER BY i) AS qv FROM p GROUP BY label),
d AS (SELECT m.label AS query_id, e.vec_id, 1 - list_cosine_similarity(e.embedding::DOUBLE[], m.qv) AS distance FROM embeddings e, m WHERE e.label <> m.label)
SELECT query_id, vec_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS n FROM d) WHERE n <= 5""")
def _(s, d):
    e = table(s, d, "embeddings")
    m = vectors.mean_vector(e, "label", "embedding")
    return vectors.nearest(e, "vec_id", "embedding", m, "label", "mean", 5, "label", "label").select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@query("v3_embed", f"SELECT id, round(list_sum({_VEC}), 5) AS total FROM (SELECT id, sha256(coalesce(title, '')) AS h FROM papers)")
def _(s, d):
    return vectors.embed(table(s, d, "papers").select("id", "title"), "title").select("id", F.round(F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x), 5).alias("total"))


@query("f15_grounding_whole", r"""
WITH x AS (SELECT p.chunk_id, p.proof_text AS e, c.text AS b FROM chunk_proofs p JOIN paper_chunks c ON c.id = p.chunk_id),
y AS (SELECT chunk_id, trim(regexp_replace(lower(e), '\s+', ' ', 'g')) AS fe, trim(regexp_replace(lower(b), '\s+', ' ', 'g')) AS fb,
list_distinct(regexp_extract_all(lower(e), '[\p{L}\p{N}_]{2,}')) AS te, list_distinct(regexp_extract_all(lower(b), '[\p{L}\p{N}_]{2,}')) AS tb FROM x)
SELECT chunk_id, fe <> '' AND (contains(fb, fe) OR len(list_intersect(te, tb)) / len(te) >= 0.6) AS grounded FROM y""")
def _(s, d):
    x = table(s, d, "chunk_proofs").join(table(s, d, "paper_chunks").select(F.col("id").alias("chunk_id"), "text"), "chunk_id")
    return x.select("chunk_id", retrieval.grounded(F.col("proof_text"), F.col("text")).alias("grounded"))


@query("w6_bundles", """
WITH RECURSIVE o AS (SELECT paper_id, length(text) AS n, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_ord, length(text)) AS k FROM paper_chunks),
w AS (SELECT paper_id, k, n AS used, 0 AS b FROM o WHERE k = 1 UNION ALL SELECT o.paper_id, o.k, CASE WHEN w.used > 0 AND w.used + o.n > 8000 THEN o.n ELSE w.used + o.n END, CASE WHEN w.used > 0 AND w.used + o.n > 8000 THEN w.b + 1 ELSE w.b END FROM w JOIN o ON o.paper_id = w.paper_id AND o.k = w.k + 1)
SELECT paper_id, max(b)::INT AS last_bundle, count(*) AS chunks FROM w GROUP BY paper_id""")
def _(s, d):
    return retrieval.pack_bundles(table(s, d, "paper_chunks"), "paper_id", "chunk_ord", "text", 8000).groupBy("paper_id").agg(F.max("bundle").alias("last_bundle"), F.count("*").alias("chunks"))
