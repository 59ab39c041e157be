"""Identifiers, reference strings, contexts and source cleaning."""

from pyspark.sql import functions as F

from lucerna.functions import clean, identifiers, references
from lucerna.functions.text import squeeze
from lucerna.plans.base import query, table


@query("c1_squeeze", r"SELECT ref_id, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS raw FROM parsed_references")
def _(s, d):
    return table(s, d, "parsed_references").select("ref_id", squeeze(F.col("raw")).alias("raw"))


@query("c4_arxiv_ids", r"SELECT id, regexp_replace(regexp_replace(trim(arxiv_id), '(?i)^arxiv:\s*', ''), '(?i)v[0-9]+$', '') AS arxiv_id FROM papers")
def _(s, d):
    return table(s, d, "papers").select("id", identifiers.strip_arxiv_version(F.col("arxiv_id")).alias("arxiv_id"))


@query("c8_line_kinds", r"""
WITH l AS (SELECT cand_id, trim(coalesce(bibcode, doi, arxiv_id, title)) AS s FROM candidates)
SELECT cand_id, CASE WHEN regexp_full_match(s, '(19|20)[0-9]{2}[A-Za-z&.]{5}[A-Za-z0-9.]{4}[A-Za-z.][A-Za-z0-9.]{4}[A-Z]') THEN 'bibcode' WHEN regexp_matches(s, '(?i)^(doi:\s*|https?://(dx\.)?doi\.org/)?10\.[0-9]{4,}/\S+$') THEN 'doi'
WHEN regexp_matches(s, '(?i)^(arxiv:\s*)?([0-9]{4}\.[0-9]{4,5}|[a-z\-]+(\.[a-z]{2})?/[0-9]{7})(v[0-9]+)?$') THEN 'arxiv' ELSE 'text' END AS kind FROM l""")
def _(s, d):
    return table(s, d, "candidates").select("cand_id", identifiers.line_kind(F.coalesce("bibcode", "doi", "arxiv_id", "title")).alias("kind"))


@query("c13_labels", "SELECT id, CASE WHEN length(t) > 60 THEN rtrim(substring(t, 1, 59)) || '…' ELSE t END AS label FROM (SELECT id, trim(regexp_replace(title, '[\\s  -   　\u0085]+', ' ', 'g')) AS t FROM papers)")
def _(s, d):
    return table(s, d, "papers").select("id", identifiers.short_label(F.col("title"), 60).alias("label"))


@query("c15_match_form", r"SELECT ref_id, regexp_replace(lower(first_author), '[\s\-'',""]', '', 'g') AS form FROM parsed_references")
def _(s, d):
    return table(s, d, "parsed_references").select("ref_id", identifiers.match_form(F.col("first_author")).alias("form"))


@query("c18_safe_stems", r"SELECT id, substring(regexp_replace(trim(pdf_relpath), '[^A-Za-z0-9_\-.]+', '_', 'g'), 1, 120) AS stem FROM papers")
def _(s, d):
    return table(s, d, "papers").select("id", identifiers.safe_stem(F.col("pdf_relpath")).alias("stem"))


@query("c22_text_hash", "SELECT id, substr(sha256(text), 1, 32) AS text_hash, text_hash = substr(sha256(text), 1, 32) AS fresh FROM paper_chunks")
def _(s, d):
    h = identifiers.text_hash(F.col("text"))
    return table(s, d, "paper_chunks").select("id", (F.col("text_hash") == h).alias("fresh"), h.alias("text_hash"))


_S = r"regexp_replace(trim(regexp_replace(raw, '\s+', ' ', 'g')), '^(\[[0-9]+\]|[0-9]{1,3}[.)])\s*', '')"


@query("r1_reference_fields", rf"""
WITH s AS (SELECT ref_id, {_S} AS s FROM parsed_references),
y AS (SELECT ref_id, s, nullif(regexp_extract(s, '\(?\b((19|20)[0-9]{{2}}[a-z]?)\b\)?', 1), '') AS year, regexp_replace(regexp_extract(s, '^.*?\(?\b(?:19|20)[0-9]{{2}}[a-z]?\b\)?[,.]?\s*(.*)$', 1), '^(19|20)[0-9]{{2}}[a-z]?,\s*', '') AS rest FROM s),
p AS (SELECT ref_id, year, [trim(x) FOR x IN string_split(rest, ',') IF trim(x) <> ''] AS parts FROM y),
q AS (SELECT ref_id, year, len(parts) > 0 AND regexp_matches(parts[1], '^[^0-9]') AS hj, parts FROM p),
t AS (SELECT ref_id, year, CASE WHEN hj THEN parts[1] END AS journal, CASE WHEN hj THEN parts[2:] ELSE parts END AS tail FROM q)
SELECT ref_id, year, journal, CASE WHEN len(tail) >= 1 THEN tail[1] END AS volume, CASE WHEN len(tail) >= 3 THEN tail[2] END AS issue, CASE WHEN len(tail) >= 3 THEN tail[3] WHEN len(tail) = 2 THEN tail[2] END AS page FROM t""")
def _(s, d):
    p = references.parse_reference(F.col("raw"))
    return table(s, d, "parsed_references").withColumn("p", p).select("ref_id", "p.year", "p.journal", "p.volume", "p.issue", "p.page")


@query("r16_citations")
def _(s, d):
    return table(s, d, "paper_chunks").select("id", references.citations(F.col("text")).alias("cited")).where("size(cited) > 0")


@query("r18_contexts")
def _(s, d):
    return references.citation_contexts(table(s, d, "paper_chunks"), "id", "text")


_METHOD = "we use|we adopt|we apply|we employ|we follow|we perform|based on the method|based on the technique|based on observations|based on the analysis|derived from|obtained from|using the method|using the technique|following the method|following the approach|as described in|as detailed in|as proposed by|described in|described by|detailed in|developed by|proposed by|calibrated with|calibrated using|observed with|measured with|instrument|mounted at|installed at|serkowski law|chandrasekhar-fermi|structure function|modified bec|nicer extinction|gaia edr3|gaia dr2|hipparcos|balmer decrement|polarimetric|aimpol"
_RESULT = "in contrast to|in contrast with|unlike|whereas|while we|however we find|compared to|compared with|our results|our findings|our values|we find that|we find:|we obtain:|we estimate|we derive|agree with|consistent with|in agreement|in good agreement|in qualitative agreement|disagree with|inconsistent with|higher than|lower than|much larger|much smaller|significantly|substantially|previously reported|earlier found|first detected|first discovered|revised|updated|similar to|similar to those"
_CLASS = f"CASE WHEN regexp_matches(t, '{_METHOD}') THEN 'METHOD' WHEN regexp_matches(t, '{_RESULT}') THEN 'RESULT' ELSE 'BACKGROUND' END"


@query("r19_context_class", f"SELECT id, {_CLASS} AS cls FROM (SELECT id, lower(text) AS t FROM paper_chunks)")
def _(s, d):
    return table(s, d, "paper_chunks").select("id", references.context_class(F.col("text")).alias("cls"))


@query("p20_near_technique", "SELECT id FROM paper_chunks WHERE regexp_matches(lower(text), 'aimpol|gaia edr3|gaia dr2|gaia dr1|gaia parallax|serkowski law|structure function|chandrasekhar-fermi|nicer|bec formula|bec relation|balmer decrement|polarimeter|2mass|hipparcos')")
def _(s, d):
    return table(s, d, "paper_chunks").where(references.near_technique(F.col("text"))).select("id")


# one row for every place at which a form of citation begins, in DuckDB
_CITED = [r"(\p{Lu}[\p{L}''’-]+) et al\.?,? \(?((?:19|20)\d{2})", r"(\p{Lu}[\p{L}''’-]+) (?:and|&) \p{Lu}[\p{L}''’-]+,? \(?((?:19|20)\d{2})", r"(\p{Lu}[\p{L}''’-]+),? \(?((?:19|20)\d{2})"]


@query("a14_reference_category")
def _(s, d):
    return references.reference_category(references.citation_contexts(table(s, d, "paper_chunks"), "id", "text"), "cited", "context")


@query("a14_category_of_chunks", f"""
WITH n AS (SELECT paper_id, {_CLASS} AS cls FROM (SELECT paper_id, lower(text) AS t, text FROM paper_chunks) WHERE NOT ((length(regexp_replace(text, '[^0-9]', '', 'g')) > 2 * length(regexp_replace(text, '\\P{{L}}', '', 'g'))) OR regexp_matches(t, '(fig\\.|figure|table|plate)\\s+[0-9]') OR (length(text) < 30 AND length(regexp_replace(text, '\\P{{Lu}}', '', 'g')) > 0.6 * length(text)) OR regexp_matches(trim(text), '^[A-Z][a-z]+ et al\\.?\\s+[0-9]{{4}}[a-z]?$'))),
g AS (SELECT paper_id, count(*) FILTER (cls = 'METHOD') AS n_method, count(*) FILTER (cls = 'RESULT') AS n_result, count(*) FILTER (cls = 'BACKGROUND') AS n_background FROM n GROUP BY 1)
SELECT p.id AS paper_id, coalesce(n_method, 0) AS n_method, coalesce(n_result, 0) AS n_result, coalesce(n_background, 0) AS n_background,
CASE WHEN n_result > 0 THEN 'RESULT' WHEN n_method > 0 THEN 'METHOD' WHEN n_background > 0 THEN 'BACKGROUND' ELSE 'UNCITED' END AS category FROM papers p LEFT JOIN g ON g.paper_id = p.id""")
def _(s, d):
    return references.reference_category(table(s, d, "paper_chunks"), "paper_id", "text", table(s, d, "papers").select(F.col("id").alias("paper_id")))


@query("f13_noise", r"""
SELECT id, (length(regexp_replace(text, '[^0-9]', '', 'g')) > 2 * length(regexp_replace(text, '\P{L}', '', 'g'))) OR regexp_matches(lower(text), '(fig\.|figure|table|plate)\s+[0-9]') OR (length(text) < 30 AND length(regexp_replace(text, '\P{Lu}', '', 'g')) > 0.6 * length(text)) AS noise FROM paper_chunks""")
def _(s, d):
    return table(s, d, "paper_chunks").select("id", references.is_noise(F.col("text")).alias("noise"))


@query("r22_headings", r"SELECT id, array_to_string(regexp_extract_all(text, '(?m)^\s*[0-9]+(?:\.[0-9]+)*\.?\s+(\p{Lu}[^\n.]{2,80})$', 1), '|') AS headings FROM paper_chunks WHERE regexp_matches(text, '(?m)^\s*[0-9]+(\.[0-9]+)*\.?\s+\p{Lu}[^\n.]{2,80}$')")
def _(s, d):
    return table(s, d, "paper_chunks").select("id", F.array_join(clean.headings(F.col("text")), "|").alias("headings")).where("headings <> ''")


_NAMED = {"Corvane array": r"\\bCorvane\\b", "Halvern": r"Halvern\\s+interferometer"}
_FOUND = """WITH x AS (SELECT name, id, p, regexp_extract_all(text, '(?is).{{0,40}}' || p || '.{{0,60}}') AS c, len(regexp_extract_all(text, '(?i)' || p)) AS n FROM paper_chunks, (VALUES {rows}) AS t(name, p))
SELECT id, name, n AS occurrences FROM x WHERE n > 0"""


@query("a21_catalog_mentions", _FOUND.format(rows=", ".join(f"('{k}', '{v.replace(chr(92) * 2, chr(92))}')" for k, v in _NAMED.items())))
def _(s, d):
    found = references.catalog_mentions(table(s, d, "paper_chunks"), "id", "text", {"Corvane array": r"\bCorvane\b", "Halvern": r"Halvern\s+interferometer"})
    return found.select("id", "name", "occurrences")


@query("p27_catalogs", r"""
WITH t(name, p) AS (VALUES ('2MASS', '\b2MASS\b'), ('Gaia', '\bGaia\b'), ('Gaia EDR3', 'Gaia\s+EDR3'), ('Gaia DR2', 'Gaia\s+DR2'), ('Tycho-2', '\bTycho[- ]2\b'), ('Hipparcos', '\bHipparcos\b'), ('WISE', '\bWISE\b'), ('IRAS', '\bIRAS\b'), ('Planck', '\bPlanck\b'), ('VizieR', 'VizieR'), ('SIMBAD', '\bSIMBAD\b'), ('NED', '\bNED\b'), ('SDSS', '\bSDSS\b'), ('APASS', '\bAPASS\b'), ('IRSA', '\bIRSA\b'), ('JCMT', '\bJCMT\b'), ('ALMA', '\bALMA\b'), ('VLT', '\bVLT\b'), ('Spitzer', '\bSpitzer\b'), ('Herschel', '\bHerschel\b'), ('CORAVEL', '\bCORAVEL\b'), ('Bica', '\bBica\b'), ('Kharchenko', '\bKharchenko\b'), ('Mend', '\bMend\b'), ('DAML', '\bDAML\b'), ('WR', '\bWR\s+catalog'))
SELECT id, name, n AS occurrences FROM (SELECT id, name, len(regexp_extract_all(text, '(?i)' || p)) AS n FROM paper_chunks, t) WHERE n > 0""")
def _(s, d):
    return references.catalog_mentions(table(s, d, "paper_chunks"), "id", "text").select("id", "name", "occurrences")


@query("p17_patterns", r"""
WITH a AS (SELECT cand_id, trim(regexp_split_to_array(trim(authors[1]), ',|\s')[1]) AS f, coalesce(trim(regexp_split_to_array(trim(authors[2]), ',|\s')[1]), '') AS g, regexp_extract(year, '([0-9]{4})', 1) AS y FROM candidates WHERE len(authors) > 0 AND year IS NOT NULL)
SELECT cand_id, 8 + CASE WHEN g <> '' THEN 5 ELSE 0 END AS n FROM a WHERE f <> '' AND y <> ''""")
def _(s, d):
    return table(s, d, "candidates").select("cand_id", F.size(references.citation_patterns(F.transform("authors", lambda a: F.regexp_replace(F.trim(a), r"^([^,\s]+).*$", "$1")), F.col("year"))).cast("long").alias("n")).where("n > 0")
