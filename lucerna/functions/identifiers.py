"""Identifiers, titles, journals and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lucerna.functions.text import squeeze

ARXIV = r"(?i)\barxiv:\s*((?:\d{4}\.\d{4,5}|[a-z\-]+(?:\.[a-z]{2})?/\d{7})(?:v\d+)?)"
BARE_ARXIV = r"\b(\d{4}\.\d{4,5}(?:v\d+)?)\b"
DOI = r"(10\.\d{4,}/[^\s\"<>]+)"
BIBCODE = r"((?:19|20)\d{2}[A-Za-z&.]{5}[A-Za-z0-9.]{4}[A-Za-z.][A-Za-z0-9.]{4}[A-Z])"


def _first(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1), F.lit(""))


def strip_arxiv_version(c: Column) -> Column:
    """The id without ``arxiv:`` and version."""
    return F.regexp_replace(F.trim(c), r"(?i)^arxiv:\s*|v\d+$", "")


def arxiv_from_text(c: Column) -> Column:
    """First arXiv id: one with its prefix, else a bare new-style id; without version."""
    return strip_arxiv_version(F.coalesce(_first(c, ARXIV), _first(c, BARE_ARXIV)))


def doi_from_text(c: Column) -> Column:
    """First DOI in small letters, without closing punctuation."""
    return F.lower(F.regexp_replace(_first(c, DOI), r"[.,;:)\]]+$", ""))


def bibcode_from_text(c: Column) -> Column:
    return _first(c, BIBCODE)


def arxiv_variants(c: Column) -> Column:
    """The spellings under which an id may be stored."""
    base = strip_arxiv_version(c)
    return F.array_distinct(F.array(F.trim(c), base, F.concat(base, F.lit("v1")), F.upper(base)))


def line_kind(c: Column) -> Column:
    """``bibcode``, ``doi``, ``arxiv`` or ``text`` for a catalogue line."""
    s = F.trim(c)
    return (
        F.when(s.rlike(f"^{BIBCODE}$"), "bibcode")
        .when(s.rlike(r"(?i)^(doi:\s*|https?://(dx\.)?doi\.org/)?10\.\d{4,}/\S+$"), "doi")
        .when(s.rlike(r"(?i)^(arxiv:\s*)?(\d{4}\.\d{4,5}|[a-z\-]+(\.[a-z]{2})?/\d{7})(v\d+)?$"), "arxiv")
        .otherwise("text")
    )


def catalog_identifiers(c: Column) -> Column:
    """``bibcode, arxiv, doi`` of a catalogue line."""
    k = line_kind(c)
    return F.struct(F.when(k == "bibcode", F.trim(c)).alias("bibcode"), F.when(k == "arxiv", arxiv_from_text(c)).alias("arxiv"), F.when(k == "doi", doi_from_text(c)).alias("doi"))


def last_prefixed(c: Column, prefix: str) -> Column:
    """The last element of an array that starts with ``prefix``, without it."""
    hits = F.filter(c, lambda x: F.startswith(F.lower(x), F.lit(prefix)))
    return F.substring(F.try_element_at(hits, F.lit(-1)), len(prefix) + 1, 10_000)


def all_dois(doi: Column, identifiers: Column) -> Column:
    """Distinct DOIs of the doi field and of ``doi:`` identifiers, in small letters."""
    given = F.array(F.lower(F.trim(doi)))
    more = F.transform(F.filter(identifiers, lambda x: F.startswith(F.lower(x), F.lit("doi:"))), lambda x: F.lower(F.trim(F.substring(x, 5, 10_000))))
    return F.array_distinct(F.filter(F.concat(given, F.coalesce(more, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != "")))


def is_eprint(c: Column) -> Column:
    return F.contains(F.upper(c), F.lit("ARXIV"))


def plain_title(c: Column) -> Column:
    """Dashes and quotes folded, blanks collapsed, closing ``:;,`` removed."""
    return F.regexp_replace(squeeze(F.translate(c, "–—−‐‘’“”", "----''\"\"")), r"[:;,\s]+$", "")


def short_label(c: Column, most: int = 80) -> Column:
    s = squeeze(c)
    return F.when(F.length(s) > most, F.concat(F.rtrim(F.substring(s, 1, most - 1)), F.lit("…"))).otherwise(s)


def match_form(c: Column) -> Column:
    """Small letters without blanks, hyphens, quotes and commas."""
    return F.regexp_replace(F.lower(c), r"[\s\-'\",]", "")


def safe_stem(c: Column, most: int = 120) -> Column:
    """A file name stem of word characters, hyphens and dots."""
    return F.substring(F.regexp_replace(F.trim(c), r"[^\w\-.]+", "_"), 1, most)


def abstract_url(bibcode: Column, base: str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/abs/"), F.url_encode(bibcode))


def text_hash(c: Column, n: int = 32) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def clipped(c: Column, most: int) -> Column:
    """``text, cut`` of the stripped text: 55 % head, a mark with about how much is left out, and a tail of what remains, 4,000 characters at least."""
    t = F.trim(c)
    head = int(most * 0.55)
    tail = max(4000, most - head - 120)
    mark = F.concat(F.lit("\n\n---\n[... 已省略约 "), (F.length(t) - most + 120).cast("string"), F.lit(" 字符 ...]\n---\n\n"))
    long = (F.length(t) > most) & F.lit(most > 0)
    return F.struct(F.when(long, F.concat(F.substring(t, 1, head), mark, F.right(t, F.lit(tail)))).otherwise(t).alias("text"), long.alias("cut"))


def tsv_to_markdown(c: Column) -> Column:
    """A tab-separated table as a Markdown table; its first line is the header."""
    rows = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    line = lambda x: F.concat(F.lit("| "), F.replace(x, F.lit("\t"), F.lit(" | ")), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.split(rows.getItem(0), "\t"))))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(rows.getItem(0)), rule), F.transform(F.slice(rows, 2, 1_000_000), line)), "\n"))


#: Spellings of journals (capitals, without stops) and their usual short names.
JOURNALS = {
    "A&A": "A&A", "AA": "A&A", "ASTRONOMY & ASTROPHYSICS": "A&A", "APJ": "ApJ", "ASTROPHYSICAL JOURNAL": "ApJ", "APJL": "ApJL", "APJS": "ApJS",
    "MNRAS": "MNRAS", "MNRA": "MNRAS", "MONTHLY NOTICES OF THE ROYAL ASTRONOMICAL SOCIETY": "MNRAS", "MON NOT R ASTRON SOC": "MNRAS",
    "AJ": "AJ", "ASTRONOMICAL JOURNAL": "AJ", "PASP": "PASP", "PUBLICATIONS OF THE ASTRONOMICAL SOCIETY OF THE PACIFIC": "PASP",
    "NATURE": "Nature", "SCIENCE": "Science", "ARA&A": "ARA&A", "ANNUAL REVIEW OF ASTRONOMY AND ASTROPHYSICS": "ARA&A",
    "BAAA": "BAAA", "BOLETIN DE LA ASOCIACION ARGENTINA DE ASTRONOMIA": "BAAA", "ICARUS": "Icarus", "ASTRON ASTROPHYS REV": "Astron Astrophys Rev",
    "PASJ": "PASJ", "PUBLICATIONS OF THE ASTRONOMICAL SOCIETY OF JAPAN": "PASJ",
}
#: Short names whose stem in a bibcode is another.
STEMS = {"Astron Astrophys Rev": "A&ARv"}


def canonical_journal(c: Column, aliases: dict[str, str] = JOURNALS) -> Column:
    """The short name of a known spelling (in any case, stops aside), else the squeezed name."""
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    s = squeeze(c)
    return F.when(s != "", F.coalesce(F.try_element_at(known, F.replace(F.upper(s), F.lit("."), F.lit(""))), s))


def journal_stem(c: Column, aliases: dict[str, str] = JOURNALS) -> Column:
    """The stem under which a journal stands in bibcodes; null for an unknown one."""
    short = {v.upper().replace(".", ""): STEMS.get(v, v) for v in aliases.values()}
    known = F.create_map(*[F.lit(x) for kv in short.items() for x in kv])
    return F.try_element_at(known, F.replace(F.upper(squeeze(c)), F.lit("."), F.lit("")))


def journal_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z]", "")


def arxiv_with_context(c: Column) -> Column:
    """An id after ``arXiv:``, in an address or in brackets after ``arXiv``; else a bare one within 25 characters after the word."""
    new = r"(\d{4}\.\d{4,5}(?:v\d+)?)"
    prefixed = [rf"(?i)arxiv\s*:\s*{new}", rf"(?i)arxiv\.org/(?:abs|pdf)/{new}", rf"(?i)\[\s*arxiv\s*:?\s*{new}"]
    return strip_arxiv_version(F.coalesce(*[_first(c, p) for p in prefixed], _first(c, rf"(?is)arxiv.{{0,25}}?\b{new}\b")))


def retrieval_query(question: Column, boost: Column, most: int = 6000) -> Column:
    """The question and, where there is one, the excerpt that led here, cut to ``most`` characters."""
    q, b = F.trim(F.coalesce(question, F.lit(""))), F.trim(F.coalesce(boost, F.lit("")))
    return F.substring(F.when(b == "", q).otherwise(F.concat(q, F.lit("\n\n"), b)), 1, most)


def visible_answer(c: Column) -> Column:
    """A model's answer without what it thought and without code fences."""
    s = F.regexp_replace(c, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(s), r"(?s)^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def json_object(c: Column) -> Column:
    """The outermost JSON object of an answer as text; null where it does not parse."""
    body = F.regexp_extract(visible_answer(c), r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), body)


def page_numbers(c: Column) -> Column:
    """``1,3-5`` as the sorted distinct numbers 1, 3, 4, 5."""
    span = lambda x: F.sequence(F.regexp_extract(x, r"^(\d+)", 1).cast("int"), F.greatest(F.coalesce(F.expr("null").cast("int"), F.regexp_extract(x, r"(\d+)$", 1).cast("int")), F.regexp_extract(x, r"^(\d+)", 1).cast("int")))
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+(\s*-\s*\d+)?$"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, span))))


def data_products(c: Column) -> Column:
    """``IRSA:2,SIMBAD:52`` as an array of ``provider, n``."""
    parts = F.filter(F.split(c, ","), lambda x: F.trim(x).rlike(r"^[^:]+:\d+$"))
    return F.transform(parts, lambda x: F.struct(F.trim(F.split(x, ":").getItem(0)).alias("provider"), F.trim(F.split(x, ":").getItem(1)).cast("int").alias("n")))
