"""Front pages of papers: titles from mastheads, identifiers, and what a text says about its works."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucerna.functions.identifiers import arxiv_with_context, doi_from_text
from lucerna.functions.references import front_matter

_MASTHEAD = re.compile(r"^(?:\W*(?:mnras|monthly notices|the astro\w+ journal|astronomy (?:&|and) astro\w+|preprint|draft version|compiled using|accepted|received|submitted|doi|https?:|arxiv))", re.I)
_STOP = re.compile(r"^\s*(?:abstract|a\s?b\s?s\s?t\s?r\s?a\s?c\s?t|keywords?|1\.?\s+introduction|introduction)\b", re.I)
_AUTHOR = re.compile(r"(?:[A-Z]\.\s*){1,3}[A-Z][\w'’-]+|[A-Z][\w'’-]+(?:\s+[A-Z]\.)*(?:\s+[A-Z][\w'’-]+)?(?:\s*[\d,∗*†‡]+)+|\bet al\b")


def is_author_line(line: str) -> bool:
    """Whether a line lists people: two names with initials or marks, or such a name beside ``and`` or a comma."""
    names = _AUTHOR.findall(line)
    return len(names) >= 2 or bool(names) and bool(re.search(r"\band\b|&|,", line)) and not line.endswith(".")


def masthead_title(text: str) -> str | None:
    """The title between a masthead and the authors: the first lines in words before a line of people or the abstract; null without a masthead."""
    lines = [x.strip() for x in text.split("\n")[:60]]
    at = next((k for k, x in enumerate(lines[:12]) if _MASTHEAD.match(x)), None)
    if at is None:
        return None
    title: list[str] = []
    for x in lines[at + 1 :]:
        if _MASTHEAD.match(x):
            continue
        if _STOP.match(x) or (x and is_author_line(x)):
            break
        if not x:
            if title:
                break
            continue
        if sum(c.isalpha() for c in x) * 2 > len(x):
            title.append(x)
        if len(title) == 4:
            break
    out = " ".join(title)
    return out if 12 <= len(out) <= 300 else None


def title_candidate(text: str) -> str | None:
    """A line early in the text that may be a title: 20 to 200 characters, four words, no citation, not the abstract."""
    for x in (x.strip() for x in text.split("\n")[:30]):
        if 20 <= len(x) <= 200 and len(x.split()) >= 4 and not _MASTHEAD.match(x) and not _STOP.match(x) and not is_author_line(x) and not re.search(r"\((?:19|20)\d\d\)|\babstract\b|10\.\d{4,}/", x, re.I):
            return x
    return None


@F.pandas_udf(T.StructType([T.StructField("masthead", T.StringType()), T.StructField("candidate", T.StringType())]))
def titles(s: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if x is None else (masthead_title(x), title_candidate(x)) for x in s]
    return pd.DataFrame(rows, columns=["masthead", "candidate"])


def document_identifiers(clean: Column, raw: Column) -> Column:
    """``doi, arxiv, title``: from the front matter, then the text before the references; from the raw strings only where the text has no masthead title."""
    front = front_matter(clean)
    head = F.regexp_replace(F.coalesce(clean, F.lit("")), r"(?is)\n\s*(?:references|bibliography)\s*\n.*$", "")
    found = titles(clean)
    loose = F.when(found["masthead"].isNull(), raw)
    pick = lambda f: F.coalesce(f(front), f(head), f(F.coalesce(loose, F.lit(""))))
    return F.struct(pick(doi_from_text).alias("doi"), pick(arxiv_with_context).alias("arxiv"), F.coalesce(found["masthead"], found["candidate"]).alias("title"))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts in small letters; missing ones are empty."""
    return pd.Series([difflib.SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b)], dtype="float64")


def bonus(year: tuple[Column, Column], volume: tuple[Column, Column], page: tuple[Column, Column], issue: tuple[Column, Column], journal: tuple[Column, Column]) -> Column:
    """Points of a candidate for a parsed reference: 20 for the year, 15 for the volume, 20 for the page, 10 for the issue, 15 for a journal that holds the name; each pair is (reference, candidate)."""
    have = lambda x: x.isNotNull() & (x != "")
    same = lambda p, n: F.when(have(p[0]) & (p[0] == F.coalesce(p[1], F.lit(""))), n).otherwise(0)
    upper = tuple(F.upper(F.coalesce(x, F.lit(""))) for x in page)
    return (
        same(year, 20) + same(volume, 15) + F.when((upper[0] != "") & (upper[0] == upper[1]), 20).otherwise(0) + same(issue, 10)
        + F.when(have(journal[0]) & have(journal[1]) & F.contains(F.lower(journal[1]), F.lower(journal[0])), 15).otherwise(0)
    )


def query_ladder(author: Column, year: Column, journal: Column, stem: Column, volume: Column, page: Column, issue: Column, authors_text: Column) -> Column:
    """The search strings for a reference, from the strictest down: sets of two fields or more, each once, then free text."""
    some = lambda c, text: F.when(c.isNotNull() & (c != ""), text)
    a, y = some(author, F.concat(F.lit('author:"'), author, F.lit('"'))), some(year, F.concat(F.lit("year:"), year))
    v, i = some(volume, F.concat(F.lit("volume:"), volume)), some(issue, F.concat(F.lit("issue:"), issue))
    p = some(page, F.concat(F.lit("(page:"), page, F.lit(" OR eid:"), page, F.lit(")")))
    pub = some(journal, F.concat(F.lit('pub:"'), journal, F.lit('"')))
    bib = some(stem, F.when(stem.rlike("^[A-Za-z0-9]+$"), F.concat(F.lit("bibstem:"), stem)).otherwise(F.concat(F.lit('bibstem:"'), stem, F.lit('"'))))
    steps = [[a, y, pub, v, p, i], [a, y, bib, v, p, i], [a, y, v, p, i], [a, y, bib, v, i], [a, y, pub, v], [a, y, bib, v], [a, y, pub], [a, y, bib]]
    joined = []
    for parts in steps:
        x = F.array_compact(F.array(*parts))
        joined.append(F.when(F.size(x) >= 2, F.array_join(x, " AND ")))
    free = F.concat_ws(" ", *[some(c, c) for c in (authors_text, year, journal, volume, issue, page)])
    return F.array_distinct(F.array_compact(F.array(*joined, F.nullif(free, F.lit("")))))


#: Words of a reference's head that are no names.
_PARTICLES = ("the", "and", "for", "von", "van", "der", "los", "las")


def _word_in(word: Column, text: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit(r"(?<![a-z])\Q"), word, F.lit(r"\E(?![a-z])")))


def line_score(line: Column, hits: Column, hay: Column) -> Column:
    """Points of a reference line for a text: for each cited author and year (``hits``: ``name|year``) whose year it has, 25 with the name in the line, else 10 if the text has it; 3 for each of its years and 2 for each name of its head that the text has."""
    low = F.lower(line)
    by_hit = lambda acc, h: acc + F.when(F.contains(line, F.split(h, r"\|").getItem(1)), F.when(_word_in(F.lower(F.split(h, r"\|").getItem(0)), low), 25).when(_word_in(F.lower(F.split(h, r"\|").getItem(0)), hay), 10).otherwise(0)).otherwise(0)
    years = F.regexp_extract_all(line, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    heads = F.filter(F.transform(F.regexp_extract_all(F.trim(F.split(line, ",").getItem(0)), F.lit(r"([A-Za-z][A-Za-z'`\-]{2,})"), F.lit(1)), lambda x: F.lower(x)), lambda x: ~x.isin(*_PARTICLES))
    return (
        F.aggregate(hits, F.lit(0), by_hit)
        + F.aggregate(years, F.lit(0), lambda acc, y: acc + F.when(F.contains(hay, y), 3).otherwise(0))
        + F.aggregate(heads, F.lit(0), lambda acc, t: acc + F.when(_word_in(t, hay), 2).otherwise(0))
    )
