"""Reference strings, reference lists and citations in text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARSED = "authors_text string, first_author string, year string, journal string, volume string, issue string, page string"


def parse_reference(c: Column) -> Column:
    """Struct of authors_text, first_author, year, journal, volume, issue and page of a reference string.

    Numbering is dropped. The authors end at the year; a second equal year is skipped. What follows is split
    at commas: the journal, then volume, (issue) and page by how many parts are left. Fields not found are
    null, as for null and blank strings. All in built-in expressions.
    """
    s = F.regexp_replace(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), r"^(\[\d+\]|\d{1,3}[.)])\s*", "")
    year = F.nullif(F.regexp_extract(s, r"\(?\b((?:19|20)\d{2}[a-z]?)\b\)?", 1), F.lit(""))
    authors = F.nullif(F.regexp_replace(F.regexp_extract(s, r"^(.*?)[,\s]*\(?\b(?:19|20)\d{2}[a-z]?\b", 1), r"[,\s(]+$", ""), F.lit(""))
    rest = F.regexp_replace(F.regexp_extract(s, r"^.*?\(?\b(?:19|20)\d{2}[a-z]?\b\)?[,.]?\s*(.*)$", 1), r"^(?:19|20)\d{2}[a-z]?,\s*", "")
    parts = F.filter(F.transform(F.split(rest, ","), lambda x: F.trim(x)), lambda x: x != "")
    named = F.size(parts) > 0
    has_journal = named & F.regexp_like(parts.getItem(0), F.lit(r"^[^\d].*"))
    tail = F.when(has_journal, F.slice(parts, 2, 100)).otherwise(parts)
    n = F.size(tail)
    first = F.regexp_extract(F.split(authors, r",|;|&|\band\b|\bet al").getItem(0), r"([\p{L}'’-]{2,})", 1)
    return F.struct(
        authors.alias("authors_text"),
        F.nullif(first, F.lit("")).alias("first_author"),
        year.alias("year"),
        F.when(has_journal, parts.getItem(0)).alias("journal"),
        F.when(n >= 1, tail.getItem(0)).alias("volume"),
        F.when(n >= 3, tail.getItem(1)).alias("issue"),
        F.when(n >= 3, tail.getItem(2)).when(n == 2, tail.getItem(1)).alias("page"),
    )


#: Forms of an author-year citation in running text.
CITED = (r"\b(\p{Lu}[\p{L}'’-]+) et al\.?,? \(?((?:19|20)\d{2})", r"\b(\p{Lu}[\p{L}'’-]+) (?:and|&) \p{Lu}[\p{L}'’-]+,? \(?((?:19|20)\d{2})", r"\b(\p{Lu}[\p{L}'’-]+),? \(?((?:19|20)\d{2})")


def citations(c: Column) -> Column:
    """Sorted distinct ``Author|year`` of the author-year citations in a text."""
    hits = F.array().cast("array<string>")
    for p in CITED:
        names, years = F.regexp_extract_all(c, F.lit(p), F.lit(1)), F.regexp_extract_all(c, F.lit(p), F.lit(2))
        hits = F.concat(hits, F.zip_with(names, years, lambda a, y: F.concat(a, F.lit("|"), y)))
    return F.array_sort(F.array_distinct(hits))


def references_section(c: Column) -> Column:
    """Text after the last ``References`` or ``Bibliography`` heading; null without one."""
    return F.nullif(F.regexp_extract(c, r"(?is)^.*\n\s*(?:\d+\.?\s*)?(?:references|bibliography|literature cited)\s*\n(.*)$", 1), F.lit(""))


_START = re.compile(r"\s*(?:\[(\d{1,3})\]|(\d{1,3})[.)])\s+\S")
_AUTHOR = re.compile(r"^[A-ZÀ-Þ][\w'’-]+,? (?:[A-Z]\.[ -]?)+")
_GLUED = re.compile(r"(?<=[\dA-Z]) (?=[A-ZÀ-Þ][\w'’-]+,? [A-Z]\.(?: ?[A-Z]\.)*,)")


def split_references(block: str) -> list[str]:
    """Entries of a reference list: numbered with continuation lines, else by author lines or blank lines, glued entries parted."""
    lines = block.split("\n")
    numbered = [bool(_START.match(x)) for x in lines]
    out: list[str] = []
    if sum(numbered) >= 3:
        for line, start in zip(lines, numbered):
            if start:
                out.append(_START.sub(lambda m: m.group()[-1], line, count=1).strip())
            elif out and line.strip():
                out[-1] += " " + line.strip()
        return out
    fresh = True
    for line in lines:
        s = line.strip()
        if not s:
            fresh = True
        elif fresh or _AUTHOR.match(s):
            out.append(s)
            fresh = False
        else:
            out[-1] += " " + s
    return [p.strip() for e in out for p in _GLUED.split(e) if p.strip()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_references_col(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else split_references(x))


def front_matter(c: Column, most: int = 60_000) -> Column:
    """Text before a numbered Introduction or the References if that lies beyond 400 characters, else its first ``most``."""
    at = F.regexp_instr(c, F.lit(r"(?i)\n\s*1\.?\s+introduction\b|\n\s*references\s*\n"))
    return F.when(at > 400, F.substring(c, F.lit(1), at - 1)).otherwise(F.substring(c, 1, most))


#: Phrases that tell how a work is cited, tried in this order; without any it is background.
PHRASES = {
    "METHOD": (
        "we use", "we adopt", "we apply", "we employ", "we follow", "we perform",
        "based on the method", "based on the technique", "based on observations", "based on the analysis", "derived from", "obtained from",
        "using the method", "using the technique", "following the method", "following the approach", "as described in", "as detailed in", "as proposed by",
        "described in", "described by", "detailed in", "developed by", "proposed by", "calibrated with", "calibrated using", "observed with", "measured with",
        "instrument", "mounted at", "installed at", "serkowski law", "chandrasekhar-fermi", "structure function", "modified bec", "nicer extinction",
        "gaia edr3", "gaia dr2", "hipparcos", "balmer decrement", "polarimetric", "aimpol",
    ),
    "RESULT": (
        "in contrast to", "in contrast with", "unlike", "whereas", "while we", "however we find", "compared to", "compared with",
        "our results", "our findings", "our values", "we find that", "we find:", "we obtain:", "we estimate", "we derive",
        "agree with", "consistent with", "in agreement", "in good agreement", "in qualitative agreement", "disagree with", "inconsistent with",
        "higher than", "lower than", "much larger", "much smaller", "significantly", "substantially", "previously reported", "earlier found",
        "first detected", "first discovered", "revised", "updated", "similar to", "similar to those",
    ),
}
#: Names of techniques.
TECHNIQUES = ("aimpol", "gaia edr3", "gaia dr2", "gaia dr1", "gaia parallax", "serkowski law", "structure function", "chandrasekhar-fermi", "nicer", "bec formula", "bec relation", "balmer decrement", "polarimeter", "2mass", "hipparcos")


def _holds(c: Column, phrases: tuple[str, ...]) -> Column:
    return F.lower(c).rlike("|".join(re.escape(p) for p in phrases))


def context_class(c: Column) -> Column:
    """``METHOD``, else ``RESULT``, else ``BACKGROUND``, by the phrases of a citation context."""
    out = F.lit("BACKGROUND")
    for name in reversed(list(PHRASES)):
        out = F.when(_holds(c, PHRASES[name]), name).otherwise(out)
    return out


def near_technique(c: Column) -> Column:
    """Whether a context names a technique."""
    return _holds(c, TECHNIQUES)


def is_noise(c: Column) -> Column:
    """Contexts that are tables, captions or fragments: more than two digits a letter, a caption, or short and mostly capitals."""
    digits, letters = F.length(F.regexp_replace(c, r"\D", "")), F.length(F.regexp_replace(c, r"\P{L}", ""))
    capitals = F.length(F.regexp_replace(c, r"\P{Lu}", ""))
    return (digits > 2 * letters) | F.lower(c).rlike(r"(fig\.|figure|table|plate)\s+\d") | ((F.length(c) < 30) & (capitals > 0.6 * F.length(c)))


def is_noise_context(c: Column) -> Column:
    """``is_noise``, or nothing but one citation."""
    return is_noise(c) | F.trim(c).rlike(r"^[A-Z][a-z]+ et al\.?\s+\d{4}[a-z]?$")


def citation_patterns(authors: Column, year: Column) -> Column:
    """The forms in which a work of these authors (``Family, Given``) and year is cited in text."""
    family = lambda i: F.trim(F.split(F.trim(F.coalesce(F.try_element_at(authors, F.lit(i)), F.lit(""))), r",|(?<=\S)\s").getItem(0))
    a, b, y = family(1), family(2), F.regexp_extract(F.coalesce(year, F.lit("")), r"(\d{4})", 1)
    several = [F.concat(a, F.lit(sep), y) for sep in (" et al. ", " et al.", " et al ", " + ", " +")]
    pair = [F.when(b != "", F.concat(a, F.lit(sep), b, F.lit(" "), y)) for sep in (" & ", " &", " and ", " and")]
    alone = [F.concat(a, F.lit(" "), y), F.concat(F.lit("("), a, F.lit(" "), y, F.lit(")")), F.concat(F.lit("("), a, F.lit(" et al. "), y, F.lit(")")), F.when(b != "", F.concat(F.lit("("), a, F.lit(" & "), b, F.lit(" "), y, F.lit(")")))]
    return F.when((a != "") & (y != ""), F.array_distinct(F.array_compact(F.array(*several, *pair, *alone)))).otherwise(F.array().cast("array<string>"))


def citation_contexts(docs: DataFrame, id_col: str, text: str, radius: int = 250) -> DataFrame:
    """``id, cited, start, context``: every author-year citation with the text around it, one per 250 characters and work."""
    kind = docs.schema[id_col].dataType.simpleString()
    pats = [re.compile(p.replace(r"\p{Lu}", "[A-ZÀ-ÞŠŽ]").replace(r"[\p{L}'’-]", r"[\w'’-]")) for p in CITED]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["i"], b["t"]):
                seen: set[tuple[str, int]] = set()
                hits = sorted({(m.start(), f"{m.group(1)}|{m.group(2)}") for p in pats for m in p.finditer(t)})
                for at, key in hits:
                    if (key, at // 250) not in seen:
                        seen.add((key, at // 250))
                        out.append((i, key, at, t[max(0, at - radius) : at + radius]))
            yield pd.DataFrame(out, columns=[id_col, "cited", "start", "context"])

    return docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")).where("t is not null").mapInPandas(run, f"{id_col} {kind}, cited string, start int, context string")


#: Names of catalogues and how they are found in text, in any case.
CATALOGS = {
    "2MASS": r"\b2MASS\b", "Gaia": r"\bGaia\b", "Gaia EDR3": r"Gaia\s+EDR3", "Gaia DR2": r"Gaia\s+DR2", "Tycho-2": r"\bTycho[- ]2\b", "Hipparcos": r"\bHipparcos\b",
    "WISE": r"\bWISE\b", "IRAS": r"\bIRAS\b", "Planck": r"\bPlanck\b", "VizieR": r"VizieR", "SIMBAD": r"\bSIMBAD\b", "NED": r"\bNED\b", "SDSS": r"\bSDSS\b", "APASS": r"\bAPASS\b",
    "IRSA": r"\bIRSA\b", "JCMT": r"\bJCMT\b", "ALMA": r"\bALMA\b", "VLT": r"\bVLT\b", "Spitzer": r"\bSpitzer\b", "Herschel": r"\bHerschel\b", "CORAVEL": r"\bCORAVEL\b", "Bica": r"\bBica\b",
    "Kharchenko": r"\bKharchenko\b", "Mend": r"\bMend\b", "DAML": r"\bDAML\b", "WR": r"\bWR\s+catalog",
}


def catalog_mentions(docs: DataFrame, id_col: str, text: str, patterns: dict[str, str] = CATALOGS, shown: int = 3) -> DataFrame:
    """``id, name, occurrences, contexts``: the catalogues a text names, with the first ``shown`` places (40 characters before, 60 after)."""
    c = F.col(text)
    one = lambda k, p: F.struct(
        F.lit(k).alias("name"), F.regexp_count(c, F.lit(f"(?i){p}")).cast("long").alias("occurrences"),
        F.transform(F.slice(F.regexp_extract_all(c, F.lit(f"(?is)(.{{0,40}}{p}.{{0,60}})"), F.lit(1)), 1, shown), lambda x: F.concat(F.lit("..."), F.trim(F.replace(x, F.lit("\n"), F.lit(" "))), F.lit("..."))).alias("contexts"))
    # a text without any of the names is passed over by one pattern
    any_ = docs.where(c.rlike("(?i)" + "|".join(patterns.values())))
    return any_.select(id_col, F.explode(F.array(*[one(k, p) for k, p in patterns.items()])).alias("x")).select(id_col, "x.*").where("occurrences > 0")


def reference_category(df: DataFrame, by: str, context: str, works: DataFrame | None = None) -> DataFrame:
    """Counts of context classes and the category of each cited work: RESULT wins over METHOD over BACKGROUND.

    Contexts that are noise do not count. With ``works`` (a column ``by``) every one of them has a row;
    one without contexts is ``UNCITED``.
    """
    c = context_class(F.col(context))
    g = df.where(~is_noise_context(F.col(context))).groupBy(by).agg(F.count_if(c == "METHOD").alias("n_method"), F.count_if(c == "RESULT").alias("n_result"), F.count_if(c == "BACKGROUND").alias("n_background"))
    if works is not None:
        g = works.select(by).distinct().join(g, by, "left").fillna(0, ["n_method", "n_result", "n_background"])
    any_ = F.col("n_method") + F.col("n_result") + F.col("n_background") > 0
    return g.withColumn("category", F.when(F.col("n_result") > 0, "RESULT").when(F.col("n_method") > 0, "METHOD").when(any_, "BACKGROUND").otherwise("UNCITED"))


def follow_sets(model: Column, cited: Column, method: Column, tight: bool = False) -> Column:
    """References to follow: the union, or with ``tight`` the model's picks that a hint supports (all picks without hints)."""
    union = F.array_sort(F.array_union(F.array_union(model, cited), method))
    if not tight:
        return union
    hints = F.array_union(cited, method)
    return F.array_sort(F.when(F.size(hints) == 0, model).otherwise(F.array_intersect(model, hints)))
