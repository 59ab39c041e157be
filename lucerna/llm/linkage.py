"""Problem 5: records of the same works in two tables without a shared key.

Method: probabilistic record linkage. Several blocking passes propose pairs of distinct records, each
attribute is compared on agreement levels, expectation-maximisation estimates the match and non-match
probabilities of the levels over all patterns, and the posterior is the confidence of a pair.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucerna.functions.text import fold, present, squeeze
from lucerna.runtime import cut

FIELDS = ["surname", "year", "journal", "volume", "page"]
_SMALL = frozenset("a an and for in of on the und der et de".split())


def _tokens(name: str) -> list[str]:
    return [t for t in re.findall(r"[a-z]+", name.lower()) if t not in _SMALL]


def match_journal(name: str, known: list[tuple[str, list[str]]]) -> str:
    """Short name of the journal that ``name`` spells or abbreviates, else the name's own letters.

    A name fits when its letters equal a known spelling, or when its words abbreviate the words of a full
    name in order (initials, truncations, one or two typing errors).
    """
    letters = re.sub(r"[^a-z]", "", name.lower())
    if not letters:
        return ""
    for short, forms in known:
        if any(letters == re.sub(r"[^a-z]", "", f.lower()) for f in forms):
            return short
    toks, best = _tokens(name), []
    for short, forms in known:
        full = max((_tokens(f) for f in forms), key=lambda t: sum(map(len, t)))
        if len(toks) == len(full) and all(_abbreviates(a, b) for a, b in zip(toks, full)):
            best.append(short)
        elif len(toks) == 1 and len(full) > 1 and letters == "".join(t[0] for t in full):
            best.append(short)
        elif len(letters) > 7 and any(_near(letters, x, 2) for x in ("".join(full), *(re.sub(r"[^a-z]", "", f.lower()) for f in forms if len(f) > 12))):
            best.append(short)
    return best[0] if len(set(best)) == 1 else letters


def _abbreviates(a: str, b: str) -> bool:
    if b.startswith(a) or _near(a, b, 1 if len(b) < 8 else 2):
        return True
    if len(a) < 3 or a[0] != b[0]:
        return False
    it = iter(b)
    return all(ch in it for ch in a)


def _near(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` letters were changed, added, lost or swapped."""
    if abs(len(a) - len(b)) > most:
        return False
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, prev2[j - 2] + 1)
            cur.append(v)
        prev2, prev = prev, cur
    return prev[-1] <= most


def _number(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d+)", 1)


def _page(c: Column) -> Column:
    return F.regexp_extract(F.upper(F.coalesce(c, F.lit(""))), r"([A-Z]?\d+)", 1)


#: Words of collaboration names that tell no two of them apart.
_GENERIC = r"\b(the|survey|coll|collab\w*|colaboration|consortium|team|group|project|et al)\b\.?"


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often the expression names it."""
    return F.transform(F.array(value), use).getItem(0)


def _family(c: Column) -> Column:
    """Folded family name: before a comma, else before trailing initials, else the longer of the first and last word; empty if none."""

    def pick(name: Column) -> Column:
        head = F.regexp_extract(name, r"^([\p{L}'’-]{3,})[^,]*,", 1)
        initials = F.regexp_extract(name, r"^([\p{L}'’-]{3,})(?:\s+\p{L}\.?-?)+$|^([\p{L}'’-]{3,})\s+(?:\p{L}\.\s*-?)+$", 1)
        words = F.regexp_extract_all(name, F.lit(r"([\p{L}'’-]{3,})"), F.lit(1))
        first, last = F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")), F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))
        return F.when(head != "", head).when(initials != "", initials).when(F.length(last) >= F.length(first), last).otherwise(first)

    return _bind(F.trim(F.regexp_replace(fold(squeeze(c)), _GENERIC, " ")), pick)


def _surname(c: Column) -> Column:
    """Family name of the first of the names in ``c``."""
    return F.coalesce(_family(F.regexp_replace(c, r"[;&].*$|\band\b.*$", "")), F.lit(""))


def reference_features(refs: DataFrame) -> DataFrame:
    """``ref_id`` and the comparable fields of parsed references; missing values are empty strings."""
    names = F.expr("filter(transform(split(regexp_replace(coalesce(authors_text, ''), '\\\\bet al\\\\b\\\\.?', ''), '[,;&]|\\\\band\\\\b'), x -> trim(x)), x -> x <> '')")
    return refs.select(
        F.col("ref_id"),
        _surname(F.coalesce(present(F.col("first_author")), F.split(F.col("authors_text"), ",").getItem(0), F.lit(""))).alias("surname"),
        F.regexp_extract(F.coalesce(F.col("year"), F.lit("")), r"((?:19|20)\d\d)", 1).alias("year"),
        F.coalesce(present(F.col("journal")), F.lit("")).alias("journal_raw"),
        _number(present(F.col("volume"))).alias("volume"),
        _page(present(F.col("page"))).alias("page"),
        names.alias("names"),
    )


def candidate_features(cands: DataFrame) -> DataFrame:
    """``cand_id`` and the comparable fields of lookup results; missing values are empty strings."""
    bib = F.upper(F.coalesce(present(F.col("bibcode")), F.lit("")))
    good = bib.rlike(r"^\d{4}[A-Z&.]{5}[.\d]{4}.[.\d]{4}.$")
    return cands.select(
        F.col("cand_id"),
        _surname(F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit(""))).alias("surname"),
        F.regexp_extract(F.coalesce(F.col("year"), F.lit("")), r"((?:19|20)\d\d)", 1).alias("year"),
        F.coalesce(present(F.col("journal")), F.when(good, F.rtrim(F.regexp_replace(F.substring(bib, 5, 5), r"\.", " "))), F.lit("")).alias("journal_raw"),
        F.coalesce(F.nullif(_number(present(F.col("volume"))), F.lit("")), F.when(good, _number(F.substring(bib, 10, 4))), F.lit("")).alias("volume"),
        F.coalesce(F.nullif(_page(present(F.col("page"))), F.lit("")), F.when(good, _number(F.substring(bib, 15, 4))), F.lit("")).alias("page"),
        F.when(good, F.substring(bib, 1, 4)).otherwise("").alias("year2"),
        F.coalesce(F.col("authors"), F.array().cast("array<string>")).alias("names"),
    )


def _with_journal(df: DataFrame, known: list[tuple[str, list[str]]]) -> DataFrame:
    """Adds ``journal``; every distinct spelling is matched once."""

    @F.pandas_udf(T.StringType())
    def to_short(s: pd.Series) -> pd.Series:
        return s.map(lambda n: match_journal(n or "", known))

    names = df.select("journal_raw").distinct().withColumn("journal", to_short("journal_raw"))
    return df.join(names, "journal_raw").drop("journal_raw")


def _people(c: Column) -> Column:
    """Sorted folded family names."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, _family), lambda x: x != "")))


PASSES = {
    "surname+year": ["surname", "year"], "volume+page": ["volume", "page"], "year+page": ["year", "page"], "surname+page": ["surname", "page"],
    "surname+volume": ["surname", "volume"], "journal+volume+year": ["journal", "volume", "year"], "journal+page": ["journal", "page"],
}
#: Passes whose blocks of more pairs than this are left to finer keys (``finer_pairs``), which bring every pair that ``strong`` accepts.
COARSE, LARGEST = ("surname+year", "journal+volume+year", "journal+page", "surname+volume"), 200_000
#: Parts over which the pairs of a finer key are spread, so that a hub is no single task.
SALT = 8


def _page_keys(page: Column, blank: str, always: str) -> Column:
    """Keys of which two pages share one if either is missing or they are near (``_level`` 1): one place masked, digits sorted, first three places."""
    masked = F.transform(F.sequence(F.lit(1), F.length(page)), lambda i: F.concat(F.lit("m"), F.substring(page, F.lit(1), i - 1), F.lit("*"), F.substring(page, i + 1, F.length(page))))
    near = F.concat(masked, F.array(F.concat(F.lit("s"), F.array_join(F.array_sort(F.split(page, "")), ""))), F.when(F.length(page) >= 3, F.array(F.concat(F.lit("p"), F.substring(page, 1, 3)))).otherwise(F.array().cast("array<string>")))
    return F.when(page == "", F.array(F.lit(blank), F.lit(always))).otherwise(F.concat(near, F.array(F.lit(always))))


def finer_pairs(r: DataFrame, c: DataFrame) -> DataFrame:
    """``rk, ck`` of every pair ``strong`` accepts that no pass on equal pages brings, whatever the size of its block.

    Without an equal page, ``strong`` asks for an equal volume with the surname or the year and a page near or
    missing, or for equal surname, year and a further author. Both years of a candidate count.
    """
    years = lambda df, p: df.withColumn("y", F.explode(F.array_distinct(F.array(f"{p}_year", f"{p}_year2") if p == "c" else F.array(f"{p}_year"))))
    out = None
    for keys in (["surname", "volume"], ["y", "volume"], ["surname", "y", "person"]):
        sides = []
        for df, p, k in ((r, "r", "rk"), (c, "c", "ck")):
            df = years(df, p) if "y" in keys else df
            if "person" in keys:
                df = df.withColumn("person", F.explode(F.array_except(F.col(f"{p}_people"), F.array(f"{p}_surname"))))
                sub = F.array(F.lit(""))
            else:
                # a missing page meets every page of the other side
                sub = _page_keys(F.col(f"{p}_page"), "-r" if p == "r" else "-c", "-c" if p == "r" else "-r")
            cols = [F.col(x if x in ("y", "person") else f"{p}_{x}") for x in keys]
            for x in cols:
                df = df.where(x != "")
            salt = F.array(F.pmod(F.col(k), F.lit(SALT)).cast("int")) if p == "r" else F.sequence(F.lit(0), F.lit(SALT - 1))
            sides.append(df.select(k, F.concat_ws("\u0001", *cols).alias("b"), F.explode(sub).alias("s"), salt.alias("salts")).select(k, "b", "s", F.explode("salts").alias("salt")))
        pairs = sides[0].join(sides[1], ["b", "s", "salt"]).select("rk", "ck")
        out = pairs if out is None else out.unionByName(pairs)
    # the pages of the two years: an equal page with the year of the bibcode
    by_page = years(c, "c").where("y <> '' and c_page <> ''").select("ck", F.concat_ws("\u0001", "y", "c_page").alias("b"))
    return out.unionByName(r.where("r_year <> '' and r_page <> ''").select("rk", F.concat_ws("\u0001", "r_year", "r_page").alias("b")).join(by_page, "b").select("rk", "ck")).distinct()


def _level(a: str, b: str, near: Column) -> Column:
    x, y = F.col(a), F.col(b)
    return F.when((x == "") | (y == ""), -1).when(x == y, 2).when(near, 1).otherwise(0)


def comparisons(refs: DataFrame, cands: DataFrame) -> DataFrame:
    """Distinct proposed pairs ``rk, ck`` with their agreement levels ``g_*`` (-1 missing, 0 apart, 1 near, 2 equal)."""
    refs, cands = cut(refs), cut(cands)
    r = refs.toDF(*[f"r_{c}" if c != "rk" else c for c in refs.columns])
    c = cands.toDF(*[f"c_{x}" if x != "ck" else x for x in cands.columns])
    sides = []
    for df, p, k in ((r, "r", "rk"), (c, "c", "ck")):
        passes = []
        for name, keys in PASSES.items():
            cols = [F.col(f"{p}_{x}") for x in keys]
            full = cols[0] != ""
            for x in cols[1:]:
                full = full & (x != "")
            passes.append(F.when(full, F.concat_ws("\u0001", F.lit(("c:" if name in COARSE else "f:") + name), *cols)))
        sides.append(df.select(k, F.explode(F.array_compact(F.array(*passes))).alias("b")))
    left, right = sides  # the keys of all passes in one join
    coarse = lambda x, n: x.where(F.startswith(F.col("b"), F.lit("c:"))).groupBy("b").agg(F.count("*").alias(n))
    left = left.join(coarse(left, "nl").join(coarse(right, "nr"), "b").where(F.col("nl") * F.col("nr") > LARGEST).select("b"), "b", "left_anti")
    found = left.join(right, "b").select("rk", "ck").distinct()
    both = cut(found.unionByName(cut(finer_pairs(r, c))).distinct()).join(r, "rk").join(c, "ck")
    digits = lambda x: F.array_sort(F.split(F.col(x), ""))
    near_digits = lambda a, b: (F.length(a) == F.length(b)) & ((F.length(a) > 1) & (F.levenshtein(F.col(a), F.col(b)) <= 1) | (digits(a) == digits(b))) | (F.length(a) >= 3) & (F.col(a).startswith(F.col(b)) | F.col(b).startswith(F.col(a))) & (F.length(b) >= 3)
    others = lambda p: F.array_except(F.col(f"{p}_people"), F.array(F.col("r_surname"), F.col("c_surname")))
    mine, theirs = others("r"), others("c")
    close = F.exists(mine, lambda x: F.exists(theirs, lambda y: F.levenshtein(x, y) <= 2))
    year2 = (F.col("c_year2") != "") & (F.col("r_year") == F.col("c_year2"))
    return both.select(
        "rk", "ck",
        _level("r_surname", "c_surname", (F.levenshtein("r_surname", "c_surname") <= 2) & (F.length("r_surname") > 4)).alias("g_surname"),
        F.when((F.col("r_year") != "") & year2, 2).otherwise(_level("r_year", "c_year", F.abs(F.expr("try_cast(r_year as int) - try_cast(c_year as int)")) <= 1)).alias("g_year"),
        _level("r_journal", "c_journal", F.lit(False)).alias("g_journal"),
        _level("r_volume", "c_volume", near_digits("r_volume", "c_volume")).alias("g_volume"),
        _level("r_page", "c_page", near_digits("r_page", "c_page")).alias("g_page"),
        F.when((F.size(mine) < 1) | (F.size(theirs) < 1), -1).when(F.arrays_overlap(mine, theirs), 2).when(close, 1).otherwise(0).alias("g_people"),
    )


LEVELS = ["g_surname", "g_year", "g_journal", "g_volume", "g_page", "g_people"]


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[dict[int, float]], list[dict[int, float]]]:
    """Prior, match and non-match probabilities of the levels by expectation-maximisation over pattern counts.

    Missing levels carry no evidence. Start: a match agrees on nine attributes of ten. Probabilities keep a
    floor, and no agreement may speak against a match.
    """
    k = len(patterns[0][0]) if patterns else 0
    m = [{2: 0.9, 1: 0.07, 0: 0.03} for _ in range(k)]
    u = [{2: 0.1, 1: 0.1, 0: 0.8} for _ in range(k)]
    prior = 0.1
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        cm = [{2: 0.5, 1: 0.5, 0: 0.5} for _ in range(k)]
        cu = [{2: 0.5, 1: 0.5, 0: 0.5} for _ in range(k)]
        mass = 0.0
        for g, n in patterns:
            p = posterior(g, prior, m, u)
            mass += n * p
            for i, x in enumerate(g):
                if x >= 0:
                    cm[i][x] += n * p
                    cu[i][x] += n * (1 - p)
        prior = min(0.9, max(1e-6, mass / max(1, total)))
        m = [{x: v / sum(d.values()) for x, v in d.items()} for d in cm]
        u = [{x: v / sum(d.values()) for x, v in d.items()} for d in cu]
    return prior, m, u


def posterior(g: tuple[int, ...], prior: float, m: list[dict[int, float]], u: list[dict[int, float]]) -> float:
    s = math.log(prior / (1 - prior)) + sum(math.log(m[i][x] / u[i][x]) for i, x in enumerate(g) if x >= 0)
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, s))))


def link_records(refs: DataFrame, cands: DataFrame, journals: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``ref_id, cand_id, confidence`` of the pairs whose posterior is at least ``threshold``.

    Records equal in all compared fields are compared once, as one representative, and expanded to their
    rows at the end, so a group of copies that holds a third of a table costs one comparison. A block of a
    coarse pass with more than ``LARGEST`` pairs is left to finer keys that together bring every pair the
    last check can accept (``finer_pairs``), so no pair is lost by the size of its block. Records without
    any compared value match nothing; null fields count as missing; repeated ids give their pairs once.
    Level patterns (at most 4⁶) are the only thing that reaches the driver, besides the journals table,
    which must have at most 10 000 rows.
    """
    rows = journals.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("too many journals to broadcast")
    known = [(x["journal"], [v for v in (x["journal"], x["full_name"], x["bibstem"]) if v]) for x in rows if x["journal"]]
    keys = ["surname", "year", "journal", "volume", "page", "people"]
    r = _with_journal(reference_features(refs.where("ref_id is not null")), known).withColumn("people", _people(F.col("names"))).select("ref_id", *keys)
    c = _with_journal(candidate_features(cands.where("cand_id is not null")), known).withColumn("people", _people(F.col("names"))).select("cand_id", *keys, "year2")
    # the passes read these tables many times: written once, every pass is a plain join of flat columns
    r = cut(r.withColumn("rk", F.xxhash64(*keys)))
    c = cut(c.withColumn("ck", F.xxhash64(*keys, "year2")))
    rr, cc = r.drop("ref_id").dropDuplicates(["rk"]), c.drop("cand_id").dropDuplicates(["ck"])
    pairs = cut(comparisons(rr, cc))
    patterns = [(tuple(x[g] for g in LEVELS), x["n"]) for x in pairs.groupBy(*LEVELS).agg(F.count("*").alias("n")).collect()]
    prior, m, u = fit(patterns)
    score = {g: posterior(g, prior, m, u) for g, _ in patterns}
    # an exact check of what is left: two identifying values equal, volume and page never apart, and a misprinted one only beside the other
    strong = lambda g: sum(g[i] == 2 for i in (0, 1, 3, 4)) >= 2 and 0 not in (g[3], g[4]) and (2 in (g[3], g[4]) or g[5] == 2)
    table = [(*g, float(p)) for g, p in score.items() if p >= threshold and strong(g)]
    kept = pairs.join(F.broadcast(refs.sparkSession.createDataFrame(table, ", ".join(f"{x} int" for x in LEVELS) + ", confidence double")), LEVELS)
    return kept.select("rk", "ck", "confidence").join(r.select("rk", "ref_id").distinct(), "rk").join(c.select("ck", "cand_id").distinct(), "ck").select("ref_id", "cand_id", "confidence")
