"""Ranked text search with BM25."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions.text import words

K1, B = 1.2, 0.75
#: Words that are no terms of a full-text query.
RESERVED = frozenset("and or not near ne a an the is are to of in on for".split())


def query_terms(text: str, most: int = 24) -> list[str]:
    """Distinct terms of a query in order: two letters or more, no reserved words, at most ``most``."""
    out: list[str] = []
    for w in re.findall(r"\w+", text.lower()):
        if len(w) >= 2 and w not in RESERVED and w not in out:
            out.append(w)
    return out[:most]


def postings(df: DataFrame, id_col: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """``(id, term, tf)`` and ``(id, len)``: the inverted index of a table."""
    toks = df.select(F.col(id_col), words(text).alias("w"))
    return (
        toks.select(id_col, F.explode("w").alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf")),
        toks.select(id_col, F.size("w").alias("len")),
    )


def search(df: DataFrame, id_col: str, text: Column, terms: list[str], require_all: bool = True) -> DataFrame:
    """``(id, bm25)`` of the rows that hold all (or any) of the terms; lower is better.

    Only the query's terms are looked for, inside the scan: one aggregation of a single row gives the corpus
    statistics, and only rows that hold the terms are counted in a second narrow pass; no list of words is
    built. Null texts have no words.
    """
    if not terms:
        return df.select(id_col, F.lit(0.0).alias("bm25")).limit(0)
    low = F.lower(F.coalesce(text, F.lit("")))
    part = r"[\p{L}\p{N}_]"
    whole = [F.lit(rf"(?<!{part}){re.escape(t)}(?!{part})") for t in terms]
    # a text that does not hold the letters of a term is not searched for the word
    has = [F.contains(F.col("low"), F.lit(t)) & F.regexp_like(F.col("low"), w) for t, w in zip(terms, whole)]
    texts = df.select(F.col(id_col), low.alias("low"))
    length = F.regexp_count("low", F.lit(rf"{part}+"))
    stats = texts.agg(F.count("*").alias("n"), F.avg(length).alias("avg_len"), *[F.count_if(h).alias(f"d{i}") for i, h in enumerate(has)])
    keep = has[0]
    for h in has[1:]:
        keep = keep & h if require_all else keep | h
    rows = texts.where(keep).select(id_col, length.alias("len"), *[F.regexp_count("low", w).alias(f"f{i}") for i, w in enumerate(whole)])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        f = F.col(f"f{i}").cast("double")
        score = score - F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))).otherwise(0.0)
    return rows.crossJoin(F.broadcast(stats)).select(id_col, score.alias("bm25"))


def search_many(df: DataFrame, id_col: str, text: Column, queries: DataFrame, require_all: bool = False) -> DataFrame:
    """``(query_id, id, bm25)`` for a table of queries ``query_id, term``, through the inverted index."""
    post, lens = postings(df, id_col, text)
    stats = lens.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    terms = queries.select("query_id", "term").distinct()
    wanted = post.join(terms.select("term").distinct(), "term", "left_semi")
    df_ = wanted.groupBy("term").agg(F.count("*").alias("d"))
    idf = F.log((F.col("n") - F.col("d") + 0.5) / (F.col("d") + 0.5))
    one = F.when(idf <= 0, 1e-6).otherwise(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = wanted.join(df_, "term").join(lens, id_col).crossJoin(F.broadcast(stats)).select(id_col, "term", one.alias("s"))
    hits = scored.join(terms, "term").groupBy("query_id", id_col).agg((-F.sum("s")).alias("bm25"), F.count("*").alias("k"))
    if require_all:
        hits = hits.join(terms.groupBy("query_id").agg(F.count("*").alias("need")), "query_id").where("k = need")
    return hits.select("query_id", id_col, "bm25")
