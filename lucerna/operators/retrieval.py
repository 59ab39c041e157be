"""Fusion, diversification, budgets and bundles over ranked passages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rrf(lists: DataFrame, item: str, by: list[str] | None = None, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ``list_id, rank (from 0), item``: Σ 1/(k + rank + 1); ties keep the first seen."""
    keys = [*(by or []), item]
    return lists.groupBy(*keys).agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("rrf"), F.min(F.struct("list_id", "rank")).alias("first_seen"))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows of each group; Spark keeps only ``k`` per group before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def within_budget(df: DataFrame, by: list[str], order: list[Column], length: Column, most: int, separator: int = 0) -> DataFrame:
    """Leading rows of each group whose lengths (with separators) add up to at most ``most``; the first row always stays."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("used", F.sum(length + separator).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(w)).where((F.col("used") <= most) | (F.col("rn") == 1))


def first_of_union(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Union of several result lists in which the first occurrence of a key wins."""
    return top_per_group(df, key, order, 1)


def mmr_pick(texts: list[str], scores: list[float], k: int, lam: float = 0.6) -> list[int]:
    """Indices picked by maximal marginal relevance; words longer than two letters, strict improvement wins."""
    n = len(texts)
    if n <= k:
        return list(range(n))
    sets = [frozenset(w for w in t.lower().split() if len(w) > 2) for t in texts]
    near, picked, left = [0.0] * n, [], list(range(n))
    while left and len(picked) < k:
        best, at = None, left[0]
        for i in left:
            v = lam * scores[i] - (1 - lam) * near[i] if picked else scores[i]
            if best is None or v > best:
                best, at = v, i
        picked.append(at)
        left.remove(at)
        for i in left:
            both = len(sets[i] | sets[at])
            near[i] = max(near[i], len(sets[i] & sets[at]) / both if both else 0.0)
    return picked


def mmr(df: DataFrame, by: str, item: str, text: str, score: str, k: int = 16, lam: float = 0.6, pool: int = 48) -> DataFrame:
    """``by, item, pick`` of a diversified selection per query. The pool is part of the operator: what the fused lists of a query hold (24 of each), so a group is bounded."""
    best = top_per_group(df.select(by, item, text, score), [by], [F.desc(score), F.col(item)], pool)
    kinds = {f.name: f.dataType.simpleString() for f in best.schema}

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values([score, item], ascending=[False, True]).reset_index(drop=True)
        at = mmr_pick(x[text].fillna("").tolist(), x[score].astype(float).tolist(), k, lam)
        return pd.DataFrame({by: x[by].iloc[at].values, item: x[item].iloc[at].values, "pick": range(1, len(at) + 1)})

    return best.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {item} {kinds[item]}, pick int")


def pack_bundles(df: DataFrame, by: str, ord_col: str, text: str, most: int) -> DataFrame:
    """Greedy bundles: a text joins the open bundle unless it would pass ``most``; then a new one opens.

    The choice depends on all texts before, so the lengths of a group (no texts) are walked through in one task.
    """
    lens = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(ord_col).alias("o"), F.length(text).alias("n")))).alias("x"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, rows in zip(b[by], b["x"]):
                out, bundle, used = [], 0, 0
                for r in rows:
                    n = r["n"] or 0
                    bundle, used = (bundle + 1, n) if used and used + n > most else (bundle, used + n)
                    out.append((g, r["o"], bundle))
                yield pd.DataFrame(out, columns=[by, ord_col, "bundle"])

    return lens.mapInPandas(run, f"{by} {kinds[by]}, {ord_col} {kinds[ord_col]}, bundle int")


def hybrid(chunks: DataFrame, item: str, text: str, terms: list[str], query_vector: list[float], vector: Column, pool: int = 24) -> DataFrame:
    """``item, rrf, list_id, rank``: the fused ``pool`` best rows by words and by vectors."""
    from lucerna.operators import bm25, vectors

    words = bm25.search(chunks, item, F.col(text), terms, False).select(item, F.round("bm25", 6).alias("s"))
    near = chunks.select(item, F.round(vectors.cosine_distance(vector, F.array(*[F.lit(float(x)) for x in query_vector])), 9).alias("s")).where("s is not null")
    lists = None
    for k, hits in enumerate((words, near)):
        top = hits.orderBy("s", item).limit(pool)
        top = top.select(item, (F.row_number().over(Window.orderBy("s", item)) - 1).alias("rank"), F.lit(k).alias("list_id"))
        lists = top if lists is None else lists.unionByName(top)
    return rrf(lists, item).select(item, "rrf", "first_seen.list_id", "first_seen.rank")


def grounded(excerpt: Column, body: Column, least: float = 0.6) -> Column:
    """Whether a body holds an excerpt: as a part after normalisation, or by ``least`` of its words."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    toks = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)))
    recall = F.size(F.array_intersect(toks(excerpt), toks(body))) / F.size(toks(excerpt))
    return F.coalesce((flat(excerpt) != "") & (F.contains(flat(body), flat(excerpt)) | (recall >= least)), F.lit(False))
