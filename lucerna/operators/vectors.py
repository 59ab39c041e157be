"""Nearest neighbours over embedding vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in double precision; null for a null or zero vector."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, 1.0 - dot(a, b) / n)


#: Query vectors held by a task at a time.
BLOCK = 10_000


def nearest(df: DataFrame, id_col: str, vec: str, query: DataFrame, query_id: str, query_vec: str, k: int, group: str | None = None, query_group: str | None = None) -> DataFrame:
    """``query_id, id, distance``: the ``k`` nearest rows of each query vector by cosine, exactly; ties go to the smaller id.

    The queries are a stated set. They are taken in blocks of ``BLOCK``, each of which is broadcast as one
    matrix; the vectors stream past it in Arrow batches, and at most ``k`` rows a query (and their ties) leave
    a batch. Null and zero vectors and those of another length have no distance. With ``group`` a row is left
    out where its group is the query's.
    """
    from lucerna.operators.retrieval import top_per_group

    spark = df.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in [*df.schema, *query.schema]}
    q = query.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("qv"), (F.col(query_group) if query_group else F.lit(None)).alias("qg")).where("qv is not null")
    rows = df.select(F.col(id_col), F.col(vec).alias("v"), (F.col(group) if group else F.lit(None)).alias("g")).where("v is not null")
    schema = f"query_id {kinds[query_id]}, {id_col} {kinds[id_col]}, distance double"
    out = spark.createDataFrame([], schema)
    block: list = []
    blocks = []
    for r in q.toLocalIterator():
        block.append((r["query_id"], r["qv"], r["qg"]))
        if len(block) == BLOCK:
            blocks.append(spark.sparkContext.broadcast(_matrices(block)))
            block = []
    if block:
        blocks.append(spark.sparkContext.broadcast(_matrices(block)))
    for shared in blocks:
        out = out.unionByName(rows.mapInPandas(_nearest_in(shared, id_col, k), schema))
    return top_per_group(out, ["query_id"], [F.col("distance"), F.col(id_col)], k)


def _matrices(block: list) -> dict[int, tuple[list, np.ndarray, list]]:
    """Length → ids, unit vectors and groups of the queries of that length."""
    by: dict[int, list] = {}
    for i, v, g in block:
        v = np.array([np.nan if x is None else x for x in v], dtype=np.float64)
        if len(v) and np.isfinite(v).all() and (v != 0).any():
            by.setdefault(len(v), []).append((i, v / np.sqrt(v @ v), g))
    return {n: ([i for i, _, _ in x], np.stack([v for _, v, _ in x]), [g for _, _, g in x]) for n, x in by.items()}


def _nearest_in(shared, id_col: str, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = b["v"].map(len).to_numpy()
            for n, (ids, unit, groups) in shared.value.items():
                at = np.flatnonzero(sizes == n)
                if not len(at):
                    continue
                x = np.stack(b["v"].iloc[at].to_list()).astype(np.float64)
                norm = np.sqrt((x * x).sum(axis=1))
                ok = np.isfinite(norm) & (norm > 0)
                x, own, kin = x[ok] / norm[ok, None], b[id_col].to_numpy()[at[ok]], b["g"].to_numpy()[at[ok]]
                if not len(own):
                    continue
                for lo in range(0, len(ids), 256):
                    # equal vectors must get equal distances, whatever the order of summation
                    d = np.round(1.0 - unit[lo : lo + 256] @ x.T, 12)
                    for j, row in enumerate(d):
                        if groups[lo + j] is not None:
                            row = np.where(kin == groups[lo + j], np.inf, row)
                        last = np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1]
                        hit = np.flatnonzero((row <= last) & np.isfinite(row))
                        hit = hit[np.lexsort((own[hit], row[hit]))][:k]
                        yield pd.DataFrame({"query_id": [ids[lo + j]] * len(hit), id_col: own[hit], "distance": row[hit]})

    return lambda batches: _joined(run(batches), id_col)


def _joined(parts: Iterator[pd.DataFrame], id_col: str) -> Iterator[pd.DataFrame]:
    """Small frames put together, so that few Arrow batches are sent."""
    held: list[pd.DataFrame] = []
    for p in parts:
        held.append(p)
        if len(held) == 2000:
            yield pd.concat(held)
            held = []
    if held:
        yield pd.concat(held)


def mean_vector(df: DataFrame, by: str, vec: str) -> DataFrame:
    """Element-wise mean of the vectors of each group."""
    parts = df.select(by, F.posexplode(vec).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s.m).alias("mean"))


def hash_embedding(text: str, dim: int = 8) -> list[float]:
    """Deterministic stand-in for a model: bytes of SHA-256 scaled to [-1, 1]."""
    h = hashlib.sha256(text.encode()).digest()
    return [h[i % 32] / 127.5 - 1.0 for i in range(dim)]


def hash_embedding_col(text: Column, dim: int = 8) -> Column:
    """``hash_embedding`` in built-in expressions."""
    h = F.sha2(F.coalesce(text, F.lit("")), 256)
    return F.array(*[F.conv(F.substring(h, 2 * (i % 32) + 1, 2), 16, 10).cast("double") / 127.5 - 1.0 for i in range(dim)])


def valid_vectors(df: DataFrame, vec: str) -> DataFrame:
    """Vectors as arrays of double; rows with a missing, empty or incomplete vector are dropped."""
    v = F.col(vec).cast("array<double>")
    return df.withColumn(vec, v).where(F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x)))


def embed(df: DataFrame, text: str, out: str = "embedding", client: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 16) -> DataFrame:
    """Adds vectors from a provider called with ``batch`` texts at a time."""
    call = client or (lambda texts: [hash_embedding(t) for t in texts])

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            t, vs = s.fillna("").tolist(), []
            for i in range(0, len(t), batch):
                vs += call(t[i : i + batch])
            yield pd.Series(vs, index=s.index, dtype=object)

    return df.withColumn(out, run(F.col(text)))
