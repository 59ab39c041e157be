"""Table mutations as pure functions: new state from old state and a delta."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions.text import nonblank
from lucerna.runtime import cut


def upsert_papers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Papers after an upsert of ``new`` (arxiv_id, bibcode, title, abstract, published, source, pdf_relpath, at).

    A row matches by arxiv_id, else by bibcode. Ids, published and pdf_relpath are filled only where the delta
    has them; title, abstract and source are overwritten, empty or not; created_at stays. Later duplicates of
    a key within the delta are expected to be merged before. New ids follow the largest old one.
    """
    d = cut(new.withColumn("_k", F.monotonically_increasing_id()))  # written once: a recomputed branch could number rows otherwise
    by_arxiv = d.where(nonblank(F.col("arxiv_id"))).join(old.where(nonblank(F.col("arxiv_id"))).select("arxiv_id", F.col("id").alias("_a")), "arxiv_id").groupBy("_k").agg(F.min("_a").alias("_a"))
    by_bib = d.where(nonblank(F.col("bibcode"))).join(old.where(nonblank(F.col("bibcode"))).select("bibcode", F.col("id").alias("_b")), "bibcode").groupBy("_k").agg(F.min("_b").alias("_b"))
    d = d.join(by_arxiv, "_k", "left").join(by_bib, "_k", "left").withColumn("_id", F.coalesce("_a", "_b")).drop("_a", "_b")
    hit = d.where("_id is not null").groupBy("_id").agg(*[F.max_by(c, "_k").alias(f"n_{c}") for c in new.columns])
    keep = lambda c: F.coalesce(F.nullif(F.col(f"n_{c}"), F.lit("")), F.col(c)).alias(c)
    over = lambda c: F.when(F.col("_id").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    cols = ["id", "arxiv_id", "bibcode", "title", "abstract", "published", "source", "pdf_relpath", "created_at", "updated_at"]
    changed = old.join(hit, old.id == hit._id, "left").select(
        "id", keep("arxiv_id"), keep("bibcode"), over("title"), over("abstract"), keep("published"), over("source"), keep("pdf_relpath"), "created_at", F.coalesce("n_at", "updated_at").alias("updated_at"))
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    added = number_rows(d.where("_id is null").drop("_id"), ["arxiv_id", "bibcode", "title"]).crossJoin(F.broadcast(top)).select(
        (F.col("_top") + F.col("n")).alias("id"), "arxiv_id", "bibcode", "title", "abstract", "published", "source", "pdf_relpath", F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    return changed.select(*cols).unionByName(added.select(*cols))


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``n`` = 1, 2, … in the given order without gathering the rows in one task: range partitions, then offsets."""
    parts = cut(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*[F.col(c).asc_nulls_first() for c in order]))).join(F.broadcast(before), "_p").withColumn("n", F.col("_before") + F.col("_r")).drop("_p", "_r", "_before")


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete all old rows of the keys in ``new`` and add ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def replace_references(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with those of the citing papers in ``new`` replaced: trimmed, without blanks, each once."""
    clean = new.select("from_paper_id", F.trim("ref_bibcode").alias("ref_bibcode")).where("ref_bibcode <> ''").distinct()
    gone = old.select("from_paper_id", "ref_bibcode").join(new.select("from_paper_id").distinct(), "from_paper_id", "left_anti")
    return gone.unionByName(clean)


def patch(old: DataFrame, delta: DataFrame, key: str, clear: tuple[str, ...] = ()) -> DataFrame:
    """Set the delta's non-null columns; columns in ``clear`` become null for its keys."""
    d = delta.select(F.col(key).alias("_k"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"d_{c}") for c in delta.columns if c != key])
    have = set(delta.columns)
    out = [F.when(F.col("_hit"), None).otherwise(F.col(c)).alias(c) if c in clear else F.coalesce(f"d_{c}", c).alias(c) if c in have and c != key else F.col(c) for c in old.columns]
    return old.join(d, old[key] == d._k, "left").select(*out)
