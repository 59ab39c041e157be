"""Problem 3: one surviving record for each group of duplicate records.

Method: consistent bundles. Fields that depend on each other form a bundle that is taken whole from
one source tuple; branch-and-bound picks one tuple per bundle so that the trust is highest and every
functional dependency between bundles holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions.text import present
from lucerna.operators.components import connected_components, key_edges


def bibcode_key(c: Column) -> Column:
    """Bibcode without white space, in capitals; null for stand-ins."""
    v = F.regexp_replace(F.regexp_replace(present(c), "&amp;|%26", "&"), r"(?U)\s+", "")
    return F.upper(v)


def arxiv_key(c: Column) -> Column:
    """arXiv id in lower case without prefix, address and version; null for stand-ins."""
    v = F.lower(F.regexp_replace(present(c), r"(?U)\s+", ""))
    v = F.regexp_replace(v, r"^(https?://)?(www\.|export\.)?arxiv\.org/(abs|pdf)/|\.pdf$", "")
    v = F.regexp_replace(F.regexp_replace(v, r"^arxiv:", ""), r"v\d+$", "")
    return F.when(v != "", v)


def path_key(c: Column) -> Column:
    """Path in lower case with single forward slashes and without ``.`` steps; null for stand-ins."""
    v = F.regexp_replace(F.lower(present(c)), r"^file://|\\", "/")
    v = F.regexp_replace(F.regexp_replace(v, "/+", "/"), r"(?<=^|/)(\./)+", "")
    return F.when(v != "", v)


KEYS = {"bibcode": bibcode_key, "arxiv_id": arxiv_key, "pdf_relpath": path_key}


def duplicate_groups(df: DataFrame, id_col: str = "id", keys: dict | None = None) -> DataFrame:
    """``(id, group_id)`` of every row linked, directly or through others, by an equal key; ``group_id`` is the smallest id.

    Every key value is a star around its smallest row, so a value shared by a third of the rows costs
    one edge a row. Null ids and keys link nothing; a repeated id counts once.
    """
    keys = keys or KEYS
    links = df.select(
        F.col(id_col).alias("node"),
        F.explode(F.array(*[F.when(f(F.col(c)).isNotNull(), F.concat(F.lit(f"{c}\u0001"), f(F.col(c)))) for c, f in keys.items()])).alias("key"),
    )
    return connected_components(key_edges(links)).select(F.col("node").alias("id"), F.col("component").alias("group_id"))


#: Fields taken together, and for each bundle the value that must agree with that of the other bundles.
BUNDLES = {
    "publication": (["bibcode", "published", "pub_version"], lambda: F.regexp_extract(bibcode_key(F.col("bibcode")), r"^(\d{4})", 1)),
    "preprint": (["arxiv_id", "categories", "arxiv_source_relpath"], lambda: F.lit("")),
    "file": (["pdf_relpath", "pdf_fetched_at"], lambda: F.regexp_extract(path_key(F.col("pdf_relpath")), r"/((?:19|20)\d\d)", 1)),
    "record": (["title", "abstract", "authors_json"], lambda: F.lit("")),
    "dating": (["source", "created_at"], lambda: F.lit("")),
}


def choose(options: dict[str, list[tuple[str, float, str]]]) -> tuple[float, dict[str, str]]:
    """Best ``(trust, bundle → tuple)`` with agreeing non-empty bonds, by branch-and-bound.

    ``options``: bundle → ``(bond, trust, tuple)``. Bundles are tried with the fewest choices first and
    choices from the most trusted; a branch ends when what is left cannot beat the best found.
    """
    order = sorted(options, key=lambda b: (len(options[b]), b))
    ranked = {b: sorted(options[b], key=lambda o: (-o[1], o[0], o[2])) for b in order}
    ahead = [0.0] * (len(order) + 1)
    for i in range(len(order) - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (max(0.0, ranked[order[i]][0][1]) if ranked[order[i]] else 0.0)
    best: tuple[float, dict[str, str]] = (-1.0, {})

    def walk(i: int, bond: str, trust: float, taken: dict[str, str]) -> None:
        nonlocal best
        if trust + ahead[i] <= best[0]:
            return
        if i == len(order):
            best = (trust, dict(taken))
            return
        for b, t, v in ranked[order[i]]:
            if not b or not bond or b == bond:
                taken[order[i]] = v
                walk(i + 1, bond or b, trust + t, taken)
                del taken[order[i]]
        walk(i + 1, bond, trust, taken)

    walk(0, "", 0.0, {})
    return best


def surviving_rows(df: DataFrame, id_col: str = "id", updated_col: str = "updated_at", keys: dict | None = None) -> DataFrame:
    """``(group_id, keep_id)`` of each group of two or more rows.

    The search of ``choose`` with every key field and the row's date as a bundle and the row itself as the
    bond: all bundles must come from one row. A filled key is worth 1; the date is worth less than 1, by its
    rank (latest first, null is oldest, then the smallest id), so the kept row has the most key fields
    filled, then the latest update, then the smallest id. A repeated id is taken by its best row. Of the rows
    that fill the same keys only the first in rank can be kept, so at most 2^keys rows a group go to the
    search, found by a partial aggregation: no group is gathered.
    """
    keys = keys or KEYS
    groups = duplicate_groups(df, id_col, keys)
    filled = F.concat(*[F.when(f(F.col(c)).isNotNull(), "1").otherwise("0") for c, f in keys.items()])
    rows = df.select(F.col(id_col).alias("id"), filled.alias("filled"), F.struct(F.col(updated_col).alias("at"), (-F.col(id_col)).alias("neg")).alias("rank"))
    first = groups.join(rows, "id").groupBy("group_id", "filled").agg(F.max(F.struct("rank", "id")).alias("r"))
    packed = first.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("r", "filled"))).alias("o"))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for g, rows in zip(b["group_id"], b["o"]):
                options: dict[str, list[tuple[str, float, str]]] = {"dating": []}
                for k, row in enumerate(rows):  # from the last in rank to the first
                    options["dating"].append((str(k + 1), (k + 1) / (len(rows) + 1), str(k)))
                    for name, has in zip(keys, row["filled"]):
                        if has == "1":
                            options.setdefault(name, []).append((str(k + 1), 1.0, str(k)))
                out.append((g, rows[int(choose(options)[1]["dating"])]["r"]["id"]))
            yield pd.DataFrame(out, columns=["group_id", "keep_id"])

    return packed.select("group_id", F.transform("o", lambda x: F.struct(F.struct(x.r.id.alias("id")).alias("r"), x.filled.alias("filled"))).alias("o")).repartition(tasks, "group_id").mapInPandas(run, f"group_id {kinds['group_id']}, keep_id {kinds['id']}")


def golden_records(df: DataFrame, id_col: str = "id", updated_col: str = "updated_at", bundles: dict | None = None, source_trust: dict[str, float] | None = None) -> DataFrame:
    """One built record per duplicate group: ``group_id, trust, bundle, values`` (JSON of the bundle's fields).

    Trust of a tuple = share of its fields that are filled (weight 4) + how often the group has it
    (logarithmic) + 1 for the group's latest update + the source's own weight. Tuples are counted by a
    partial aggregation and only the most trusted tuple per bond value goes to the search: a tuple with
    the same bond and less trust can be in no better record, so the bound loses nothing, and a group of
    any size sends at most one tuple per bundle and bond (a year). Nulls and stand-ins count as unfilled.
    """
    bundles = bundles or BUNDLES
    groups = duplicate_groups(df, id_col)
    have = set(df.columns)
    weight = F.lit(0.0)
    for s, w in (source_trust or {}).items():
        weight = F.when(F.col("source") == s, w).otherwise(weight)
    parts = []
    for name, (cols, bond) in bundles.items():
        cols = [c for c in cols if c in have]
        filled = sum((present(F.col(c).cast("string")).isNotNull().cast("double") for c in cols), F.lit(0.0))
        parts.append(F.struct(F.lit(name).alias("bundle"), F.to_json(F.struct(*[F.col(c) for c in cols])).alias("values"), F.coalesce(bond(), F.lit("")).alias("bond"), (filled / max(1, len(cols))).alias("filled")))
    rows = df.select(F.col(id_col).alias("id"), F.col(updated_col).alias("at"), weight.alias("w"), F.explode(F.array(*parts)).alias("p")).select("id", "at", "w", "p.*")
    tuples = groups.join(rows, "id").groupBy("group_id", "bundle", "values", "bond", "filled").agg(F.count("*").alias("n"), F.max("at").alias("at"), F.max("w").alias("w"))
    latest = tuples.groupBy("group_id").agg(F.max("at").alias("last"))
    trusted = tuples.join(latest, "group_id").withColumn("trust", 4 * F.col("filled") + F.log1p("n") + F.coalesce((F.col("at") == F.col("last")).cast("double"), F.lit(0.0)) + F.col("w"))
    best = trusted.groupBy("group_id", "bundle", "bond").agg(F.max_by("values", F.struct("trust", "values")).alias("values"), F.max("trust").alias("trust"))
    packed = best.groupBy("group_id").agg(F.collect_list(F.struct("bundle", "bond", "trust", "values")).alias("o"))
    kind = packed.schema["group_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for g, opts in zip(b["group_id"], b["o"]):
                by: dict[str, list] = {}
                for o in opts:
                    by.setdefault(o["bundle"], []).append((o["bond"], float(o["trust"]), o["values"]))
                trust, taken = choose(by)
                out += [(g, trust, k, v) for k, v in sorted(taken.items())]
            yield pd.DataFrame(out, columns=["group_id", "trust", "bundle", "values"])

    return packed.mapInPandas(run, f"group_id {kind}, trust double, bundle string, values string")
